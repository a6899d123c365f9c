"""Paths of many pairs, bounded walks, exploring and settings, each against plain Python."""

import random
from collections import deque

import pytest

from tidepool.operators import links, optimize, paths


def _graph(seed, nodes=40, edges=70):
    rng = random.Random(seed)
    rows = {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(edges)} | {(0, i) for i in range(20, 34)}
    near = {i: set() for i in range(nodes + 5)}
    for a, b in rows:
        near[a].add(b)
        near[b].add(a)
    return sorted(rows), near


def _all_shortest(near, a, b, most):
    queue, found, least = deque([[a]]), [], None
    while queue:
        p = queue.popleft()
        if len(p) - 1 > most or (least is not None and len(p) - 1 > least):
            break
        if p[-1] == b and len(p) > 1:
            least = len(p) - 1
            found.append(p)
            continue
        queue.extend([*p, n] for n in sorted(near.get(p[-1], ())) if n not in p)
    return sorted(found)


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_paths_of_many_pairs(spark, hops):
    rows, near = _graph(hops)
    df = spark.createDataFrame([*rows, (5, 5)], "src long, dst long")
    rng = random.Random(9)
    pairs = [tuple(rng.sample(range(42), 2)) for _ in range(60)] + [(3, 3), (0, 25), (0, 25)]
    got = {}
    for r in paths.paths_between(df, spark.createDataFrame(pairs, "a long, b long"), hops, 3).collect():
        assert len(r.path) == r.hops + 1
        got.setdefault((r.a, r.b), []).append(r.path)
    want = {(a, b): _all_shortest(near, a, b, hops)[:3] for a, b in pairs if a != b}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def _walk(mentions, seeds, confidence, depth, most):
    """Level by level, the bound looked at between levels alone."""
    of = {}
    for c, e in mentions:
        of.setdefault(e, set()).add(c)
    visited, level, best = set(), set(seeds), {}
    for d in range(depth):
        if not level or len(visited) >= most:
            break
        nxt = set()
        for e in level - visited:
            visited.add(e)
            for c in of.get(e, ()):
                best[c] = max(best.get(c, 0), confidence / (d + 1))
                nxt |= {x for y, x in mentions if y == c}
        level = nxt - visited
    return best


@pytest.mark.parametrize(("depth", "most"), [(1, 100), (2, 100), (3, 4), (3, 12), (4, 1)])
def test_bounded_walks(spark, depth, most):
    rng = random.Random(depth + most)
    mentions = sorted({(rng.randrange(30), rng.randrange(40)) for _ in range(90)})
    seeds = {q: rng.sample(range(42), 1 + q % 3) for q in range(6)}
    df = spark.createDataFrame(mentions, "chunk_id long, entity_id long")
    got = links.retrieve_bounded(df, spark.createDataFrame([(q, e) for q, own in seeds.items() for e in own], "query_id long, entity_id long"), 0.6, depth, most).collect()
    for q, own in seeds.items():
        assert {r.chunk_id: round(r.score, 9) for r in got if r.query_id == q} == {c: round(s, 9) for c, s in _walk(mentions, own, 0.6, depth, most).items()}, q


def test_graph_search_starts_from_named_entities(spark):
    entities = spark.createDataFrame([(1, "Vector Store"), (2, "graph"), (3, "Redis")], "id long, name string")
    mentions = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (12, 3)], "chunk_id long, entity_id long")
    requests = spark.createDataFrame([(1, 'about the "Vector Store" now'), (2, "all lower case"), (3, "Redis and Redis")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): (round(r.score, 3), r.rank) for r in links.graph_search(requests, entities, mentions).collect()}
    assert got == {(1, 10): (0.6, 1), (1, 11): (0.3, 2), (3, 12): (0.6, 1)}


def test_explore_takes_seeds_in_turn(spark):
    rows, near = _graph(7)
    df = spark.createDataFrame(rows, "src long, dst long")
    seeds = [(1, 0, 3), (1, 1, 0), (1, 2, 9), (1, 3, 11), (2, 0, 44), (2, 1, 5)]
    got = links.explore(df, spark.createDataFrame(seeds, "query_id long, pos int, entity_id long"), 2, 8).orderBy("query_id", "place").collect()

    def nearest(s):
        d, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y in near.get(x, ()):
                if y not in d and d[x] < 2:
                    d[y] = d[x] + 1
                    queue.append(y)
        return sorted((k, v) for v, k in d.items() if k)[:8]

    for q in (1, 2):
        want = [(s, v, k) for _, _, s in [x for x in seeds if x[0] == q][:3] for k, v in nearest(s)][:8]
        assert [(r.seed, r.entity_id, r.distance) for r in got if r.query_id == q] == want


def test_settings_equal_one_run_each(spark):
    rng = random.Random(4)
    vector = [(q, d, round(rng.random(), 3)) for q in range(5) for d in rng.sample(range(40), 12)]
    graph = [(q, d, dep, round(0.6 / (dep + 1), 6)) for q in range(5) for d in rng.sample(range(40), 18) for dep in [rng.randrange(4)]]
    truth = [(q, d) for q in range(4) for d in rng.sample(range(40), 6)]
    logits = [(q, d, rng.uniform(-3, 3)) for q in range(5) for d in range(0, 40, 2)]
    import math

    grid = optimize.settings_grid(spark)
    assert grid.count() == 30
    got = optimize.compare_settings(
        grid, spark.createDataFrame(vector, "query_id long, doc_id long, score double"), spark.createDataFrame(graph, "query_id long, doc_id long, depth int, score double"),
        spark.createDataFrame(truth, "query_id long, doc_id long"), spark.range(5).withColumnRenamed("id", "query_id"), spark.createDataFrame(logits, "query_id long, doc_id long, logit double"), 5, 10,
    ).orderBy("place").collect()
    want = []
    lg = {(q, d): x for q, d, x in logits}
    for r in grid.collect():
        f1s = []
        for q in range(5):
            best = {}
            for _, d, s in (x for x in vector if x[0] == q):
                best[d] = s * r.vector_weight
            own = sorted((x for x in graph if x[0] == q), key=lambda x: (-x[3], x[1]))[:10]
            for _, d, dep, s in own:
                if dep <= r.depth:
                    best[d] = max(best.get(d, -1), s * (1 - r.vector_weight))
            final = {d: round(0.5 * s + 0.5 / (1 + math.exp(-lg[q, d])), 9) if r.use_reranker and (q, d) in lg else round(s, 9) for d, s in best.items()}
            top = {d for d, _ in sorted(final.items(), key=lambda x: (-x[1], x[0]))[:5]}
            wanted = {d for x, d in truth if x == q}
            p, rec = len(top & wanted) / len(top), len(top & wanted) / len(wanted) if wanted else 0
            f1s.append(2 * p * rec / (p + rec) if p + rec else 0)
        want.append((-round(sum(f1s) / 5, 9), r.setting))
    assert [(-round(r.f1, 9), r.setting) for r in got] == sorted(want) and [r.place for r in got] == list(range(1, 31))


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_weighted_paths_equal_all_paths(spark, hops):
    from tidepool.operators import graph

    rng = random.Random(hops)
    edges = [(a, b, rng.randrange(1, 10) / 10) for a, b in sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(34)})]
    near = {}
    for a, b, w in edges:
        if w >= 0.3:
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
    freq = {i: rng.randrange(1, 9) for i in range(10)}
    best = {}
    for seed in (0, 3, 13):
        paths = [(seed, frozenset(), [])]
        for h in range(1, hops + 1):
            paths = [(y, used | {frozenset((x, y))}, [*ws, w]) for x, used, ws in paths for y, w in near.get(x, ()) if frozenset((x, y)) not in used]
            for x, _, ws in paths:
                if x != seed:
                    mean = sum(ws) / h
                    old = best.get((seed, x), (9, -1.0, 0.0))
                    best[seed, x] = (min(old[0], h), max(old[1], (0.8, 0.6, 0.4)[h - 1] * mean + freq.get(x, 1) / 50), max(old[2], 0.9 if mean >= 0.7 else 0.8 if mean >= 0.5 else 0.7))
    got = graph.weighted_paths(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(0,), (3,), (13,), (99,)], "id long"), spark.createDataFrame(list(freq.items()), "id long, frequency int"), hops).collect()
    assert {(r.seed, r.id): (r.hops, round(r.score, 9)) for r in got} == {k: (v[0], round(v[1], 9)) for k, v in best.items()}
    near_cut = {(r.seed, r.id) for r in got if abs(r.confidence - best[r.seed, r.id][2]) > 1e-9}
    assert len(near_cut) <= 2, "means that are a cut to the last digit may fall on either side"
