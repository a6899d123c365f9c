"""Multi-hop reasoning against a queue that is worked off one node at a time."""

import math
import random

import pytest

from tidepool import values
from tidepool.operators import multihop, skew


def _cos(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb)


def _queue(start, request, entities, edges, hops, width, threshold):
    """Every relevant neighbour not yet visited is visited; a node's best few are queued."""
    queue, visited, done = [([start], [], entities[start][1], entities[start][1])], {start}, []
    while queue:
        nodes, path, rel, conf = queue.pop(0)
        if len(nodes) == hops + 1:
            done.append((nodes, path, round(rel, 6), round(conf, 6)))
            continue
        near = {}
        for s, d, t, c in edges:
            if s == nodes[-1] and d in entities and d not in visited:
                r = round(0.4 * _cos(request, entities[d][2]) + 0.3 * entities[d][1] + 0.3 * c, 9) if request else round((entities[d][1] + c) / 2, 9)
                if r >= threshold:
                    near[d] = min(near.get(d, (0, "~")), (-r, t))
        visited |= set(near)
        for r, d, t in sorted((x[0], d, x[1]) for d, x in near.items())[:width]:
            queue.append(([*nodes, d], [*path, (nodes[-1], t, d)], rel * -r, min(conf, -r)))
    return done


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    vec = lambda: [rng.gauss(0.4, 1) for _ in range(4)]
    entities = {i: (f"e{i}", rng.randrange(4, 10) / 10, vec()) for i in range(24)}
    edges = [(rng.randrange(26), rng.randrange(24), rng.choice("XYZ"), rng.randrange(3, 10) / 10) for _ in range(170)] + [(0, i, "HUB", 0.9) for i in range(24)]
    queries = {7: vec(), 8: vec(), 9: vec()}
    frames = (
        spark.createDataFrame([(i, *e) for i, e in entities.items()], "id long, name string, confidence double, embedding array<double>"),
        spark.createDataFrame(edges, "src long, dst long, type string, confidence double"),
        spark.createDataFrame(list(queries.items()), "query_id long, embedding array<double>"),
    )
    return entities, edges, queries, frames


@pytest.mark.parametrize(("hops", "width", "threshold", "semantic"), [(3, 2, 0.45, True), (2, 4, 0.2, True), (3, 3, 0.6, False), (1, 50, 0.0, True)])
def test_beams_equal_the_queue(spark, world, hops, width, threshold, semantic):
    entities, edges, queries, (ent, edg, qs) = world
    starts = [(q, s) for q in queries for s in (0, 3, 11)]
    df = spark.createDataFrame([(q, s, *entities[s][:2]) for q, s in starts], "query_id long, id long, name string, confidence double")
    got = multihop.beam_paths(df, edg, ent, qs if semantic else None, hops, width, threshold).collect()
    for q, s in starts:
        want = _queue(s, queries[q] if semantic else None, entities, edges, hops, width, threshold)
        own = sorted((r for r in got if (r.query_id, r.start) == (q, s)), key=lambda r: r.place)
        assert [(r.nodes, [tuple(e) for e in r.edges], round(r.relevance, 6), round(r.confidence, 6)) for r in own] == want, (q, s)
        assert all(r.names == [entities[n][0] for n in r.nodes] for r in own)


def test_hub_is_dealt_without_loss(spark, world, monkeypatch):
    entities, edges, queries, (ent, edg, qs) = world
    df = spark.createDataFrame([(7, 0, "e0", 0.5)], "query_id long, id long, name string, confidence double")
    few = sorted(map(str, multihop.beam_paths(df, edg, ent, qs, 2, 3, 0.3).collect()))
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    assert sorted(map(str, multihop.beam_paths(df, edg, ent, qs, 2, 3, 0.3).collect())) == few
    big = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, i) for i in range(50)], "k long, v long")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (99, "c")], "k long, w string")
    assert sorted(map(tuple, skew.dealt_join(big, small, ["k"], big.v).collect())) == sorted(map(tuple, big.join(small, "k").collect()))


def test_every_request_gets_an_answer(spark, world):
    entities, _, queries, (ent, edg, _) = world
    requests = spark.createDataFrame([(7, "about e3 and e11", queries[7]), (8, "nothing here", queries[8]), (9, "only e5", queries[9])], "query_id long, query string, embedding array<double>")
    vectors = spark.createDataFrame([(100, [1.0, 0.0, 0.0, 0.0])], "doc_id long, embedding array<double>")
    mentions = spark.createDataFrame([(101, 3), (102, 3), (103, 3), (103, 11)], "chunk_id long, entity_id long")
    chunks = spark.createDataFrame([(i, f"text of {i} " * 100) for i in (100, 101, 102, 103)], "chunk_id long, content string")
    cut = edg.filter("dst <> 5 and src <> 5")
    rows = {r.query_id: r for r in multihop.answer_multi_hop(requests, vectors, mentions, ent, cut, chunks, 2, 3, 0.3).collect()}
    assert set(rows) == {7, 8, 9}
    assert rows[8].answer == values.NO_STARTS and rows[8].confidence == 0.0 and rows[8].paths_explored == 0 and rows[8].steps == [] and rows[8].context is None
    assert rows[9].answer == values.NO_PATHS and rows[9].confidence == 0.3
    best = rows[7]
    assert best.paths_explored == 3 and best.best_path.startswith("Starting from: e") and [s.step for s in best.steps] == [1, 2]
    assert best.answer.splitlines()[1] == best.best_path and best.context.startswith("Reasoning path: " + best.best_path)
    assert best.context.count("Evidence: ") == len(set(best.context.split("Evidence: ")[1:])) > 0, "a chunk is cited once"
    assert best.best_path == " → ".join([f"Starting from: {best.steps[0].source}", *(f"[{s.relation}] → {s.target}" for s in best.steps)])


def test_nothing_to_start_from(spark, world):
    _, _, _, (ent, edg, qs) = world
    none = spark.createDataFrame([], "query_id long, id long, name string, confidence double")
    assert multihop.beam_paths(none, edg, ent, qs).count() == 0
    assert multihop.beam_paths(spark.createDataFrame([(7, 999, "gone", 0.9)], none.schema), edg, ent, qs, 2, 2, 0.0).count() == 0


# --- re-ranking, metadata lists and routing ------------------------------------------------------------------------------------------


def test_a_reranker_has_its_weight_in_both_retrievals(spark):
    from pyspark.sql import functions as F

    from tidepool.operators import pipelines
    from tidepool.operators.config import FusionConfig

    requests = spark.createDataFrame([(1, "alpha api code syntax", [1.0, 0.0])], "query_id long, query string, embedding array<float>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2])], "doc_id long, embedding array<float>")
    chunks = vectors.selectExpr("doc_id", "case doc_id when 3 then 'wanted' else 'plain' end content", "'text' chunk_type", "false has_section", "false has_parent", "'values' doc_type", "0 age_days")
    mentions = spark.createDataFrame([], "chunk_id long, entity_id long")
    config = FusionConfig().with_(auto_strategy=False, similarity_threshold=0.1, use_mmr=False, reranker_weight=0.9)
    liked = lambda q, c: F.when(c == "wanted", 4.0).when(c == "plain", -4.0)
    run = lambda c, r: [x.doc_id for x in pipelines.retrieve(requests, vectors, mentions, chunks, c, rerank=r).orderBy("final_rank").collect()]
    assert run(config, None) == [1, 2, 3] == run(config.with_(use_reranker=False), liked) == run(config, lambda q, c: F.lit(None).cast("double"))
    assert run(config, liked) == [3, 1, 2] and run(config.with_(reranker_weight=0.0), liked) == [1, 2, 3]
    docs = chunks.selectExpr("doc_id", "concat('alpha ', content) text")
    liked_here = lambda q, c: F.when(c == "alpha wanted", 4.0).otherwise(-4.0)
    metadata = spark.createDataFrame([(1, 2, 1.0)], "query_id long, doc_id long, score double")
    enhanced = lambda **k: [(x.doc_id, x.source) for x in pipelines.retrieve_enhanced(requests, vectors, docs, chunks.select("doc_id", "doc_type", "age_days"), config, **k).orderBy("final_rank").collect()]
    assert enhanced(rerank=liked_here)[0][0] == 3 and enhanced(metadata=metadata)[0][0] == 2 != enhanced()[0][0]


def test_metadata_filters_of_many_requests(spark):
    from tidepool.operators.retrieval import metadata_search_batch

    rows = [(i, {"lang": "en" if i % 3 else "fr", "kind": f"k{i % 4}"}, ["x"] * (i % 2) + ["y"]) for i in range(60)] + [(99, None, None)]
    filters = [(1, {"lang": "fr"}, []), (2, {"lang": "en", "kind": "k1"}, ["x", "y"]), (3, {}, ["x"]), (4, {}, []), (5, None, None), (6, {"lang": "xx"}, []), (7, {"kind": "k2"}, ["x"])]
    got = metadata_search_batch(spark.createDataFrame(rows, "doc_id long, fields map<string,string>, tags array<string>"), spark.createDataFrame(filters, "query_id long, fields map<string,string>, tags array<string>"), 5).collect()
    for q, f, t in filters:
        want = [i for i, own, tags in rows if (f or t) and all((own or {}).get(k) == v for k, v in (f or {}).items()) and set(t or []) <= set(tags or [])][:5]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want, q


def test_requests_go_the_way_their_words_ask_for(spark):
    from pyspark.sql import functions as F

    from tidepool.operators import pipelines

    requests = spark.createDataFrame([(1, "what is this"), (2, "what does it affect"), (3, "explain the impact of it")], "query_id long, query string")
    search = lambda r: r.select("query_id", F.lit(1).alias("final_rank"), F.lit(5).cast("long").alias("doc_id"), F.lit("keyword").alias("source"), F.lit(0.5).alias("score"), F.lit("text").alias("content"))
    reason = lambda r: r.select("query_id", F.lit("because").alias("answer"), F.lit(0.7).alias("confidence"))
    got = {r.query_id: (r.strategy_used, r.doc_id, r.content) for r in pipelines.routed(requests, search, reason).collect()}
    assert got == {1: ("hybrid_search", 5, "text"), 2: ("graph_rag", None, "because"), 3: ("graph_rag", None, "because")}
