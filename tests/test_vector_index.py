"""The vector index against a full scan, and what it leaves unread."""

import random

import numpy as np
import pytest

from tidepool.operators import retrieval, vector_index


def _cloud(n, dim=8, clusters=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = centres[rng.integers(clusters, size=n)] * rng.uniform(0.5, 2, size=(n, 1)) + rng.normal(scale=0.05, size=(n, dim))
    return rows.round(6).tolist()


def _scan(rows, queries, k, threshold=None):
    """Plain numpy, every vector against every query."""
    out = {}
    for q, v in queries:
        found = []
        for i, x in rows:
            if x is not None:
                a, b = np.array(v), np.array(x)
                norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                s = float((a * b).sum() / norm) if norm else 0.0
                if threshold is None or s >= threshold:
                    found.append((-round(s, 9), i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return {q: x for q, x in out.items() if x}


def _got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = list(enumerate(_cloud(700)))
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, [0.0] * 8), (2001, None), (2002, [2 * x for x in rows[5][1]])]
    random.Random(1).shuffle(rows)
    queries = [(i, v) for i, v in enumerate(_cloud(30, seed=5))] + [(100, [0.0] * 8), (101, rows[7][1] or [1.0] * 8), (102, [-x for x in _cloud(1)[0]])]
    return rows, queries, spark.createDataFrame(rows, "doc_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, query array<double>")


@pytest.mark.parametrize(("k", "lists", "block_rows", "threshold"), [(5, 10, 16, None), (3, 1, 1000, None), (60, 25, 8, 0.5), (2000, 6, 64, None)])
def test_search_equals_a_scan(data, k, lists, block_rows, threshold):
    rows, queries, vectors, qs = data
    index = vector_index.build(vectors, lists=lists, block_rows=block_rows)
    got, want = _got(vector_index.search(index, qs, k, threshold)), _scan(rows, queries, k, threshold)
    assert got.keys() == want.keys()
    for q in want:  # scores that differ by less than a rounding may stand in either order
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9), q
        cut = want[q][-1][1]
        assert {i for i, s in got[q] if s > cut + 2e-9} == {i for i, s in want[q] if s > cut + 2e-9}


def test_equal_vectors_rank_by_id(data):
    rows, _, vectors, _ = data
    copies = sorted(i for i, x in rows if x == dict(rows)[3])
    q = vectors.sparkSession.createDataFrame([(1, dict(rows)[3])], "query_id long, query array<double>")
    got = vector_index.search(vector_index.build(vectors, lists=8, block_rows=4), q, len(copies)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == copies


def test_most_blocks_of_clustered_vectors_stay_unread(spark):
    rows = list(enumerate(_cloud(3000, clusters=30, seed=2)))
    index = vector_index.build(spark.createDataFrame(rows, "doc_id long, embedding array<double>"), lists=40, block_rows=32)
    read = []
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 3000, 100)], "query_id long, query array<double>")
    assert vector_index.search(index, queries, 5, read=read).count() == 150
    pairs = read[0].count() + read[1].count()
    assert pairs == read[0].unionByName(read[1]).distinct().count(), "no block is read twice"
    assert pairs < 0.2 * 30 * index.blocks.count()


def test_the_plan_does_not_grow_with_the_requests(spark, data):
    _, _, vectors, _ = data
    size = lambda n: len(retrieval.vector_top_k(vectors, spark.range(n).selectExpr("id as query_id", "array_repeat(cast(id % 7 as double), 8) query"), 3)._jdf.queryExecution().analyzed().toString().splitlines())
    assert size(5000) == size(2500) and size(900) == size(9)


def test_many_requests_equal_few(spark, data):
    _, queries, vectors, _ = data
    many = spark.createDataFrame([(100 * j + q, v) for q, v in queries if q < 30 for j in range(5)], "query_id long, query array<double>")
    by_scan, by_index = (_got(retrieval.vector_top_k(vectors, many, 4, vectors.doc_id % 3 > 0, block=b, offset=1)) for b in (1000, 10))
    assert {q: [s for _, s in x] for q, x in by_scan.items()} == {q: [s for _, s in x] for q, x in by_index.items()}


def test_stored_index_and_nothing_to_index(spark, data, tmp_path):
    rows, queries, vectors, qs = data
    vector_index.build(vectors, f"file://{tmp_path}/index", lists=5)
    again = vector_index.load(spark, f"file://{tmp_path}/index")
    assert _got(vector_index.search(again, qs, 2)).keys() == {q for q, _ in queries} and again.blocks.agg({"n": "sum"}).first()[0] == len(rows) - 1
    none = vector_index.build(vectors.limit(0))
    assert vector_index.search(none, qs, 3).count() == 0
    assert vector_index.search(again, qs.limit(0), 3).count() == 0
