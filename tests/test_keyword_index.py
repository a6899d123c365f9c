"""The stored keyword index against BM25 in plain Python and against the search without an index; what it reads; replacement and replays."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidepool.operators import retrieval
from tidepool.operators.keyword_index import KeywordIndex

DOCS = "doc_id long, text string, title string, tags array<string>"


def _tokens(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def _bm25(docs, queries, k, title=0.5, boosts=None, tags=None):
    n, mean = len(docs), sum(len(_tokens(d[1])) for d in docs) / len(docs)
    tf = {d[0]: {} for d in docs}
    for i, text, head, _ in docs:
        for w, x in [(w, 1.0) for w in _tokens(text)] + [(w, title) for w in _tokens(head)]:
            tf[i][w] = tf[i].get(w, 0.0) + x
    size = {d[0]: len(_tokens(d[1])) for d in docs}
    own = {d[0]: d[3] or [] for d in docs}
    out = {}
    for q, text in queries:
        found = []
        for i in tf:
            s = 0.0
            for w in dict.fromkeys(_tokens(text)):
                df = sum(w in x for x in tf.values())
                if w in tf[i]:
                    f = tf[i][w]
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * (boosts or {}).get(w, 1.0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / mean))
            if any(w in tf[i] for w in _tokens(text)) and set(tags or []) <= set(own[i]):
                found.append((-round(s, 9), i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return {q: x for q, x in out.items() if x}


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    return out


def _same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)
        assert {i for i, s in got[q] if s > want[q][-1][1] + 1e-8} == {i for i, s in want[q] if s > want[q][-1][1] + 1e-8}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60))), " ".join(rng.choices(words, k=2)), rng.sample(["a", "b", "c"], rng.randrange(4))) for i in range(400)]
    docs += [(1000, None, "w3 w3", None), (1001, "", None, ["a"]), (1002, "W1, w1. W2!", "", ["b"])]
    return docs, [(1, "w0 w40 w55"), (2, "w59"), (3, "w0 w1 w2 w3"), (4, "nothing"), (5, ""), (6, "W7 w7 w50")]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    out = KeywordIndex.at(spark, f"file://{tmp_path_factory.mktemp('index')}", buckets=8, block_rows=10)
    out.put(spark.createDataFrame(corpus[0], DOCS), ("load", 0))
    return out


def test_search_equals_bm25(spark, corpus, index):
    docs, queries = corpus
    qs = spark.createDataFrame(queries, "query_id long, query string")
    for k in (3, 20, 1000):
        _same(_got(index.search(qs, k)), _bm25(docs, queries, k))
    _same(_got(index.search(qs, 5, boosts={"w40": 2.0, "w2": 3.0})), _bm25(docs, queries, 5, boosts={"w40": 2.0, "w2": 3.0}))
    _same(_got(index.search(qs, 5, tags=["a", "b"])), _bm25(docs, queries, 5, tags=["a", "b"]))


def test_without_titles_it_is_the_search_without_an_index(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus[0], DOCS).filter("text is not null")
    plain = KeywordIndex.at(spark, f"file://{tmp_path}/plain", buckets=4, title_weight=0.0)
    plain.put(docs.withColumn("title", F.lit(None).cast("string")))
    qs = spark.createDataFrame(corpus[1], "query_id long, query string")
    _same(_got(plain.search(qs, 10)), _got(retrieval.keyword_search(docs, qs, 10)))


def test_a_search_opens_its_terms_buckets_and_few_blocks(spark, corpus, index):
    qs = spark.createDataFrame([(2, "w59")], "query_id long, query string")
    buckets = index.blocks.touched(spark.createDataFrame([("w59",)], "term string"))
    files = index.blocks.read(buckets).inputFiles()
    assert len(buckets) == 1 and files and all(f"_bucket={buckets[0]}/" in f for f in files)
    read = []
    index.search(spark.createDataFrame([(1, "w1"), (2, "w0 w58")], "query_id long, query string"), 3, read=read).count()
    whole = {r.term: r["count"] for r in index.blocks.read().groupBy("term").count().collect()}
    opened = {(r.query_id, r.term): r["count"] for r in read[0].groupBy("query_id", "term").count().collect()}
    assert opened[1, "w1"] < 0.4 * whole["w1"] and opened.get((2, "w0"), 0) + opened[2, "w58"] < whole["w0"] + whole["w58"]


def test_replacing_and_removing_equals_building_anew(spark, corpus, tmp_path):
    docs, queries = corpus
    qs = spark.createDataFrame(queries, "query_id long, query string")
    index = KeywordIndex.at(spark, f"file://{tmp_path}/i", buckets=4, block_rows=16)
    index.put(spark.createDataFrame(docs[:250], DOCS), ("s", 0))
    new = [(i, f"w59 w{i % 9} changed " * 3, "w1", ["c"]) for i in range(200, 260)]
    for _ in range(2):
        index.put(spark.createDataFrame(new, DOCS), ("s", 1))
    index.remove(spark.createDataFrame([(i,) for i in range(0, 100, 2)] + [(9999,)], "doc_id long"), ("s", 2))
    left = [d for d in docs[:250] if d[0] < 200 and not (d[0] < 100 and d[0] % 2 == 0)] + new
    _same(_got(index.search(qs, 15)), _bm25(left, queries, 15))
    found = {r.doc_id for r in index.blocks.read().select(F.inline("postings")).select("doc_id").distinct().collect()}
    assert found == {d[0] for d in left if _tokens(d[1]) or _tokens(d[2])}


def test_empty_index(spark, tmp_path):
    index = KeywordIndex.at(spark, f"file://{tmp_path}/none")
    qs = spark.createDataFrame([(1, "w0")], "query_id long, query string")
    assert index.search(qs).count() == 0
    index.put(spark.createDataFrame([], DOCS))
    assert index.search(qs).count() == 0


def test_a_search_makes_no_rows_of_pairs_and_ranks_as_rounded(spark, tmp_path):
    index = KeywordIndex.at(spark, f"file://{tmp_path}/pairs", buckets=2, block_rows=4)
    rows = [(i, f"alpha w{i % 3}", "t", ["a"]) for i in range(30)] + [(100 - i, "alpha same words", "t", ["a"]) for i in range(30)]
    index.put(spark.createDataFrame(rows, DOCS))
    queries = spark.createDataFrame([(q, "alpha same w1") for q in range(5)], "query_id long, query string")
    found = index.search(queries, 12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan.split("MapInArrow")[0], "scores are not sums of rows"
    own = sorted((r.rank, r.doc_id) for r in found.collect() if r.query_id == 3)
    assert [i for _, i in own] == [*range(1, 30, 3), 71, 72], "equal texts rank by their ids"
