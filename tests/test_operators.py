"""Operators on hand-made rows: expected values are arithmetic on their definitions, with a tie, an empty input and a null where they matter."""

import math

import pytest
from pyspark.sql import functions as F

from tidepool.functions import scoring, temporal, text as tx
from tidepool.operators import chunking, evaluation, fusion, graph, links, queries as qu, retrieval, storage


def lists(spark):
    rows = [(0, s, d, float(10 - i)) for s, ds in (("vector", "ABC"), ("keyword", "BDA"), ("metadata", "CE")) for i, d in enumerate(ds)]
    return spark.createDataFrame(rows, "query_id int, source string, doc_id string, score double")


def test_weighted_reciprocal_ranks(spark):
    got = {r.doc_id: r for r in fusion.reciprocal_rank(lists(spark), {"vector": 0.4, "keyword": 0.3, "metadata": 0.3}).collect()}
    expected = {"A": 0.4 / 61 + 0.3 / 63, "B": 0.4 / 62 + 0.3 / 61, "C": 0.4 / 63 + 0.3 / 61, "D": 0.3 / 62, "E": 0.3 / 62}
    assert {d: pytest.approx(s) for d, s in expected.items()} == {d: r.score for d, r in got.items()}
    assert got["A"].source == "hybrid" and got["D"].source == "keyword"
    assert fusion.reciprocal_rank(lists(spark).limit(0)).count() == 0


def test_min_max(spark):
    df = spark.createDataFrame([(0, "a", "x", 10.0), (0, "a", "y", 5.0), (0, "a", "z", 2.0), (0, "b", "x", 5.0), (0, "b", "y", 5.0)], "query_id int, source string, doc_id string, score double")
    assert {(r.source, r.doc_id): r.score for r in fusion.min_max(df, 0.5).collect()} == {("a", "x"): 1, ("a", "y"): 0.375, ("a", "z"): 0, ("b", "x"): 0.5, ("b", "y"): 0.5}


def test_best_per_key_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 0.9, 0), (1, 0.85, 1), (2, 0.8, 2), (1, 0.9, 3)], "chunk int, score double, seq int")
    assert sorted((r.chunk, r.score, r.seq) for r in fusion.best_per_key(df, ["chunk"]).collect()) == [(1, 0.9, 0), (2, 0.8, 2)]


def test_precision_recall_f1(spark):
    got = spark.createDataFrame([(0, d) for d in "ABCD"], "query_id int, doc_id string")
    want = spark.createDataFrame([(0, d) for d in "ABEF"] + [(1, "Z")], "query_id int, doc_id string")
    assert {r.query_id: (r.precision, r.recall, r.f1) for r in evaluation.precision_recall(got, want).collect()} == {0: (0.5, 0.5, 0.5), 1: (0, 0, 0)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("kind", "age", "weight"), [("project", 60, math.exp(-(0.5**2.5))), ("project", 365, 0.1), ("meeting", 14, math.exp(-1)), ("meeting", 100, 0.05), ("default", 30, math.exp(-(0.5**1.5))), ("values", 900, 1), ("default", None, 1), ("meeting", -5, 1)])
def test_decay(spark, kind, age, weight):
    assert one(spark, temporal.decay(F.lit(age).cast("int"), F.lit(kind))) == pytest.approx(weight)


@pytest.mark.parametrize(("q", "weight"), [("latest news", 0.5), ("old files", 0.1), ("plain", 0.3), ("archive of current docs", 0.5), ("renewal", 0.5)])
def test_temporal_weight(spark, q, weight):
    assert one(spark, temporal.temporal_weight(F.lit(q))) == weight


def test_match_scores(spark):
    rows = [("vector search", "Fast VECTOR index and search", 0.7, 93.1), ("vector search", "vector search works", 0.2, 68.2), ("graph", "nothing here", 0.5, 50.0)]
    for q, c, s, expected in rows:
        assert one(spark, scoring.vector_match(F.lit(q), F.lit(c), F.lit(s))) == expected
    assert one(spark, scoring.match_quality(F.lit(93.1))) == "Excellent match"
    assert one(spark, scoring.match_explanation(F.lit(40.0), F.lit("graph"), F.lit("traversal"), F.lit(1))) == "Moderate match (40.0%) - Related entity (1 hop)"
    assert one(spark, scoring.graph_match(F.lit("rag"), F.lit("RAG"), F.lit("other"), F.lit(0), F.lit(1.0), F.lit(0.0))) == 100


def test_cosine_of_zero_and_equal_vectors(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, scoring.cosine(arr(0.0, 0.0), arr(1.0, 2.0))) == 0
    assert one(spark, scoring.cosine(arr(1.0, 2.0), arr(2.0, 4.0))) == pytest.approx(1)
    assert one(spark, scoring.prefix_cosine(arr(1.0, 0.0, 9.0), arr(3.0, 0.0))) == pytest.approx(1)


def test_links(spark):
    mentions = spark.createDataFrame([("c3", "e1"), ("c3", "e3"), ("c4", "e3"), ("c4", "e4")], "chunk_id string, entity_id string")
    got = links.related_entities(mentions, spark.createDataFrame([("e1",)], "entity_id string"), 2).collect()
    assert sorted((r.entity_id, r.depth) for r in got) == [("e3", 1), ("e4", 2)]
    scores = links.retrieve_from_seeds(mentions, spark.createDataFrame([("e1",)], "entity_id string"), 0.6, 1)
    assert {r.chunk_id: r.score for r in scores.collect()} == {"c3": 0.6, "c4": pytest.approx(0.3)}
    two = links.add_links(links.make_links(mentions, "chunk", "chunk_id", "entity", "entity_id", "mentions"))
    assert two.count() == 8 and {r.type: r.ids for r in links.traverse(two, "entity", "e3").collect()} == {"chunk": ["c3", "c4"]}


def graph_edges(spark):
    pairs = [("n1", "n2"), ("n1", "n3"), ("n2", "n4"), ("n2", "n5"), ("n3", "n5"), ("n3", "n6"), ("n4", "n7"), ("n5", "n7")]
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def test_paths(spark):
    e = graph_edges(spark)
    paths = [tuple(r.path) for r in graph.shortest_paths(e, "n1", "n7", 3).collect()]
    assert paths == [("n1", "n2", "n4", "n7"), ("n1", "n2", "n5", "n7"), ("n1", "n3", "n5", "n7")]
    near = graph.within_hops(e, spark.createDataFrame([("n1",)], "id string"), 2)
    assert {r.id: r.distance for r in near.collect()} == {"n2": 1, "n3": 1, "n4": 2, "n5": 2, "n6": 2}
    beam = graph.beam_search(e.selectExpr("src", "dst", "0.5 as relevance", "0.9 as confidence"), spark.createDataFrame([("n1",)], "id string"), 3, 2).collect()
    assert [tuple(r.path) for r in beam] == [("n1", "n2", "n4", "n7")] and beam[0].relevance == 0.125


def test_entity_in_chunk_equals_nested_loop(spark):
    chunks = [(1, "Redis and PyTorch"), (2, "ab"), (3, None), (4, "")]
    names = [(1, "redis"), (2, "b"), (3, "torch"), (4, ""), (5, None), (6, "is and P")]
    got = graph.entity_in_chunk(spark.createDataFrame(chunks, "chunk_id int, content string"), spark.createDataFrame(names, "entity_id int, name string"))
    assert {(r.chunk_id, r.entity_id) for r in got.collect()} == {(c, e) for c, t in chunks for e, n in names if t and n and n.lower() in t.lower()}


def test_matcher_rules_in_order(spark):
    rows = [("RAG", "t", "rag", "t"), ("vector index", "t", "vector indexes", "t"), ("RAG", "t", "Retrieval Augmented Generation", "t"), ("Llama-2", "t", "LLAMA 33333", "u"), ("apple", "t", "zzz", "t")]
    got = {r.a_name + "|" + r.b_name: r.kind for r in graph.match_kind(spark.createDataFrame(rows, "a_name string, a_type string, b_name string, b_type string")).collect()}
    assert got == {"RAG|rag": "SAME_AS", "vector index|vector indexes": "SIMILAR_TO", "RAG|Retrieval Augmented Generation": "ABBREVIATION_OF", "Llama-2|LLAMA 33333": "VERSION_OF"}


def test_budget_cuts_the_first_overflow(spark):
    rows = spark.createDataFrame([(0, i + 1, "w " * n) for i, n in enumerate((50, 200, 10))], "query_id int, rank int, content string")
    got = fusion.context_budget(rows, budget=200, least=100).collect()
    assert [(r.rank, len(r.content.split())) for r in got] == [(1, 50), (2, int((200 - 65) / 1.3))] and got[1].content.endswith("...")
    assert fusion.api_budget(rows, budget=200, top_k=5).count() == 1


def test_mmr_reorders_without_losing_rows(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, "a b c"), (0, 2, 0.89, "a b c"), (0, 3, 0.8, "x y z"), (1, 9, 0.1, None)], "query_id int, doc_id int, score double, content string")
    got = {(r.query_id, r.mmr_rank): r.doc_id for r in fusion.mmr_order(rows).collect()}
    assert got == {(0, 1): 1, (0, 2): 3, (0, 3): 2, (1, 1): 9}


def test_chunks():
    sentences = [f"{'word ' * 19}s{i}." for i in range(10)]
    chunks = chunking.standard_chunks(" ".join(sentences), 60, 25)
    assert all(chunking.count_tokens(c) <= 60 for c in chunks) and chunks[1].startswith("word") and "s1." in chunks[0] and "s1." in chunks[1]
    assert chunking.standard_chunks("") == chunking.semantic_chunks([]) == []
    assert chunking.standard_chunks("x" * 5000, 60, 10) == ["x" * 5000], "a sentence too long stays whole"
    long = chunking.semantic_chunks(["word " * 400], 50, 10)
    assert all(sum(chunking.count_tokens(w + " ") for w in c.split()) <= 50 for c in long) and len(long) > 8 and chunking.semantic_chunks(["short."]) == []


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.chunk_index, r.content) for r in chunking.chunk(docs, "unknown").collect()] == [(1, 0, "One. Two.")]


def test_query_understanding(spark):
    df = spark.createDataFrame([("What is RAG?",), ("compare a versus b",), ("",), ("how auth works, then why it fails",)], "q string")
    rows = {r.q: r for r in df.select("q", qu.kind(F.col("q")).alias("kind"), qu.concepts(F.col("q")).alias("c"), qu.parts(F.col("q")).alias("p"), qu.expanded(F.col("q")).alias("e")).collect()}
    assert rows["What is RAG?"].kind == "factual" and rows["compare a versus b"].kind == "comparative" and rows[""].kind == "factual"
    assert rows[""].c == [] and rows[""].p == [] and rows["how auth works, then why it fails"].p == ["how auth works?", "why it fails?"]
    assert [e.term for e in rows["how auth works, then why it fails"].e] == ["auth"]


def test_text_functions(spark):
    assert one(spark, tx.sentences(F.lit("A b. C! d?  E"))) == ["A b.", "C!", "d?", "E"]
    assert one(spark, tx.normal_name(F.lit(" GPT_4 (Turbo)  v-2 "))) == "gpt4 turbo v-2"
    assert one(spark, tx.version_base(F.lit("Model v1.2"))) == "model" and one(spark, tx.version_base(F.lit("plain"))) is None
    assert str(one(spark, temporal.parse_date(F.lit("on January 5, 2024")))) == "2024-01-05" and one(spark, temporal.parse_date(F.lit("2024-13-45"))) is None


def test_storage(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, v string, created int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "id int, v string, created int")
    assert sorted(map(tuple, storage.upsert(t, new, "id", ["created"]).collect())) == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]
    assert sorted(map(tuple, storage.upsert(t, new.limit(0), "id").collect())) == sorted(map(tuple, t.collect()))


def test_vector_top_k_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query array<float>")
    assert [r.doc_id for r in retrieval.vector_top_k(v, q, 2).orderBy("rank").collect()] == [1, 3]
    assert retrieval.vector_top_k(v.limit(0), q).count() == 0


def test_files(spark, tmp_path):
    from tidepool.sources import files

    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.pdf").write_bytes(b"\xff\x00")
    got = {r.extension: r.text for r in files.load_files(spark, str(tmp_path)).collect()}
    assert got == {"txt": "héllo", "pdf": None}


def test_stream_equals_batch(spark, sf):
    from tidepool.plans import QUERIES

    key = lambda df: sorted((r.doc_id, r.chunk_index, r.content) for r in df.collect())
    assert key(QUERIES["stream_chunks"](spark, sf)) == key(QUERIES["chunk_standard"](spark, sf))


def test_presets_do_not_outlive_their_request():
    from tidepool.operators.config import PRESETS, FusionConfig, preset

    base = FusionConfig()
    assert preset("code_search").vector_weight == 0.9 and base.vector_weight == 0.7
    assert base.with_(vector_weight=0.25).graph_weight == 0.75
    assert all(preset(n).vector_weight + preset(n).graph_weight == pytest.approx(1) for n in PRESETS)
    for bad in ({"vector_weight": 2}, {"nothing": 1}):
        with pytest.raises(ValueError, match="weight|unknown"):
            base.with_(**bad)


@pytest.mark.parametrize(("text", "expected"), [
    ("Dr. Who met Mrs.Smith. They left at 3.5 pm. ok then. Yes!", ["Dr. Who met Mrs. Smith.", "They left at 3.5 pm. ok then.", "Yes!"]),
    ("See http://a.b/c. Next line etc. More", ["See http://a.b/c. Next line etc. More."]),
    ("Heading\n\nText goes on. End", ["Heading.", "Text goes on.", "End"]),
    ("A title", ["A title"]), ("", []), ("x", []), (None, None),
])
def test_protected_sentences(spark, text, expected):
    assert one(spark, tx.protected_sentences(F.lit(text).cast("string"))) == expected


def test_level_chunks():
    body = " ".join(f"{'word ' * 10}end{i}." for i in range(12))
    rows = chunking.level_rows(1, f"lost\n# A\nshort.\n## B\n{body}\n# C\nfine.", 60)
    kinds = {r[2]: (r[3], r[4], r[5]) for r in rows}
    assert kinds["1_chunk_0"] == (None, 1, "section") and kinds["1_chunk_1"] == ("1_chunk_0", 2, "header") and kinds["1_chunk_2"] == (None, 1, "section")
    parts = [r for r in rows if r[5] == "part"]
    assert len(parts) > 3 and all(r[3] == "1_chunk_1" for r in parts) and all(f"end{i}." in " ".join(r[7] for r in parts) for i in range(12))
    assert parts[1][7].split()[:11] == parts[0][7].split()[-22:-11], "two sentences overlap"
    assert [r[4] for r in chunking.level_rows(1, "1. One\nx\n1.1. Two\ny")] == [1, 2]
    assert chunking.level_rows(1, "") == [] and chunking.level_rows(1, "plain words " * 6)[0][5] == "group"


# --- whole retrievals and what queries are turned into --------------------------------------------------------------------------


def test_requests_without_hits_say_so(spark):
    from tidepool.operators import pipelines

    requests = spark.createDataFrame([(1, "explain widgets", [1.0, 0.0]), (2, "nothing", [0.0, 1.0])], "query_id long, query string, embedding array<float>")
    chunks = spark.createDataFrame([(5, "All about widgets", [1.0, 0.1]), (6, None, [0.5, 0.5])], "doc_id long, content string, embedding array<float>")
    entities = spark.createDataFrame([(1, "Widgets", "thing", 3), (2, "Gadget", "thing", None)], "id long, name string, type string, frequency long")
    edges = spark.createDataFrame([(1, 2, 0.9)], "src long, dst long, weight double")
    got = pipelines.answer_requests(requests, chunks, entities, edges).collect()
    first = {r.source: r.content for r in got if r.query_id == 1 and r.final_rank <= 2}
    assert first["vector"] == "All about widgets" and "Entity: Widgets (Type: thing)" in {r.content for r in got if r.query_id == 1}
    assert "Entity: Gadget (Type: thing)" in {r.content for r in got if r.query_id == 1}, "one hop from the entity named"
    empty = pipelines.answer_requests(requests, chunks.limit(0), entities.limit(0), edges.limit(0)).collect()
    assert {(r.query_id, r.source, r.final_rank, r.content) for r in empty} == {(i, "system", 1, pipelines.NO_RESULTS) for i in (1, 2)}


def test_queries_in_blocks_find_the_same(spark):
    from tidepool.operators.retrieval import vector_top_k

    vectors = spark.range(60).selectExpr("id as doc_id", "array(cast(id % 7 as float), cast(id % 5 as float), 1f) as embedding")
    asked = vectors.selectExpr("doc_id as query_id", "embedding as query")
    rows = lambda block: sorted(map(tuple, vector_top_k(vectors, asked, 3, block=block).select("query_id", "doc_id", "rank").collect()))
    assert rows(7) == rows(1000) and len(rows(7)) == 180


def test_enhanced_retrieval_takes_the_best_of_the_parts(spark):
    from tidepool.operators import pipelines
    from tidepool.operators.config import FusionConfig

    requests = spark.createDataFrame([(1, "alpha then beta before gamma and delta?", [1.0, 0.0])], "query_id long, query string, embedding array<float>")
    docs = spark.createDataFrame([(1, "alpha alpha"), (2, "beta words"), (3, "delta"), (4, "none")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<float>")
    ages = docs.selectExpr("doc_id", "'values' as doc_type", "0 as age_days")
    got = pipelines.retrieve_enhanced(requests, vectors, docs, ages, FusionConfig()).orderBy("final_rank").collect()
    assert [r.doc_id for r in got][0] == 1 and {r.doc_id for r in got} == {1, 2, 3}
    best = 0.4 / 61 + 0.3 / 61
    assert abs(got[0].score - (0.7 * best + 0.3)) < 1e-6


def test_variations_and_reasoning(spark):
    from pyspark.sql import functions as F

    from tidepool.operators import queries as qu

    rows = spark.createDataFrame([("How do I update the api config?",), ("compare auth and login, then explain it, before that and these",), ("",)], "q string").select(qu.enhanced(F.col("q")).alias("e"), qu.needs_multi_hop(F.col("q")).alias("m")).collect()
    assert rows[0].e.variations[:3] == ["How do I update the api config?", "how do i update the interface config?", "how do i update the endpoint config?"] and len(rows[0].e.variations) == 7
    assert rows[1].e.sub_queries[0] == "What about compare auth?" and " → Then use results from (" in rows[1].e.reasoning_path
    assert rows[2].e.variations == [""] and rows[2].e.kind == "factual"


def test_temporal_metadata_of_texts_and_names(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from tidepool.functions import temporal

    rows = [("Created: 2024-01-15\nvalid until March 3, 2024", "a_v1.2_2023-05-06.txt"), ("Sprint 3 of nothing", "notes.md"), ("milestone: launch on 1/5/2030 or so", "x-20240131.txt"), ("", None), ("date: none\nupdated 2/3/2024", "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, f string").select(temporal.temporal_metadata(F.col("c"), F.col("f"), F.lit("2024-02-20").cast("timestamp"))).collect()]
    assert (got[0].created_at, got[0].expires_at, got[0].version, got[0].lifecycle_stage) == (datetime(2024, 1, 15), datetime(2024, 3, 3), "1.2", "active")
    assert (got[1].sprint, got[1].created_at, got[1].lifecycle_stage) == (3, datetime(2024, 1, 23), "current")
    assert (got[2].milestone, got[2].expires_at, got[2].created_at, got[2].lifecycle_stage) == ("launch on 1/5/2030 or so", datetime(2030, 1, 5), datetime(2024, 1, 31), "active")
    assert got[3].created_at is None and got[3].lifecycle_stage is None


# --- against brute force ---------------------------------------------------------------------------------------------------------


def test_candidates_lose_no_match(spark):
    import difflib
    import random

    from tidepool.operators import graph

    rng = random.Random(3)
    names = {"RAG", "retrieval augmented generation", "GPT-4", "gpt-5", "GPT 3.5", "LLM tools", "a large language model"}
    for _ in range(60):
        base = "".join(rng.choice("abcde ") for _ in range(rng.randrange(3, 14))).strip() or "x"
        names |= {base, base + rng.choice("xyz"), base[1:] or base, base.title()}
    rows = [(n, t) for n in sorted(names) for t in rng.choice([["a"], ["b"], ["a", "b"]])]
    df = spark.createDataFrame(rows, "name string, type string")
    found = {tuple(r) for r in graph.match_candidates(df).collect()}
    for a, s in rows:
        for b, t in rows:
            if a < b and (difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.7):
                assert (a, s, b, t) in found, (a, b)
    kinds = {(r.a_name, r.b_name): r.kind for r in graph.match_kind(graph.match_candidates(df)).collect()}
    assert kinds["GPT-4", "gpt-5"] == "SIMILAR_TO" and kinds["RAG", "retrieval augmented generation"] == "ABBREVIATION_OF"
    assert len(found) < len(rows) ** 2 / 2


def _beams(edges, start, hops, width):
    queue, seen, done = [([start], 1.0, 1.0)], {start}, []
    while queue:
        path, rel, conf = queue.pop(0)
        if len(path) == hops + 1:
            done.append((tuple(path), round(rel, 9), conf))
            continue
        fresh = sorted(((-w, d, c) for s, d, w, c in edges if s == path[-1] and d not in seen))
        seen |= {d for _, d, _ in fresh}
        for w, d, c in fresh[:width]:
            queue.append(([*path, d], rel * -w, min(conf, c)))
    return sorted(done)


def test_beams_equal_a_sequential_search(spark):
    import random

    from tidepool.operators import graph

    rng = random.Random(1)
    edges = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(70)})
    edges = [(a, b, rng.randrange(1, 10) / 10, rng.randrange(5, 10) / 10) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "src long, dst long, relevance double, confidence double")
    for hops, width in ((3, 2), (2, 5), (3, 3)):
        got = graph.beam_search(df, spark.createDataFrame([(0,), (3,), (3,), (99,)], "id long"), hops, width).collect()
        for start in (0, 3):
            assert sorted((tuple(r.path), round(r.relevance, 9), r.confidence) for r in got if r.start == start) == _beams(edges, start, hops, width)
        assert {r.start for r in got} <= {0, 3}


def test_percentiles_equal_sorted_lists(spark):
    import random

    from tidepool.operators import evaluation

    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 5)) for _ in range(500)] + [("b", 3.0)] * 40 + [("c", float(i % 7)) for i in range(90)] + [("d", None), ("d", 1.0)]
    got = {r.g: (r.p0, r.p50, r.p99) for r in evaluation.percentiles_by_index(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}, parts=16).collect()}
    for g in "abcd":
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(own[int(len(own) * s)] for s in (0, 0.5, 0.99))


def test_names_in_texts(spark):
    from tidepool.operators import graph

    chunks = spark.createDataFrame([(1, "The Red fox"), (2, None), (3, "REDfoxes"), (4, "")], "chunk_id long, content string")
    entities = spark.createDataFrame([(1, "red"), (2, "Fox"), (3, "RED"), (4, ""), (5, None), (6, "x"), (7, "hen")], "entity_id long, name string")
    want = {(c, e) for c in (1, 3) for e in (1, 2, 3, 6)}
    assert {tuple(r) for r in graph.entity_in_chunk(chunks, entities).collect()} == want
    assert graph.entity_in_chunk(chunks, entities.limit(0)).count() == 0


def test_tree_of_sections():
    from tidepool.operators.chunking import tree_rows

    text = "lost\n# A\npara one\n\npara two\n## B\n```python\nx = 1\n```\n| a | b |\n| 1 | 2 |\n\nend\n### C\n#### D\n##### E\n###### F\n# A\nagain\n"
    rows = tree_rows(1, "Doc", text, 800, 100)
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in rows] == [
        ("summary", "", None, 0, "Doc"), ("hierarchical", "/0", "/0", 1, "A"), ("code", "/0/1", "/0/1", 2, "B"), ("table", "/0/1", "/0/1", 2, "B"), ("hierarchical", "/0/1", "/0/1", 2, "B"), ("hierarchical", "/0", "/0", 1, "A"),
    ]
    assert rows[1][7] == "para one\n\npara two" and rows[2][7] == "```python\nx = 1\n```" and rows[3][7] == "| a | b |\n| 1 | 2 |" and rows[4][7] == "end"
    packed = [r for r in tree_rows(1, "t", "\n\n".join(f"word{i} " * 50 for i in range(8)), 200, 3) if r[2] == "hierarchical"]
    assert len(packed) > 2 and all(a[7].split()[-3:] == b[7].split()[:3] for a, b in zip(packed, packed[1:], strict=False))
    assert [r[2] for r in tree_rows(1, "t", "word " * 200)] == ["summary", "section", "hierarchical"]


def test_semantic_chunks_overlap_by_sentences_and_parts():
    from tidepool.operators.chunking import semantic_chunks

    short = [f"Sentence number {i} has a few words of its own here." for i in range(30)]
    chunks = semantic_chunks(short, 60, 30)
    assert len(chunks) > 3 and all(a.split(". ")[-1] in b for a, b in zip(chunks, chunks[1:], strict=False))
    assert " ".join(short).endswith(chunks[-1])
    long = semantic_chunks(["short one that is well over fifty characters long, certainly.", "w " * 900, "tail sentence that is again over fifty characters long."], 100, 20)
    assert long[0].startswith("short one") and long[-1].startswith("tail") and len(long) >= 3
    partial = semantic_chunks([("alpha beta gamma delta " * 9).strip() + ".", ("one two three four five " * 9).strip() + "."], 60, 40)
    assert partial[1].split()[0] != "one" and "one two" in partial[1]
    assert semantic_chunks([], 10, 2) == []


def test_overlap_of_neighbours():
    from tidepool.operators.evaluation import overlap_chars

    assert overlap_chars("First one here. A shared sentence here", "A shared sentence here. More") == len("A shared sentence here")
    assert overlap_chars("", "x") == 0 and overlap_chars("abc def", "nothing shared at all") == 0
    assert overlap_chars("tiny. a b c d", "b c d e") == len("b c d")
