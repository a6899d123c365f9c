"""Names inside texts against all pairs."""

import random

from tidepool.operators import containment, graph


def test_contained_equals_all_pairs(spark):
    rng = random.Random(8)
    alphabet = ["a", "b", "ab", "é", "日本", " ", "graph", "c"]
    texts = [(i, "".join(rng.choices(alphabet, k=rng.randrange(0, 60)))) for i in range(120)] + [(200, None), (201, "graph"), (202, "x" * 40_000 + "needle in it" + "y" * 10)]
    names = sorted({"".join(rng.choices(alphabet, k=k)) for k in (1, 1, 1, 2, 2, 3, 4, 6, 9) for _ in range(12)} | {"needle in it", "", "absent name", "xyyyyyyyyyy"})
    got = containment.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in [*names, "a"]], "name string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, n) for i, t in texts if t is not None for n in names if n and n in t)


def test_windows_reach_over_the_pieces_of_a_long_text(spark):
    text = "z" * ((1 << 20) - 4) + "abcdefghij" + "z" * 50
    got = containment.contained(spark.createDataFrame([(1, text)], "id long, text string"), spark.createDataFrame([("abcdefghij",), ("zabcdef",)], "name string")).collect()
    assert sorted(r.name for r in got) == ["abcdefghij", "zabcdef"]


def test_lookups_of_many_requests(spark):
    entities = [(1, "Graph", "t", 5), (2, "graph database", "t", None), (3, "vector", "t", 2), (4, "VECTOR", "t", 9), (5, None, "t", 1)]
    asked = [(1, "a Graph database and a vector"), (2, "graph"), (3, "nothing"), (4, None)]
    got = graph.entity_lookup_batch(spark.createDataFrame(entities, "id long, name string, type string, frequency int"), spark.createDataFrame(asked, "query_id long, query string"), 3).collect()
    want = {1: [(4, "contained_by"), (1, "contained_by"), (3, "contained_by")], 2: [(1, "exact"), (2, "contains")]}
    assert {q: [(r.id, r.match_type) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in got}} == want


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert containment.contained(none, spark.createDataFrame([("a",)], "name string")).count() == 0
    assert containment.contained(spark.createDataFrame([(1, "a")], none.schema), spark.createDataFrame([("",)], "name string")).count() == 0
