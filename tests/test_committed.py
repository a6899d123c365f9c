"""Committed tables: states after writes, replays, conflicts and lost jobs, and what a commit touches."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators.committed import CommittedTable, Conflict, delete_document

SCHEMA = "id long, document_id string, text string, seq int"


@pytest.fixture()
def table(spark, tmp_path):
    return CommittedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], buckets=8)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_writes_and_a_replay_leave_one_state(spark, table):
    first = spark.createDataFrame([(i, f"d{i % 3}", f"a{i}", 0) for i in range(40)], SCHEMA)
    second = spark.createDataFrame([(i, "d9", f"b{i}", 1) for i in range(30, 50)] + [(30, "d9", "newer", 2)], SCHEMA)
    assert table.read().count() == 0
    one = table.upsert(first, ("ingest", 0))
    two = table.upsert(second, ("ingest", 1), newest=[F.desc("seq")])
    want = sorted([(i, f"d{i % 3}", f"a{i}", 0) for i in range(30)] + [(i, "d9", "newer" if i == 30 else f"b{i}", 2 if i == 30 else 1) for i in range(30, 50)])
    assert _rows(table.read()) == want and (one, two) == (1, 2)
    for batch, df in ((0, first), (1, second)):
        assert table.upsert(df, ("ingest", batch)) == 2
    assert _rows(table.read()) == want and _rows(table.read(version=1)) == _rows(first)
    assert table.upsert(first, ("other", 0)) == 3, "another source has its own numbers"


def test_insert_keeps_what_is_there_and_keep_keeps_columns(spark, table):
    table.upsert(spark.createDataFrame([(1, "d", "old", 1), (2, "d", None, 1)], SCHEMA))
    new = spark.createDataFrame([(1, "d", "new", 2), (3, "d", "new", 2)], SCHEMA)
    table.upsert(new, replace=False)
    assert _rows(table.read()) == [(1, "d", "old", 1), (2, "d", None, 1), (3, "d", "new", 2)]
    table.upsert(spark.createDataFrame([(1, "e", "new", 5), (4, "e", "x", 5)], SCHEMA), keep=["seq"])
    assert [r for r in _rows(table.read()) if r[0] in (1, 4)] == [(1, "e", "new", 1), (4, "e", "x", 5)]


def test_random_histories_equal_a_dictionary(spark, table):
    rng, state = random.Random(4), {}
    for step in range(6):
        ids = rng.sample(range(30), 8)
        if step % 3 == 2:
            table.delete(spark.createDataFrame([(i,) for i in ids], "id long"), batch=("s", step))
            for i in ids:
                state.pop(i, None)
        else:
            rows = [(i, f"d{i % 4}", f"{step}-{i}", step) for i in ids]
            table.upsert(spark.createDataFrame(rows, SCHEMA), ("s", step))
            state |= {r[0]: r for r in rows}
        assert _rows(table.read()) == sorted(state.values()), step
    table.delete(spark.createDataFrame([("d1",)], "document_id string"), ["document_id"])
    assert _rows(table.read()) == sorted(r for r in state.values() if r[1] != "d1")
    before = table.manifest().version
    table.clear()
    assert table.read().count() == 0 and table.read(version=before).count() == len([r for r in state.values() if r[1] != "d1"])


def test_a_commit_rewrites_its_buckets_alone(spark, table):
    table.upsert(spark.createDataFrame([(i, "d", "x", 0) for i in range(200)], SCHEMA))
    old = table.manifest().buckets
    one = spark.createDataFrame([(7, "d", "y", 1)], SCHEMA)
    table.upsert(one)
    new = table.manifest().buckets
    assert len(old) == 8 and [b for b in new if new[b] != old[b]] == [str(b) for b in table.touched(one)] and len(table.touched(one)) == 1
    files = table.read(table.touched(one)).inputFiles()
    assert files and all(f"_bucket={table.touched(one)[0]}/" in f for f in files), "a read of one bucket opens no other"


def test_the_second_of_two_writers_is_told(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, "d", "x", 0)], SCHEMA))
    stale = table.manifest()
    table.upsert(spark.createDataFrame([(2, "d", "x", 0)], SCHEMA))
    monkeypatch.setattr(table, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(3, "d", "x", 0)], SCHEMA))
    monkeypatch.undo()
    assert [r[0] for r in _rows(table.read())] == [1, 2]


def test_a_job_that_dies_leaves_the_table_as_it_was(spark, table):
    table.upsert(spark.createDataFrame([(1, "d", "x", 0)], SCHEMA))
    bad = spark.range(20).select("id", F.lit("d").alias("document_id"), F.when(F.col("id") > 10, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("text"), F.lit(1).alias("seq"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad, ("b", 1))
    assert _rows(table.read()) == [(1, "d", "x", 0)] and table.manifest().applied == {}


def test_cascade_over_tables(spark, tmp_path):
    docs = CommittedTable(spark, f"file://{tmp_path}/docs", "document_id string, title string", ["document_id"], 4)
    chunks = CommittedTable(spark, f"file://{tmp_path}/chunks", "document_id string, chunk_id string", ["document_id", "chunk_id"], 4, spread=["document_id"])
    docs.upsert(spark.createDataFrame([(f"d{i}", "t") for i in range(6)], docs.schema))
    chunks.upsert(spark.createDataFrame([(f"d{i}", f"c{j}") for i in range(6) for j in range(3)], chunks.schema))
    gone = spark.createDataFrame([("d1",), ("d4",), ("d9",)], "document_id string")
    for _ in range(2):
        delete_document({"chunks": chunks, "documents": docs}, gone, ("delete", 1))
    assert [r[0] for r in _rows(docs.read())] == ["d0", "d2", "d3", "d5"] and {r[0] for r in _rows(chunks.read())} == {"d0", "d2", "d3", "d5"}
    assert chunks.manifest().version == 2
