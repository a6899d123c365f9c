"""Streams into committed tables: any cut and order of the input, late rows, replays and crashes leave what one batch leaves."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.streaming import ingest

TEXTS = ["PyTorch and a vector database. Redis is used. " * 12, "the BERT model on AWS", "nothing to see here", "GPT-4 and few-shot retrieval. " * 40, "", "PyTorch and a vector database. Redis is used. " * 12]


def _rows(df):
    return sorted(map(str, df.collect()))


def _state(corpus):
    return {n: _rows(getattr(corpus, n).read()) for n in ("documents", "chunks", "mentions")} | {"entities": _rows(corpus.entities()), "links": _rows(corpus.links().distinct())}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    rows = [(i, TEXTS[i % len(TEXTS)] if i < 6 else rng.choice(TEXTS) + f" number {i % 5}") for i in range(24)] + [(90, None), (3, TEXTS[1])]
    return rows


def test_any_cut_and_order_leaves_one_state(spark, docs, tmp_path):
    whole = ingest.Corpus.at(spark, f"file://{tmp_path}/whole", 4)
    ingest.ingest_batch(whole, spark.createDataFrame(docs, "doc_id long, text string"), ("a", 0))
    want = _state(whole)
    assert len(want["documents"]) == len({t for _, t in docs if t is not None}) and want["mentions"]
    rng = random.Random(3)
    mixed = docs[:]
    rng.shuffle(mixed)
    cut = ingest.Corpus.at(spark, f"file://{tmp_path}/cut", 4)
    for epoch, at in enumerate(range(0, len(mixed), 9)):
        part = spark.createDataFrame(mixed[at : at + 9], "doc_id long, text string")
        ingest.ingest_batch(cut, part, ("a", epoch))
        ingest.ingest_batch(cut, part, ("a", epoch))
    assert _state(cut) == want


def test_a_crash_between_commits_is_mended_by_the_replay(spark, docs, tmp_path, monkeypatch):
    df = spark.createDataFrame(docs[:10], "doc_id long, text string")
    corpus, want = ingest.Corpus.at(spark, f"file://{tmp_path}/c", 4), ingest.Corpus.at(spark, f"file://{tmp_path}/w", 4)
    ingest.ingest_batch(want, df, ("a", 0))
    monkeypatch.setattr(corpus.mentions, "upsert", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        ingest.ingest_batch(corpus, df, ("a", 0))
    assert corpus.documents.read().count() == 0 and corpus.chunks.read().count() > 0
    monkeypatch.undo()
    ingest.ingest_batch(corpus, df, ("a", 0))
    assert _state(corpus) == _state(want)


def test_late_events_correct_their_windows(spark, tmp_path):
    events = [(f"2024-01-{d:02d} {h:02d}:00:00", t, float(d * h)) for d in (20, 21, 11, 20) for h in (1, 5) for t in ("a", "b")]
    df = spark.createDataFrame(events, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, day in enumerate(("20", "21", "11")):  # the last file is ten days older
        df.filter(F.date_format("ts", "dd") == day).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    table = ingest.latency_table(spark, f"file://{tmp_path}/latency", 2)
    for i in range(3):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/[0-{i}]")
        ingest.store_latency(stream, table, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert _rows(table.read()) == _rows(ingest.windowed_latency(df).select(table.schema.names))
    before = table.manifest().version
    table.add(ingest.windowed_latency(df), {"n": F.sum("n"), "total": F.sum("total"), "max_value": F.max("max_value")}, ("latency", 0))
    assert table.manifest().version == before, "a replayed batch adds nothing"
