"""Registered queries that run as streams over the tables' files and end when all of them are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepool.plans.registry import query
from tidepool.session import scratch, table
from tidepool.streaming import ingest


@query(
    "stream_latency",
    "select date_trunc('day', ts) as day, event_type as strategy, count(*) as n, round(avg(value), 6) as mean_value, max(value) as max_value from events group by 1, 2",
)
def stream_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows over the event stream, added up in a committed table by each micro-batch."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    where = scratch(spark, "stream")
    store = ingest.latency_table(spark, f"{where}/latency")
    ingest.store_latency(stream, store, f"{where}/checkpoint").awaitTermination()
    mean = F.round(F.col("total") / F.col("n"), 6)
    return store.read().select(F.col("start").cast("timestamp_ntz").alias("day"), "strategy", "n", mean.alias("mean_value"), "max_value")


@query(
    "stream_corpus",
    "select substr(md5(text), 1, 12) as document_id, min(doc_id) as doc_id, min(length(text)) as n_chars from documents where text is not null group by 1",
)
def stream_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by content, from a stream that is then replayed from its start; chunks and mentions are committed with them."""
    schema = table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/documents.parquet*")
    where = scratch(spark, "stream")
    corpus = ingest.Corpus.at(spark, f"{where}/corpus", 16)
    for run in range(2):
        ingest.ingest_corpus(stream.select("doc_id", "text"), corpus, f"{where}/checkpoint{run}").awaitTermination()
    return corpus.documents.read().select("document_id", "doc_id", F.length("text").alias("n_chars"))


@query("stream_chunks")
def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents chunked by a stream; the rows equal those of chunk_standard."""
    schema = table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*")
    where = scratch(spark, "stream")
    ingest.ingest_documents(stream, f"{where}/chunks", f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/chunks").select("doc_id", "chunk_index", "content", "tokens")
