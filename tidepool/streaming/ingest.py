"""Incremental ingest as Structured Streaming: new documents become rows of committed tables, search events become windowed statistics.

The reference has no streams; this is a new capability over the same operators. All state lies in committed tables: a micro-batch is a
commit under the query's name and the batch's number, so a batch that is replayed changes nothing, nothing is dropped for being late, and
what the tables hold doesn't depend on how the input was cut into batches or in which order it came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.functions.text import content_id
from tidepool.operators.chunking import chunk
from tidepool.operators.committed import CommittedTable
from tidepool.operators.graph import technical_entities
from tidepool.sources.files import chunk_id


def _run(stream: DataFrame, write, checkpoint: str, name: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def ingest_documents(stream: DataFrame, path: str, checkpoint: str, strategy: str = "standard") -> StreamingQuery:
    """Chunk each micro-batch of (doc_id, text) into its own folder of ``path``; a batch that is replayed overwrites it, so chunks are stored once."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = chunk(batch, strategy).withColumn("chunk_id", chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("content")))
        rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return _run(stream, write, checkpoint)


@dataclass
class Corpus:
    """``documents``: document_id (by content), doc_id (the least that has the content), text; ``chunks``: document_id, chunk_index, chunk_id, content, tokens; ``mentions``: document_id, chunk_id, key, name, type."""

    documents: CommittedTable
    chunks: CommittedTable
    mentions: CommittedTable

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = 64) -> Corpus:
        one = lambda name, schema, keys: CommittedTable(spark, f"{path}/{name}", schema, keys, buckets, spread=["document_id"])
        return cls(
            one("documents", "document_id string, doc_id bigint, text string", ["document_id"]), one("chunks", "document_id string, chunk_index int, chunk_id string, content string, tokens int", ["document_id", "chunk_index"]),
            one("mentions", "document_id string, chunk_id string, key string, name string, type string", ["document_id", "chunk_id", "key"]),
        )

    def links(self) -> DataFrame:
        """a_type, a_id, b_type, b_id, relation: documents contain chunks, chunks mention entities."""
        own = self.chunks.read().select(F.lit("document").alias("a_type"), F.col("document_id").alias("a_id"), F.lit("chunk").alias("b_type"), F.col("chunk_id").alias("b_id"), F.lit("contains").alias("relation"))
        named = self.mentions.read().select(F.lit("chunk").alias("a_type"), F.col("chunk_id").alias("a_id"), F.lit("entity").alias("b_type"), F.col("key").alias("b_id"), F.lit("mentions").alias("relation"))
        return own.unionByName(named)

    def entities(self) -> DataFrame:
        """key, frequency (chunks that mention it) and the least of its names and types."""
        return self.mentions.read().groupBy("key").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.count_distinct("chunk_id").alias("frequency"))


def ingest_batch(corpus: Corpus, docs: DataFrame, batch: tuple[str, int], strategy: str = "standard") -> None:
    """Commit (doc_id, text) rows: documents, their chunks and what these mention. Texts that are there already add nothing; null texts are left out.

    Children are committed first, so a document that can be read has its chunks; a crash between two commits is mended by the replay.
    """
    new = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).groupBy(content_id(F.col("text")).alias("document_id")).agg(F.min(F.struct("doc_id", "text")).alias("x")).select("document_id", "x.doc_id", "x.text")
    known = corpus.documents.read(corpus.documents.touched(new)).select("document_id")
    fresh = new.join(known, "document_id", "left_anti")
    pieces = chunk(fresh, strategy).join(fresh.select("doc_id", "document_id"), "doc_id")
    rows = pieces.withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("content"))).select("document_id", "chunk_index", "chunk_id", "content", "tokens")
    corpus.chunks.upsert(rows, batch)
    own = corpus.chunks.read(corpus.chunks.touched(new)).join(fresh.select("document_id"), "document_id", "left_semi")
    found = technical_entities(own).join(own.select("chunk_id", "document_id"), "chunk_id").withColumn("key", F.lower("name"))
    corpus.mentions.upsert(found.select("document_id", "chunk_id", "key", "name", "type"), batch)
    corpus.documents.upsert(new, batch, newest=[F.asc("doc_id")], across=True)


def ingest_corpus(stream: DataFrame, corpus: Corpus, checkpoint: str, name: str = "ingest", strategy: str = "standard") -> StreamingQuery:
    """``ingest_batch`` of every micro-batch of (doc_id, text)."""
    return _run(stream, lambda batch, epoch: ingest_batch(corpus, batch.persist(), (name, epoch), strategy), checkpoint)


LATENCY = "start timestamp, strategy string, n bigint, total double, max_value double"


def latency_table(spark: SparkSession, path: str, buckets: int = 16) -> CommittedTable:
    return CommittedTable(spark, path, LATENCY, ["start", "strategy"], buckets)


def windowed_latency(events: DataFrame, width: str = "1 day") -> DataFrame:
    """start, strategy, n, total, max_value: tumbling windows of some events (ts, event_type, value)."""
    w = F.window(F.col("ts").cast("timestamp"), width)
    return events.groupBy(w.alias("w"), F.col("event_type").alias("strategy")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("max_value")).select(F.col("w.start").alias("start"), "strategy", "n", "total", "max_value")


def store_latency(stream: DataFrame, table: CommittedTable, checkpoint: str, name: str = "latency", width: str = "1 day") -> StreamingQuery:
    """Add each micro-batch's windows to the table. However late an event is, it corrects the window it belongs to; no state is held between batches."""
    sums = {"n": F.sum("n"), "total": F.sum("total"), "max_value": F.max("max_value")}
    return _run(stream, lambda batch, epoch: table.add(windowed_latency(batch, width), sums, (name, epoch)) and None, checkpoint)
