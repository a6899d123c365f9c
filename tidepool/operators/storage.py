"""Upserts, merges and deletes as DataFrames: each returns the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def upsert(table: DataFrame, changes: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``changes`` replace those with their key; columns in ``keep`` (created_at) stay as they were."""
    keep = keep or []
    old = table.select(key, *(F.col(c).alias(f"_old_{c}") for c in keep))
    new = changes.join(old, key, "left").select(*(F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in table.columns))
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(new)


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, foreign: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those in ``gone`` (key)."""
    return parents.join(gone, key, "left_anti"), children.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")


def merge_edges(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges whose ends both exist, one for each (src, type, dst), the last by seq."""
    ends = nodes.select(node).distinct()
    kept = edges.join(ends.withColumnRenamed(node, "src"), "src", "left_semi").join(ends.withColumnRenamed(node, "dst"), "dst", "left_semi")
    return latest(kept, ["src", "type", "dst"], "seq", "weight")


def orphans(entities: DataFrame, contains: DataFrame, document: DataFrame) -> DataFrame:
    """Entities of the deleted documents that no other document contains."""
    own = contains.join(document, "document_id", "left_semi").select("entity_id").distinct()
    others = contains.join(document, "document_id", "left_anti").select("entity_id")
    return entities.join(own, "entity_id", "left_semi").join(others, "entity_id", "left_anti")


def upsert_vectors(store: DataFrame, chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store with chunks and their vectors put in place of rows of their key. A chunk without a vector, or the reverse, is an error."""
    both = chunks.join(vectors.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "full_outer")
    checked = both.withColumn(key, F.when(F.col(key).isNull() | F.col("_key").isNull(), F.raise_error(F.lit("chunks and vectors don't match"))).otherwise(F.col(key)))
    return upsert(store, checked.select(*store.columns), key)


def delete_vectors(store: DataFrame, gone: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store without rows whose ``key`` (a chunk or a document) is in ``gone``."""
    return store.join(gone.select(key).distinct(), key, "left_anti").select(*store.columns)


def refresh_payload(store: DataFrame, mentions: DataFrame, nodes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store with sorted entity_ids and graph_node_ids of each chunk. ``mentions``: chunk_id, entity_id; ``nodes``: chunk_id, node_id."""
    sets = lambda rows, c, name: rows.groupBy(key).agg(F.sort_array(F.collect_set(c)).alias(name))
    return store.join(sets(mentions, "entity_id", "entity_ids"), key, "left").join(sets(nodes, "node_id", "graph_node_ids"), key, "left")


def clear(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table emptied, and (table, n): how many rows it had."""
    counts = None
    for name, df in tables.items():
        own = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        counts = own if counts is None else counts.unionByName(own)
    return {name: df.limit(0) for name, df in tables.items()}, counts
