"""Joins and frontiers that don't depend on how often one key occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of ids and numbers that may be broadcast once they are counted (some 20 MB).
FEW_ROWS = 200_000


def hot_keys(rows: DataFrame, keys: list[str], part: int = 1000) -> DataFrame:
    """The keys that hold more than 1 / ``part`` of all rows: fewer than ``part`` of them."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).filter(F.col("_n") * part > F.col("_all")).select(*keys)


def dealt_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 32) -> DataFrame:
    """``big`` joined with ``small``; a key with very many rows of ``big`` is dealt over ``salts`` tasks by ``spread``, its rows of ``small`` are repeated for each."""
    hot = hot_keys(big, keys).withColumn("_hot", F.lit(True))
    left = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def frontier_join(edges: DataFrame, frontier: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """``edges`` met with a stored ``frontier``: broadcast where its counted rows are few, so that hubs stay dealt as they were read; else dealt over salts."""
    if frontier.count() <= FEW_ROWS:
        return edges.join(F.broadcast(frontier), keys)
    return dealt_join(edges, frontier, keys, spread)
