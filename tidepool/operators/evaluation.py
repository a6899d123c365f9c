"""Retrieval quality and corpus analytics."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepool import values


def precision_recall(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: precision (over the length of the list), recall and F1 (over distinct ids); 0 where there is nothing to divide by."""
    hits = retrieved.select("query_id", "doc_id").distinct().join(truth.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    got = retrieved.groupBy("query_id").agg(F.count("*").alias("n"))
    want = truth.groupBy("query_id").agg(F.count_distinct("doc_id").alias("m"))
    all_ = got.join(want, "query_id", "full_outer").join(hits, "query_id", "left").select("query_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "m", "hits")))
    p, r = F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "m"), F.lit(0.0))
    return all_.select("query_id", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def macro(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def histogram(value: Column) -> Column:
    return F.when(value < 100, "<100").when(value < 500, "100-500").when(value < 1000, "500-1000").otherwise(">=1000")


def percentiles_by_index(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], parts: int = 256) -> DataFrame:
    """The value at index floor(share * n) of each sorted group, not interpolated.

    Values are dealt into ``parts`` ranges by their group's bounds and counted, so that it is known which range holds each index; only the
    rows of those ranges are ranked. No task sorts a whole group unless its values are all alike, and equal values are counted, not kept.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    bounds = counted.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), F.lit(parts - 1))).otherwise(0)
    dealt = counted.join(bounds, by).withColumn("_part", part)
    sizes = dealt.groupBy(*by, "_part").agg(F.sum("_c").alias("_size"), F.first("_n").alias("_n"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.array(*(F.floor(F.col("_n") * s).cast("long") for s in shares.values()))
    held = sizes.withColumn("_before", before).filter(F.exists(wanted, lambda i: (i >= F.col("_before")) & (i < F.col("_before") + F.col("_size")))).select(*by, "_part", "_before")
    upto = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    placed = dealt.join(held, [*by, "_part"]).withColumn("_upto", upto)
    at = lambda s: F.floor(F.col("_n") * s).cast("long")
    return placed.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") > at(s), F.col("_v"))).alias(name) for name, s in shares.items()))


def source_distribution(rows: DataFrame) -> DataFrame:
    """Per source: count, share in percent, mean score."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).crossJoin(F.broadcast(total)).select("source", "n", (100 * F.col("n") / F.col("total")).alias("percent"), "mean_score")


def source_overview(rows: DataFrame) -> DataFrame:
    """Per request: rows by source, their shares in percent, mean scores, and the source that the first three rows mostly have (ties: vector, graph, hybrid).

    ``rows``: query_id, rank, source, score.
    """
    kinds = ("vector", "graph", "hybrid")
    n = lambda k, where=F.lit(True): F.sum(((F.col("source") == k) & where).cast("long"))
    first = [n(k, F.col("rank") <= 3).alias(f"_top_{k}") for k in kinds]
    out = rows.groupBy("query_id").agg(F.count("*").alias("n"), *(n(k).alias(f"n_{k}") for k in kinds), F.avg("score").alias("mean_score"), *(F.coalesce(F.avg(F.when(F.col("source") == k, F.col("score"))), F.lit(0.0)).alias(f"mean_{k}") for k in kinds[:2]), *first)
    most = F.greatest(*(F.col(f"_top_{k}") for k in kinds))
    top = F.when(F.col("_top_vector") == most, "vector").when(F.col("_top_graph") == most, "graph").otherwise("hybrid")
    return out.select("query_id", "n", *(f"n_{k}" for k in kinds), *((100 * F.col(f"n_{k}") / F.col("n")).alias(f"percent_{k}") for k in kinds), "mean_score", "mean_vector", "mean_graph", top.alias("top_source"))


def results_summary(rows: DataFrame) -> DataFrame:
    """Per request: rows by source, mean score, distinct documents and entities (nulls and '' aside). ``rows``: query_id, source, score, document_id, entity_id."""
    n = lambda k: F.sum((F.col("source") == k).cast("long")).alias(f"n_{k}")
    distinct = lambda c: F.count_distinct(F.when(F.col(c).cast("string") != "", F.col(c)))
    return rows.groupBy("query_id").agg(n("vector"), n("graph"), n("hybrid"), F.avg("score").alias("mean_score"), distinct("document_id").alias("documents"), distinct("entity_id").alias("entities"))


def graded_density(entities: Column, tokens: Column) -> Column:
    """Struct of entities per 1,000 tokens and verdict: PASS from 15 to 30, WARN above 0, else FAIL."""
    rate = F.coalesce(F.try_divide(1000 * entities, tokens), F.lit(0.0))
    return F.struct(rate.alias("per_1k"), F.when(rate.between(15, 30), "PASS").when(rate > 0, "WARN").otherwise("FAIL").alias("verdict"))


def overlap_chars(before: str, after: str) -> int:
    """Characters that a chunk repeats of the one before it: a sentence of its end, else a string of its end, else its last words."""
    cut = lambda t: [s.strip() for s in re.split(r"[.!?]+", t) if s.strip()]
    shared = [len(s) for s in cut(before)[-3:] if len(s) > 10 and any(s in x or x in s for x in cut(after)[:3])]
    if shared:
        return max(shared)
    for n in range(min(100, len(before) // 4), 10, -5):
        if before[-n:] in after[: 2 * n]:
            return n
    x, y = before.split(), after.split()
    return next((len(" ".join(x[-n:])) for n in range(min(20, len(x), len(y)), 2, -1) if x[-n:] == y[:n]), 0)


def chunk_overlap(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, percent): how much of the chunk before it each chunk repeats. ``chunks``: doc_id, chunk_index, content."""

    @F.pandas_udf("double")
    def percent(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([100.0 * overlap_chars(x, y) / len(x) if x else 0.0 for x, y in zip(before.fillna(""), after.fillna(""), strict=True)])

    last = F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    pairs = chunks.select("doc_id", "chunk_index", last.alias("_before"), "content").filter("chunk_index > 0")
    return pairs.select("doc_id", "chunk_index", percent("_before", "content").alias("percent"))


def reasoning_quality(steps: Column, confidence: Column, answer_relevance: Column) -> Column:
    """Mean of path validity (share of steps surer than 0.5), answer relevance (a hook's; null: 0), confidence and support (steps / 3, at most 1)."""
    valid = F.coalesce(F.try_divide(F.size(F.filter(steps, lambda c: c > 0.5)), F.size(steps)), F.lit(0.0))
    return (valid + F.coalesce(answer_relevance, F.lit(0.0)) + confidence + F.least(F.lit(1.0), F.size(steps) / 3)) / 4


def boundary_fault(content: Column) -> Column:
    """Half a point each for a chunk that starts or ends inside a sentence; 0 for others and null for blank ones. Chunks that start with a relative word continue an overlap."""
    text = F.trim(content)
    starts = text.rlike(values.GOOD_START) | reduce(lambda a, b: a | b, (F.startswith(text, F.lit(w)) for w in values.CONTINUED))
    ends = text.rlike(values.GOOD_END)
    return F.when(F.length(text) > 0, 0.5 * ((~starts).cast("int") + (~ends).cast("int")))


def boundary_preservation(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, rate, verdict): the share of sound boundaries of non-blank chunks, 1 - faults / chunks: PASS from .95, WARN from .8. ``chunks``: content and the columns of ``by``."""
    rows = chunks.withColumn("fault", boundary_fault(F.col("content"))).groupBy(*by).agg(F.count("fault").alias("n"), F.sum("fault").alias("faults"))
    rate = F.when(F.col("n") > 0, 1 - F.col("faults") / F.nullif(F.col("n"), F.lit(0))).otherwise(0.0)
    return rows.withColumn("rate", rate).withColumn("verdict", F.when(F.col("rate") >= 0.95, "PASS").when(F.col("rate") >= 0.8, "WARN").otherwise("FAIL")).drop("faults")
