"""Fusion of ranked lists, and the cuts that follow. Lists are rows (query_id, source, doc_id, score[, rank])."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepool.operators.retrieval import ranked

KEYS = ["query_id", "doc_id"]


def _source(rows_source: Column) -> Column:
    """The list's name, or 'hybrid' if several lists had the row."""
    return F.when(F.count_distinct(rows_source) > 1, "hybrid").otherwise(F.min(rows_source))


def reciprocal_rank(lists: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """Sum of weight / (k + rank) over the lists that have a row."""
    weight = F.lit(1.0) if weights is None else F.coalesce(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("source")], F.lit(0.0))
    rows = ranked(lists, ["query_id", "source"])
    return rows.groupBy(*KEYS).agg(F.sum(weight / (k + F.col("rank"))).alias("score"), _source(F.col("source")).alias("source"))


def weighted_merge(lists: DataFrame, weights: dict[str, float], how: str = "max") -> DataFrame:
    """Weighted scores; rows of several lists keep the max, average or sum."""
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("source")]
    fold = {"max": F.max, "average": F.avg, "sum": F.sum}[how]
    return lists.withColumn("score", F.col("score") * weight).groupBy(*KEYS).agg(fold("score").alias("score"), _source(F.col("source")).alias("source"))


def min_max(lists: DataFrame, flat: float | None = None) -> DataFrame:
    """Scores of each list scaled to 0..1. A list of equal scores becomes ``flat``, by default 0."""
    w = Window.partitionBy("query_id", "source")
    span = F.max("score").over(w) - F.min("score").over(w)
    scaled = F.when(span == 0, F.lit(0.0 if flat is None else flat)).otherwise((F.col("score") - F.min("score").over(w)) / F.nullif(span, F.lit(0.0)))
    return lists.withColumn("score", scaled)


def best_per_key(rows: DataFrame, keys: list[str], score: str = "score", seq: str = "seq") -> DataFrame:
    """The best-scored row of each key; equal scores keep the first seen."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rank_fusion(rows: DataFrame, weights: dict[str, float] | None = None, mode: str = "merge") -> DataFrame:
    """Match and ranking scores of vector and graph rows, merged by the first 100 characters of their content.

    ``rows``: query_id, source, pos (0-based in its list), match, content, path_length, and weight if no ``weights`` by source are given. Ranking is match * weight / (1 + 0.1 pos), a
    direct graph hit 1.2 times that. In merge mode the first row of a key (vector rows first) takes the best match of all and half
    the ranking of the others, and is 'hybrid' if a later row came from the graph. The other modes drop later vector duplicates
    (prefer_graph) or later graph duplicates (prefer_vector).
    """
    weight = F.col("weight") if weights is None else F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("source")]
    direct = F.when((F.col("source") == "graph") & (F.coalesce("path_length", F.lit(0)) == 0), 1.2).otherwise(1.0)
    rows = rows.withColumns({"ranking": F.col("match") * weight / (1 + 0.1 * F.col("pos")) * direct, "key": F.lower(F.substring("content", 1, 100)), "seq": F.struct(F.when(F.col("source") == "vector", 0).otherwise(1).alias("s"), F.col("pos").alias("p"))})
    order = Window.partitionBy("query_id", "key").orderBy("seq")
    rows = rows.withColumn("nth", F.row_number().over(order))
    if mode != "merge":
        drop = "vector" if mode == "prefer_graph" else "graph"
        return rows.filter((F.col("nth") == 1) | (F.col("source") != drop)).select("query_id", "key", "match", "ranking", "source", "content")
    first = F.col("nth") == 1
    return rows.groupBy("query_id", "key").agg(
        F.max("match").alias("match"),
        (F.max(F.when(first, F.col("ranking"))) + 0.5 * F.coalesce(F.sum(F.when(~first, F.col("ranking"))), F.lit(0.0))).alias("ranking"),
        F.when(F.max(F.when(~first & (F.col("source") == "graph"), 1)) == 1, "hybrid").otherwise(F.max(F.when(first, F.col("source")))).alias("source"),
        F.max(F.when(first, F.col("content"))).alias("content"),
    )


def hierarchy_tuning(rows: DataFrame, summary: float = 1.2, section: float = 1.1, parent: float = 1.05) -> DataFrame:
    """Boosts by place in the document's tree, at most 1. ``rows``: chunk_type, has_section, has_parent, score."""
    factor = F.when(F.col("chunk_type") == "summary", summary).otherwise(1.0) * F.when(F.col("has_section"), section).otherwise(1.0) * F.when(F.col("has_parent"), parent).otherwise(1.0)
    return rows.withColumn("score", F.least(F.lit(1.0), F.col("score") * factor))


def context_budget(rows: DataFrame, budget: float = 8000, least: float = 100) -> DataFrame:
    """The prefix of each list that fits a token budget (words * 1.3).

    The first row that overflows is cut to the words that fit, with '...', if more than ``least`` tokens are left; all later rows go.
    ``rows``: query_id, rank, content.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    split = F.filter(F.split("content", r"\s+"), lambda x: x != "")
    rows = rows.withColumn("tokens", F.size(split) * 1.3)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("over", (F.col("before") + F.col("tokens") > budget).cast("int"))
    rows = rows.withColumn("n_over", F.sum("over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = F.concat(F.array_join(F.slice(split, F.lit(1), F.greatest(F.floor((budget - F.col("before")) / 1.3).cast("int"), F.lit(0))), " "), F.lit("..."))
    keep = (F.col("n_over") == 0) | ((F.col("over") == 1) & (F.col("n_over") == 1) & (budget - F.col("before") > least))
    return rows.filter(keep).withColumn("content", F.when(F.col("over") == 1, cut).otherwise(F.col("content"))).drop("before", "over", "n_over")


def api_budget(rows: DataFrame, budget: float | Column = 8000, top_k: int = 10, per_row: float = 50) -> DataFrame:
    """Rows before the first overflow of words * 1.3 + 50 tokens each, then the first ``top_k``."""
    w = Window.partitionBy("query_id").orderBy("rank")
    total = F.sum(F.size(F.filter(F.split("content", r"\s+"), lambda x: x != "")) * 1.3 + per_row).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", total).filter((F.col("running") <= budget) & (F.col("rank") <= top_k)).drop("running")


def mmr_order(rows: DataFrame, lam: float = 0.7) -> DataFrame:
    """Every row of each short list in the order of maximal marginal relevance, by word Jaccard. ``rows``: query_id, doc_id, score, content."""
    kinds = dict(rows.dtypes)

    def order(group: pd.DataFrame) -> pd.DataFrame:
        left = group.sort_values(["score", "doc_id"], ascending=[False, True]).to_dict("records")
        sets = {id(r): set((r["content"] or "").lower().split()) for r in left}
        chosen: list[dict] = []
        near = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        while left:
            value = lambda r: lam * r["score"] - (1 - lam) * max((near(sets[id(r)], sets[id(c)]) for c in chosen), default=0.0)
            best = max(left, key=value) if chosen else left[0]
            left.remove(best)
            chosen.append(best)
        return pd.DataFrame([(r["query_id"], r["doc_id"], r["score"], i + 1) for i, r in enumerate(chosen)], columns=["query_id", "doc_id", "score", "mmr_rank"])

    return rows.groupBy("query_id").applyInPandas(order, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, mmr_rank int")

