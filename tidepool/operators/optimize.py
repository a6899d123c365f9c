"""Comparison of fusion settings over lists that are retrieved once."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepool.functions import scoring


def settings_grid(spark: SparkSession, weights: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9), rerank: tuple[bool, ...] = (True, False), depths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(setting, vector_weight, use_reranker, depth): every combination, numbered in order."""
    rows = [(i, w, r, d) for i, (w, r, d) in enumerate(product(weights, rerank, depths))]
    return spark.createDataFrame(rows, "setting int, vector_weight double, use_reranker boolean, depth int")


def compare_settings(settings: DataFrame, vector: DataFrame, graph: DataFrame, truth: DataFrame, queries: DataFrame, logits: DataFrame | None = None, k: int = 10, graph_k: int = 15, reranker_weight: float = 0.5) -> DataFrame:
    """(setting, vector_weight, use_reranker, depth, precision, recall, f1, place): means over ``queries`` (query_id), the best f1 first, then the first setting.

    Each list row meets the settings that read it (a few dozen, broadcast), is weighted and merged there, duplicates by their best score,
    and blended with the re-ranker's output where there is one and the setting uses it. ``vector``: query_id, doc_id, score; ``graph``: the
    same with depth, the distance at which the row was first found (a list of one depth is the start of that of the next); ``truth``:
    query_id, doc_id; ``logits``: query_id, doc_id, logit.
    """
    own = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    lists = vector.select("query_id", "doc_id", "score", F.lit(None).cast("int").alias("found")).unionByName(
        graph.withColumn("rank", own).filter(F.col("rank") <= graph_k).select("query_id", "doc_id", "score", F.col("depth").alias("found"))
    )
    if logits is not None:
        lists = lists.join(logits.select("query_id", "doc_id", "logit"), ["query_id", "doc_id"], "left")
    else:
        lists = lists.withColumn("logit", F.lit(None).cast("double"))
    rows = lists.join(F.broadcast(settings), F.col("found").isNull() | (F.col("found") <= F.col("depth")))
    weight = F.when(F.col("found").isNull(), F.col("vector_weight")).otherwise(1 - F.col("vector_weight"))
    one = rows.groupBy("setting", "query_id", "doc_id").agg(F.max(F.col("score") * weight).alias("score"), F.max("logit").alias("logit"), F.first("use_reranker").alias("use"))
    final = F.round(F.when(F.col("use") & F.col("logit").isNotNull(), scoring.rerank_blend(F.col("score"), F.col("logit"), reranker_weight)).otherwise(F.col("score")), 9)
    order = Window.partitionBy("setting", "query_id").orderBy(F.desc("final"), "doc_id")
    best = one.withColumn("final", final).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    hits = best.join(truth.select("query_id", "doc_id", F.lit(1).alias("hit")).distinct(), ["query_id", "doc_id"], "left").groupBy("setting", "query_id").agg(F.count("*").alias("got"), F.count("hit").alias("hits"))
    wanted = truth.distinct().groupBy("query_id").agg(F.count("*").alias("wanted"))
    asked = F.broadcast(settings).crossJoin(queries.select("query_id").distinct().join(wanted, "query_id", "left")).join(hits, ["setting", "query_id"], "left")
    share = lambda n, of: F.coalesce(F.col(n) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))
    p, r = share("hits", "got"), share("hits", "wanted")
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    means: list[Column] = [F.avg(c).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"))]
    out = asked.groupBy(*settings.columns).agg(*means)
    place = F.row_number().over(Window.orderBy(F.desc(F.round("f1", 9)), "setting"))  # a row for each setting
    return out.withColumn("place", place)
