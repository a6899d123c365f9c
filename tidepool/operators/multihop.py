"""Answers by reasoning over several hops: start entities, a beam per start, scored paths, their context and an answer, for many requests at once.

A hop is a few joins over all requests: the frontier meets the edges, relevance is computed for each (request, node) it reaches, and of
the frontier nodes that reach a node the first one (in the order of a queue) claims it. Claimed nodes count as visited from then on, kept
or not; each frontier node goes on to its best ``width`` claims. So what a queue would do one node at a time is a grouped minimum, and
no group is larger than a node's relevant neighbours. Frontiers, claims and paths are stored after each hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepool import values
from tidepool.functions import scoring
from tidepool.operators import graph
from tidepool.operators.retrieval import ranked, vector_top_k
from tidepool.operators.skew import frontier_join
from tidepool.session import stored

ONE_START = ["query_id", "start"]


def edge_relevance(reached: DataFrame, entities: DataFrame, queries: DataFrame | None) -> DataFrame:
    """``reached`` (query_id, dst, sure: the edge's confidence, ...) with ``relevance`` and the entity's ``name``: similarity of the request to the entity where both have vectors, and both confidences; nodes that are no entities go.

    Each (request, node) is compared once, however many edges lead there.
    """
    own = entities.select(F.col("id").alias("dst"), "name", F.col("confidence").alias("known"))
    similarity = F.lit(None).cast("double")
    if queries is not None:
        pairs = reached.select("query_id", "dst").distinct().join(entities.select(F.col("id").alias("dst"), F.col("embedding").alias("x")), "dst")
        pairs = pairs.join(queries.select("query_id", F.col("embedding").alias("y")), "query_id").select("query_id", "dst", scoring.cosine(F.col("y"), F.col("x")).alias("similarity"))
        reached, similarity = reached.join(pairs, ["query_id", "dst"], "left"), F.col("similarity")
    return reached.join(own, "dst").withColumn("relevance", F.round(scoring.relevance(similarity, F.col("known"), F.col("sure")), 9)).drop("known", "similarity")


def beam_paths(starts: DataFrame, edges: DataFrame, entities: DataFrame, queries: DataFrame | None = None, max_hops: int = 3, width: int = 5, threshold: float = 0.6) -> DataFrame:
    """Paths of exactly ``max_hops`` hops: query_id, start, place (in the order of the queue), nodes, names, edges (src, type, dst), relevance (product), confidence (least).

    ``starts``: query_id, id, name, confidence; ``edges``: src, dst, type, confidence (a node pair may have several; the most relevant counts, then the type that
    sorts first); ``entities``: id, name, confidence, and embedding if ``queries`` (query_id, embedding) are given. Relevance is rounded to nine digits; ties go to the smaller node.
    """
    link = "struct<src:{0},type:string,dst:{0}>".format(dict(starts.dtypes)["id"])
    first = starts.select("query_id", F.col("id").alias("start"), F.col("name"), F.col("confidence").cast("double").alias("confidence")).dropDuplicates(ONE_START)
    paths = stored(first.select("query_id", "start", F.lit(0).cast("long").alias("place"), F.array("start").alias("nodes"), F.array("name").alias("names"), F.array().cast(f"array<{link}>").alias("edges"), F.col("confidence").alias("relevance"), "confidence"), "paths")
    visited = paths.select(*ONE_START, F.col("start").alias("dst"))
    out = edges.select(F.col("src").alias("at"), "dst", "type", F.col("confidence").cast("double").alias("sure"))
    for hop in range(max_hops):
        frontier = paths.select(*ONE_START, "place", F.element_at("nodes", -1).alias("at"))
        reached = frontier_join(out, frontier, ["at"], F.col("dst")).join(visited, [*ONE_START, "dst"], "left_anti")
        reached = edge_relevance(stored(reached, "reached"), entities, queries).filter(F.col("relevance") >= threshold)
        claim = F.min(F.struct("place", (-F.col("relevance")).alias("minus"), "type", "at", "name"))
        claims = stored(reached.groupBy(*ONE_START, "dst").agg(claim.alias("c")).select(*ONE_START, "dst", "c.place", (-F.col("c.minus")).alias("by"), "c.type", "c.at", "c.name"), "claims")
        best = F.row_number().over(Window.partitionBy(*ONE_START, "place").orderBy(F.desc("by"), "dst"))
        kept = claims.withColumn("nth", best).filter(F.col("nth") <= width)
        new = paths.join(kept.drop("at", "name").join(claims.select(*ONE_START, "dst", "name", "at"), [*ONE_START, "dst"]), [*ONE_START, "place"])
        paths = stored(
            new.select(
                *ONE_START, (F.col("place") * width + F.col("nth") - 1).alias("place"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("names", F.col("name")).alias("names"),
                F.array_append("edges", F.struct(F.col("at").alias("src"), "type", "dst")).alias("edges"), (F.col("relevance") * F.col("by")).alias("relevance"), F.least("confidence", "by").alias("confidence"),
            ),
            "paths",
        )
        if hop + 1 < max_hops:
            visited = visited.unionByName(claims.select(*ONE_START, "dst"))
    return paths


def chain(names: Column, edges: Column) -> Column:
    """The path in words."""
    steps = F.transform(edges, lambda e, i: F.concat(F.lit(" → ["), e["type"], F.lit("] → "), F.get(names, i + 1)))
    return F.concat(F.lit("Starting from: "), F.get(names, F.lit(0)), F.array_join(steps, ""))


def start_points(requests: DataFrame, vectors: DataFrame, mentions: DataFrame, entities: DataFrame, chunks: int = 5, limit: int = 10) -> DataFrame:
    """query_id, id, name, confidence, rank: entities of each request's best ``chunks`` and those its words name, the surest first."""
    found = vector_top_k(vectors, requests.select("query_id", F.col("embedding").alias("query")), chunks)
    own = entities.select("id", "name", "confidence")
    near = found.join(mentions, found.doc_id == mentions.chunk_id).select("query_id", F.col("entity_id").alias("id")).distinct().join(own, "id").select("query_id", "id", "confidence")
    named = graph.entity_lookup_batch(entities.select("id", "name", F.lit("").alias("type"), F.lit(1).alias("frequency")), requests.select("query_id", "query"), 20).select("query_id", "id").join(own, "id").select("query_id", "id", "confidence")
    return ranked(graph.start_entities(near, named, limit), ["query_id"], "confidence", "id").join(own.select("id", "name"), "id")


def scored_paths(starts: DataFrame, paths: DataFrame, coherence: Column | None = None) -> DataFrame:
    """``paths`` with total, chain and rank in their request; ``coherence``: a caller's similarity of the path to the request, if it has one."""
    total = F.round(scoring.path_score(F.col("nodes"), F.col("confidence"), coherence if coherence is not None else F.lit(None).cast("double")), 9)
    rows = paths.join(starts.select("query_id", F.col("id").alias("start"), F.col("rank").alias("turn")), ONE_START).withColumns({"total": total, "chain": chain(F.col("names"), F.col("edges"))})
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total"), "turn", "place")))


def answer_multi_hop(requests: DataFrame, vectors: DataFrame, mentions: DataFrame, entities: DataFrame, edges: DataFrame, chunks: DataFrame, max_hops: int = 3, width: int = 5, threshold: float = 0.6, semantic: bool = True, answer_from: int = 3) -> DataFrame:
    """query_id, answer, confidence, paths_explored, best_path, steps, context; one row for every request.

    ``requests``: query_id, query, embedding; ``vectors``: doc_id, embedding; ``mentions``: distinct (chunk_id, entity_id); ``entities``: id, name, confidence and,
    if ``semantic``, embedding; ``edges``: src, dst, type, confidence; ``chunks``: chunk_id, content.
    """
    starts = stored(start_points(requests, vectors, mentions, entities), "starts")
    paths = beam_paths(starts, edges, entities, requests.select("query_id", "embedding") if semantic else None, max_hops, width, threshold)
    best = stored(scored_paths(starts, paths).filter(F.col("rank") <= answer_from), "best")

    nodes = best.select(F.explode("nodes").alias("entity_id")).distinct()
    first = F.row_number().over(Window.partitionBy("entity_id").orderBy("chunk_id"))
    near = mentions.join(nodes, "entity_id").withColumn("pos", first - 1).filter("pos < 2").join(chunks, "chunk_id").select(F.col("entity_id").alias("id"), "pos", "chunk_id", "content")
    context = graph.path_contexts(best.select("query_id", "rank", "nodes", "chain"), near, answer_from)

    step = F.transform("edges", lambda e, i: F.struct((i + 1).alias("step"), F.get("names", i).alias("source"), e["type"].alias("relation"), F.get("names", i + 1).alias("target")))
    top = best.filter("rank = 1").select("query_id", graph.path_answer(F.col("chain"), F.col("edges"), F.col("confidence")).alias("answer"), F.col("total").alias("confidence"), F.col("chain").alias("best_path"), step.alias("steps"))
    counts = best.groupBy("query_id").agg(F.count("*").cast("int").alias("paths_explored"))
    begun = starts.select("query_id", F.lit(True).alias("begun")).distinct()
    rows = requests.select("query_id").join(begun, "query_id", "left").join(top, "query_id", "left").join(counts, "query_id", "left").join(context, "query_id", "left")
    nothing = F.when(F.col("begun"), F.lit(values.NO_PATHS)).otherwise(F.lit(values.NO_STARTS))
    return rows.select(
        "query_id", F.coalesce("answer", nothing).alias("answer"), F.coalesce("confidence", F.when(F.col("begun"), 0.3).otherwise(0.0)).alias("confidence"),
        F.coalesce("paths_explored", F.lit(0)).alias("paths_explored"), "best_path", F.coalesce("steps", F.array().cast("array<struct<step:int,source:string,relation:string,target:string>>")).alias("steps"), "context",
    )
