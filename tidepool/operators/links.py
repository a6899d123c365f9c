"""Typed id links and walks over them. Walks have a fixed depth, so their plans are a fixed number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidepool.operators import paths, queries
from tidepool.operators.retrieval import ranked, vector_top_k
from tidepool.operators.skew import FEW_ROWS, frontier_join
from tidepool.session import stored

LINK = ["a_type", "a_id", "b_type", "b_id", "relation"]


def add_links(links: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Links in both directions, each once. Rows whose relation is null are unique as well."""
    if bidirectional:
        swapped = links.select(F.col("b_type").alias("a_type"), F.col("b_id").alias("a_id"), F.col("a_type").alias("b_type"), F.col("a_id").alias("b_id"), "relation")
        links = links.select(*LINK).unionByName(swapped)
    return links.select(*LINK).dropDuplicates(LINK)


def make_links(rows: DataFrame, a_type: str, a: str, b_type: str, b: str, relation: str) -> DataFrame:
    return rows.select(F.lit(a_type).alias("a_type"), F.col(a).cast("string").alias("a_id"), F.lit(b_type).alias("b_type"), F.col(b).cast("string").alias("b_id"), F.lit(relation).alias("relation"))


def traverse(links: DataFrame, kind: str, id_: str) -> DataFrame:
    """(type, ids): what an id is linked with in either direction, by type, sorted."""
    out = links.filter((F.col("a_type") == kind) & (F.col("a_id") == id_)).select(F.col("b_type").alias("type"), F.col("b_id").alias("id"))
    back = links.filter((F.col("b_type") == kind) & (F.col("b_id") == id_)).select(F.col("a_type").alias("type"), F.col("a_id").alias("id"))
    return out.union(back).groupBy("type").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def related_entities(mentions: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """(seed, entity, depth): entities that share chunks with a seed over at most ``max_depth`` steps, each at its least depth, never the seed.

    ``mentions``: distinct (chunk_id, entity_id). ``seeds``: (entity_id).
    """
    seen = seeds.select(F.col("entity_id").alias("seed"), "entity_id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, max_depth + 1):
        chunks = frontier.join(mentions, "entity_id").select("seed", "chunk_id").distinct()
        near = chunks.join(mentions, "chunk_id").select("seed", "entity_id").distinct()
        frontier = near.join(seen.select("seed", "entity_id"), ["seed", "entity_id"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0").select("seed", "entity_id", "depth")


def retrieve_from_seeds(mentions: DataFrame, seeds: DataFrame, confidence: float = 0.6, max_depth: int = 2) -> DataFrame:
    """(chunk_id, score): chunks of the seeds and what they lead to, confidence / (depth + 1), best per chunk."""
    reached = related_entities(mentions, seeds, max_depth).select("entity_id", "depth").unionByName(seeds.select("entity_id", F.lit(0).alias("depth")))
    nearest = reached.groupBy("entity_id").agg(F.min("depth").alias("depth"))
    return nearest.join(mentions, "entity_id").groupBy("chunk_id").agg(F.max(confidence / (F.col("depth") + 1)).alias("score"))


def retrieve_bounded(mentions: DataFrame, seeds: DataFrame, confidence: float = 0.6, max_depth: int = 2, max_nodes: int = 100) -> DataFrame:
    """(query_id, chunk_id, score): chunks of each request's seeds (depth 0) and of what they lead to at depths under ``max_depth``, confidence / (depth + 1), best per chunk.

    A level is entered only if the levels before it hold fewer than ``max_nodes`` nodes of the request; it is then taken whole. ``seeds``:
    query_id, entity_id; ``mentions``: distinct (chunk_id, entity_id).
    """
    seen = stored(seeds.select("query_id", "entity_id").distinct().withColumn("depth", F.lit(0)), "seen")
    frontier = seen
    for depth in range(1, max_depth):
        full = seen.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= max_nodes).select("query_id")
        going = stored(frontier.join(full, "query_id", "left_anti").select("query_id", "entity_id"), "going")
        chunks = stored(frontier_join(mentions, going, ["entity_id"], F.col("chunk_id")).select("query_id", "chunk_id").distinct(), "chunks")
        near = frontier_join(mentions, chunks, ["chunk_id"], F.col("entity_id")).select("query_id", "entity_id").distinct()
        frontier = stored(near.join(seen.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return frontier_join(mentions, stored(seen, "seen"), ["entity_id"], F.col("chunk_id")).groupBy("query_id", "chunk_id").agg(F.max(confidence / (F.col("depth") + 1)).alias("score"))


def graph_search(requests: DataFrame, entities: DataFrame, mentions: DataFrame, k: int = 10, confidence: float = 0.6, max_depth: int = 2, max_nodes: int = 100) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks by the entities that a request's words name, and by what those lead to. ``requests``: query_id, query; ``entities``: id, name."""
    named = requests.select("query_id", F.explode(F.array_distinct(F.transform(queries.entities(F.col("query")), lambda x: F.lower(x)))).alias("key"))
    seeds = named.join(entities.select(F.lower("name").alias("key"), F.col("id").alias("entity_id")), "key").select("query_id", "entity_id")
    return ranked(retrieve_bounded(mentions, seeds, confidence, max_depth, max_nodes), ["query_id"], "score", "chunk_id").filter(F.col("rank") <= k)


def explore(edges: DataFrame, seeds: DataFrame, max_hops: int = 2, limit: int = 10, most_seeds: int = 3) -> DataFrame:
    """(query_id, place, seed, entity_id, distance): what each request's first few seeds lead to, each seed's nearest ``limit`` in turn, cut to ``limit`` in all. An entity that two seeds lead to stays twice.

    ``seeds``: query_id, pos, entity_id; ``edges``: src, dst.
    """
    first = seeds.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "entity_id"))).filter(F.col("turn") <= most_seeds)
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).union(edges.select("dst", "src")).filter("at <> to").distinct()
    near = paths.levels(step, first.select(F.col("entity_id").alias("start")), max_hops).filter("d > 0")
    nearest = near.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("d", "node"))).filter(F.col("n") <= limit)
    rows = first.join(nearest, first.entity_id == nearest.start)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "n"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select("query_id", "place", F.col("start").alias("seed"), F.col("node").alias("entity_id"), F.col("d").alias("distance"))


def add_and_count(links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with ``new`` ones added in both directions, and a row with the number of those asked for, there before or not."""
    return add_links(links.select(*LINK).unionByName(add_links(new)), bidirectional=False), new.agg(F.count("*").alias("n"))


def ingest_links(chunks: DataFrame) -> DataFrame:
    """All links of documents' chunks. ``chunks``: document_id, chunk_id, parent_id, vector_id, entity_ids, node_ids; nulls link nothing."""
    entity = chunks.select("document_id", "chunk_id", F.explode("entity_ids").alias("entity_id"))
    node = chunks.select("chunk_id", F.explode("node_ids").alias("node_id"))
    parts = [
        make_links(chunks, "document", "document_id", "chunk", "chunk_id", "contains"), make_links(entity, "document", "document_id", "entity", "entity_id", "mentions"),
        make_links(chunks, "chunk", "chunk_id", "vector", "vector_id", "embeds"), make_links(entity, "chunk", "chunk_id", "entity", "entity_id", "mentions"),
        make_links(node, "chunk", "chunk_id", "graph_node", "node_id", "represents"), make_links(chunks, "chunk", "chunk_id", "chunk", "parent_id", "parent"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return add_links(rows.filter(F.col("a_id").isNotNull() & F.col("b_id").isNotNull()), bidirectional=False)


def nodes_of_vectors(vectors: DataFrame, mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(vector_id, chunk_id, entity_ids, node_ids): each vector's first chunk and what it is linked with; vectors without a chunk go.

    ``vectors``: vector_id, chunk_id; ``mentions``: chunk_id, entity_id; ``nodes``: chunk_id, node_id.
    """
    own = vectors.groupBy("vector_id").agg(F.min("chunk_id").alias("chunk_id")).filter("chunk_id is not null")
    asked = own.select("chunk_id").distinct()
    grouped = lambda rows, key, name: rows.join(asked, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.sort_array(F.collect_set(key)).alias(name))
    joined = own.join(grouped(mentions, "entity_id", "entity_ids"), "chunk_id", "left").join(grouped(nodes, "node_id", "node_ids"), "chunk_id", "left")
    return joined.select("vector_id", "chunk_id", *(F.coalesce(c, F.array()).alias(c) for c in ("entity_ids", "node_ids")))


def chunks_of_search(vectors: DataFrame, queries_: DataFrame, owners: DataFrame, mentions: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vector_id, chunk_id, score, entity_ids, node_ids): the best vectors of each request with their chunk and what it is linked with; a vector without a chunk stands for itself.

    ``vectors``: doc_id, embedding; ``owners``: vector_id, chunk_id; ``mentions``: chunk_id, entity_id; ``nodes``: chunk_id, node_id.
    """
    best = vector_top_k(vectors, queries_, k).withColumnRenamed("doc_id", "vector_id")
    own = best.join(owners.groupBy("vector_id").agg(F.min("chunk_id").alias("chunk_id")), "vector_id", "left").withColumn("chunk_id", F.coalesce("chunk_id", "vector_id"))
    own = stored(own, "hits")
    asked = own.select("chunk_id").distinct()
    sets = lambda rows, c, name: rows.join(F.broadcast(asked) if asked.count() <= FEW_ROWS else asked, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.sort_array(F.collect_set(c)).alias(name))
    joined = own.join(sets(mentions, "entity_id", "entity_ids"), "chunk_id", "left").join(sets(nodes, "node_id", "node_ids"), "chunk_id", "left")
    return joined.select("query_id", "rank", "vector_id", "chunk_id", "score", *(F.coalesce(c, F.array()).alias(c) for c in ("entity_ids", "node_ids")))


def expand_seeds(mentions: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(entity_id, distance, weight): entities within ``depth`` steps of any seed, seeds left out; weight 1 / distance."""
    near = related_entities(mentions, seeds, depth).groupBy("entity_id").agg(F.min("depth").alias("distance"))
    return near.join(seeds.select("entity_id").distinct(), "entity_id", "left_anti").select("entity_id", "distance", (1 / F.col("distance")).alias("weight"))


def hybrid_scores(vector: DataFrame, graph: DataFrame, vector_weight: float = 0.7) -> DataFrame:
    """(chunk_id, score): vector scores and the best weight of graph rows that hold the chunk, a missing side counting 0. ``graph``: chunk_ids, weight."""
    best = graph.select(F.explode("chunk_ids").alias("chunk_id"), F.coalesce("weight", F.lit(0.5)).alias("w")).groupBy("chunk_id").agg(F.max("w").alias("w"))
    both = vector.select("chunk_id", "score").join(best, "chunk_id", "full_outer")
    return both.select("chunk_id", (vector_weight * F.coalesce("score", F.lit(0.0)) + (1 - vector_weight) * F.coalesce("w", F.lit(0.0))).alias("score"))
