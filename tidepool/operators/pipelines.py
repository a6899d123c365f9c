"""Whole retrievals composed of the other operators, for batches of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepool.functions import scoring, temporal
from tidepool.operators import fusion, graph, queries as qu
from tidepool.operators.config import FusionConfig
from tidepool.operators.retrieval import keyword_search, ranked, vector_top_k
from tidepool.operators.skew import frontier_join
from tidepool.session import stored

NO_RESULTS = "No relevant documents found. Try adjusting your query or uploading more documents."


def answer_requests(requests: DataFrame, chunks: DataFrame, entities: DataFrame, edges: DataFrame, top_k: int = 10, budget: float = 8000, least_weight: float = 0.3) -> DataFrame:
    """The live query path: (query_id, final_rank, source, match, ranking, content) of each request.

    Vector hits (three times ``top_k``) and entities (five, and two that walks from the best two reach) get a match score each, are fused
    with weights by the wording of the request, cut to a token budget (walks cost 100 each) and to ``top_k``, and boosted by the words
    of the request. A request without hits gets one row that says so. Each entity counts once, by its best walk.

    ``requests``: query_id, query, embedding; ``chunks``: doc_id, content, embedding; ``entities``: id, name, type, frequency; ``edges``:
    src, dst, weight.
    """
    req = requests.withColumn("vector_weight", qu.vector_weight(F.col("query")))
    asked = req.select("query_id", "query", "vector_weight")
    found = vector_top_k(chunks.select("doc_id", "embedding"), req.select("query_id", F.col("embedding").alias("query")), 3 * top_k).select("query_id", "doc_id", "score", "rank")
    rows = found.join(chunks.select("doc_id", "content"), "doc_id").join(asked, "query_id")
    vector = rows.select(
        "query_id", F.lit("vector").alias("source"), (F.col("rank") - 1).alias("pos"), scoring.vector_match(F.col("query"), F.col("content"), F.col("score")).alias("match"),
        "content", F.lit(None).cast("int").alias("path_length"), F.col("vector_weight").alias("weight"),
    )

    most = min(5, top_k)
    named = graph.entity_lookup_batch(entities, asked, most)
    seeds = named.filter("rank <= 2").select("query_id", F.col("id").alias("seed"))
    paths = graph.weighted_paths(edges, seeds.select(F.col("seed").alias("id")).distinct(), entities.select("id", "frequency"), 2, least_weight)
    per_entity = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), F.desc("confidence"), "seed")
    walks = seeds.join(paths, "seed").withColumn("n", F.row_number().over(per_entity)).filter("n = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("confidence"), "id")
    walks = walks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= min(3, most // 2)).join(entities.select("id", "name", "type"), "id")
    counts = named.groupBy("query_id").agg(F.count("*").alias("n_named"))
    cost = walks.groupBy("query_id").agg((100 * F.count("*")).alias("cost"))
    columns = ["query_id", "pos", "name", "type", "match_type", "confidence", "path_length"]
    both = named.select("query_id", (F.col("rank") - 1).alias("pos"), "name", "type", "match_type", "confidence", F.lit(0).alias("path_length")).unionByName(
        walks.join(counts, "query_id").select("query_id", (F.col("n_named") + F.col("rank") - 1).cast("int").alias("pos"), "name", "type", F.lit("traversal").alias("match_type"), "confidence", F.col("hops").alias("path_length"))
    )
    hits = both.select(*columns).join(asked, "query_id")
    match = scoring.graph_match(F.col("query"), F.col("name"), F.col("match_type"), F.col("path_length"), F.col("confidence"), F.lit(0.0))
    content = F.concat(F.lit("Entity: "), "name", F.lit(" (Type: "), "type", F.lit(")"))
    entity = hits.select("query_id", F.lit("graph").alias("source"), "pos", match.alias("match"), content.alias("content"), "path_length", (1 - F.col("vector_weight")).alias("weight"))

    fused = fusion.rank_fusion(vector.unionByName(entity)).withColumn("nine", F.round("ranking", 9))
    listed = ranked(fused, ["query_id"], "nine", "key").join(cost, "query_id", "left")
    kept = fusion.api_budget(listed, budget - F.coalesce("cost", F.lit(0)), top_k).join(asked, "query_id")
    boost = F.when(F.count("*").over(Window.partitionBy("query_id")) > 1, scoring.rank_boost(F.col("query"), F.col("content"), F.lit(1.0))).otherwise(1.0)
    boosted = kept.withColumn("ranking", F.round(F.col("ranking") * boost, 9))
    final = ranked(boosted, ["query_id"], "ranking", "rank", "final_rank").select("query_id", "final_rank", "source", "match", "ranking", "content")
    empty = asked.join(final.select("query_id").distinct(), "query_id", "left_anti")
    return final.unionByName(empty.select("query_id", F.lit(1).alias("final_rank"), F.lit("system").alias("source"), F.lit(0.0).alias("match"), F.lit(None).cast("double").alias("ranking"), F.lit(NO_RESULTS).alias("content")))


def vector_only(requests: DataFrame, vectors: DataFrame, config: FusionConfig, contents: DataFrame | None = None) -> DataFrame:
    """(query_id, source, doc_id, score): the nearest vectors; diversified if ``contents`` (doc_id, content) are given and the settings ask for it; then the threshold."""
    found = vector_top_k(vectors, requests.select("query_id", F.col("embedding").alias("query")), config.vector_top_k).select("query_id", "doc_id", "score")
    if config.use_mmr and contents is not None:
        found = fusion.mmr_order(found.join(contents, "doc_id"), config.mmr_lambda)
    return found.filter(F.col("score") >= config.similarity_threshold).select("query_id", F.lit("vector").alias("source"), "doc_id", "score")


def graph_reach(requests: DataFrame, vectors: DataFrame, mentions: DataFrame, config: FusionConfig, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, depth, score): chunks of the entities in the best few chunks and of what they lead to, at their least depth, confidence / (depth + 1).

    ``mentions``: distinct (chunk_id, entity_id), chunk ids being those of the vectors. ``most``: a request whose levels so far hold so many
    chunks goes no deeper, since chunks further away score less than all it has; its ``most`` best rows are those of the whole walk.
    """
    pair, mentions = ["query_id", "entity_id"], stored(mentions.select("chunk_id", "entity_id"), "mentions")
    first = stored(vector_top_k(vectors, requests.select("query_id", F.col("embedding").alias("query")), min(5, config.vector_top_k // 4)).select("query_id", F.col("doc_id").alias("chunk_id")), "first")
    frontier = stored(frontier_join(mentions, first, ["chunk_id"], F.col("entity_id")).select(*pair).distinct(), "frontier")
    seen, found = frontier, None
    ends = most is not None and config.graph_confidence_threshold > 0
    for depth in range(config.graph_expansion_depth + 1):
        near = frontier_join(mentions, frontier, ["entity_id"], F.col("chunk_id")).select("query_id", "chunk_id").distinct()
        near = near if found is None else near.join(found, ["query_id", "chunk_id"], "left_anti")
        level = stored(near.withColumn("depth", F.lit(depth)), "level")
        found = level if found is None else found.unionByName(level)
        if depth < config.graph_expansion_depth:
            going = level.select("query_id", "chunk_id")
            if ends:
                going = going.join(found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") < most).select("query_id"), "query_id", "left_semi")
            going = stored(going, "going")
            # Chunks found before have had all their entities seen.
            frontier = stored(frontier_join(mentions, going, ["chunk_id"], F.col("entity_id")).select(*pair).distinct().join(seen, pair, "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), "depth", (F.lit(config.graph_confidence_threshold) / (F.col("depth") + 1)).alias("score"))


def graph_only(requests: DataFrame, vectors: DataFrame, mentions: DataFrame, config: FusionConfig) -> DataFrame:
    """(query_id, source, doc_id, score): the best rows of ``graph_reach``."""
    rows = ranked(graph_reach(requests, vectors, mentions, config, config.graph_top_k), ["query_id"]).filter(F.col("rank") <= config.graph_top_k)
    return rows.select("query_id", F.lit("graph").alias("source"), "doc_id", "score")


def merged(lists: DataFrame, config: FusionConfig) -> DataFrame:
    """Vector and graph lists (query_id, source, doc_id, score) merged as the settings say: weighted, reciprocal_rank or normalized."""
    weights = {"vector": config.vector_weight, "graph": config.graph_weight}
    if config.merge_strategy == "reciprocal_rank":
        return fusion.reciprocal_rank(lists)
    return fusion.weighted_merge(fusion.min_max(lists) if config.merge_strategy == "normalized" else lists, weights, config.duplicate_handling)


#: A re-ranker: from the columns of the request and of a text's first 512 characters to a column of its output (a logit), e.g. a pandas UDF around a model.
Reranker = Callable[[Column, Column], Column]


def reranked(score: Column, config: FusionConfig, rerank: Reranker | None) -> Column:
    """A score blended with the re-ranker's output on ``query`` and ``content``, if the settings ask for one and there is one; a row it says nothing of keeps its score."""
    if rerank is None or not config.use_reranker:
        return score
    logit = rerank(F.col("query"), F.substring("content", 1, 512))
    return F.coalesce(scoring.rerank_blend(score, logit, config.reranker_weight), score)


def retrieve(requests: DataFrame, vectors: DataFrame, mentions: DataFrame, chunks: DataFrame, config: FusionConfig, contents_for_mmr: DataFrame | None = None, rerank: Reranker | None = None) -> DataFrame:
    """(query_id, final_rank, doc_id, source, score, content): strategy by keywords, retrieval, tuning by place in the document, age, re-ranking, token budget, top k.

    ``chunks``: doc_id, content, chunk_type, has_section, has_parent, doc_type, age_days.
    """
    strategy = qu.strategy(F.col("query"), config.force_hybrid_threshold) if config.auto_strategy else F.lit("hybrid")
    req = requests.withColumn("strategy", strategy)
    v = vector_only(req.filter("strategy <> 'graph'"), vectors, config, contents_for_mmr)
    g = graph_only(req.filter("strategy <> 'vector'"), vectors, mentions, config)
    both = v.unionByName(g).join(req.select("query_id", "strategy"), "query_id")
    one = both.filter("strategy <> 'hybrid'").select("query_id", "doc_id", "score", "source")
    rows = one.unionByName(merged(both.filter("strategy = 'hybrid'").drop("strategy"), config).select("query_id", "doc_id", "score", "source"))
    rows = fusion.hierarchy_tuning(rows.join(chunks, "doc_id"), config.summary_boost if config.prioritize_summaries else 1.0, config.section_weight, config.parent_weight_boost)
    rows = rows.join(requests.select("query_id", "query"), "query_id")
    aged = temporal.temporal_mix(F.col("score"), temporal.decay(F.col("age_days"), F.col("doc_type")), temporal.temporal_weight(F.col("query")))
    listed = ranked(rows.withColumn("score", F.round(reranked(aged, config, rerank), 9)), ["query_id"])
    kept = fusion.context_budget(listed, config.context_budget).filter(F.col("rank") <= config.final_top_k)
    return kept.select("query_id", F.col("rank").alias("final_rank"), "doc_id", "source", "score", "content")


def retrieve_enhanced(
    requests: DataFrame, vectors: DataFrame, docs: DataFrame, ages: DataFrame, config: FusionConfig, vector_share: float = 0.4, keyword_share: float = 0.3,
    metadata: DataFrame | None = None, metadata_share: float = 0.3, rerank: Reranker | None = None,
) -> DataFrame:
    """(query_id, final_rank, doc_id, source, score, content): each part of a complex request is searched by vectors, keywords and metadata; of a row
    that several parts found the best counts; then age, re-ranking, budget and top k.

    ``docs``: doc_id, text; ``ages``: doc_id, doc_type, age_days; ``metadata``: query_id, doc_id, score, the rows that meet a request's filters.
    """
    parts = stored(requests.select("query_id", F.posexplode(qu.sub_queries(F.col("query"))).alias("part", "question")), "parts")
    kind = dict(requests.dtypes)["query_id"]
    key = F.struct("query_id", "part")
    words = keyword_search(docs, parts.select(F.to_json(key).alias("query_id"), F.col("question").alias("query")), config.vector_top_k)
    back = F.from_json("query_id", f"query_id {kind}, part int")
    words = words.select(back["query_id"].alias("query_id"), back["part"].alias("part"), F.lit("keyword").alias("source"), "doc_id", "score")
    lists = [("vector", vector_top_k(vectors, requests.select("query_id", F.col("embedding").alias("query")), config.vector_top_k))]
    if metadata is not None:
        lists.append(("metadata", metadata))
    rows = words
    for name, own in lists:  # the same for every part of a request
        rows = rows.unionByName(parts.select("query_id", "part").join(own.select("query_id", F.lit(name).alias("source"), "doc_id", F.col("score").cast("double").alias("score")), "query_id"))
    shares = {"vector": vector_share, "keyword": keyword_share, "metadata": metadata_share}
    fused = fusion.reciprocal_rank(rows.select(key.alias("query_id"), "source", "doc_id", "score"), shares)
    found = fused.select("query_id.query_id", F.col("query_id.part").alias("seq"), "doc_id", "score", "source")
    best = fusion.best_per_key(found, ["query_id", "doc_id"]).join(ages, "doc_id").join(requests.select("query_id", "query"), "query_id").join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    aged = temporal.temporal_mix(F.col("score"), temporal.decay(F.col("age_days"), F.col("doc_type")), temporal.temporal_weight(F.col("query")))
    listed = ranked(best.withColumn("score", F.round(reranked(aged, config, rerank), 9)), ["query_id"])
    kept = fusion.context_budget(listed, config.context_budget).filter(F.col("rank") <= config.final_top_k)
    return kept.select("query_id", F.col("rank").alias("final_rank"), "doc_id", "source", "score", "content")


def routed(requests: DataFrame, search: Callable[[DataFrame], DataFrame], reason: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, strategy_used, final_rank, doc_id, source, score, content): requests over several hops are answered by ``reason``, others by ``search``.

    ``search``: requests to the rows of ``retrieve_enhanced``; ``reason``: requests to those of ``multihop.answer_multi_hop``, whose answer is one row without a document.
    """
    marked = stored(requests.withColumn("_hops", qu.needs_multi_hop(F.col("query"))), "routed")
    plain = search(marked.filter("not _hops").drop("_hops"))
    found = plain.select("query_id", F.lit("hybrid_search").alias("strategy_used"), "final_rank", "doc_id", "source", "score", "content")
    answers = reason(marked.filter("_hops").drop("_hops"))
    kind = dict(plain.dtypes)["doc_id"]
    own = answers.select("query_id", F.lit("graph_rag").alias("strategy_used"), F.lit(1).alias("final_rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit("graph_rag").alias("source"), F.col("confidence").alias("score"), F.col("answer").alias("content"))
    return found.unionByName(own)
