"""Registered queries: retrieval, fusion and scoring over documents and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepool.functions import scoring, temporal
from tidepool.operators import fusion, retrieval, vector_index
from tidepool.plans.registry import query, quoted
from tidepool.session import table

#: Requests: the first user turns of the conversations whose id is divisible by 100, and vectors whose id is.
REQUEST_SQL = "(select conv_id::BIGINT query_id, text as query from (select conv_id, text, row_number() over (partition by conv_id order by turn, text) n from conversations where role = 'user' and conv_id % 100 = 0) where n = 1)"
WEIGHTS = {"vector": 0.4, "keyword": 0.3, "metadata": 0.3}


def requests(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").filter("role = 'user' and conv_id % 100 = 0")
    return turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.min(F.struct("turn", "text"))["text"].alias("query"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")


def one_vector(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("query"))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def vectors_of_requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    req = requests(spark, sf).select("query_id")
    return req.join(e, e.vec_id == req.query_id % 500).select("query_id", F.col("embedding").alias("query"))


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(
    "hybrid_rrf",
    f"""
with req as (select * from {REQUEST_SQL}),
v as (select query_id, 'vector' source, e.vec_id doc_id, {COS} score from embeddings e, embeddings q, req where q.vec_id = query_id % 500 and exists (select 1 from documents d where d.doc_id = e.vec_id)),
vr as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from v qualify rank <= 20),
tok as (select doc_id, len(t)::DOUBLE doc_len, unnest(t) term from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') t from documents)),
want as (select query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) term from req),
n as (select count(*) n_docs, avg(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) mean_len from documents),
tf as (select term, doc_id, doc_len, count(*) tf from tok where term in (select term from want) group by all),
df as (select term, count(*) df from tf group by 1),
k as (select query_id, 'keyword' source, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))) score from tf join df using (term) join want using (term), n group by 1, 3),
kr as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from k qualify rank <= 20),
m as (select doc_id, row_number() over (order by doc_id) rank from documents where lang = 'en' and source = 'src3' qualify rank <= 10),
lists as (select query_id, source, doc_id, rank from vr union all select query_id, source, doc_id, rank from kr union all select query_id, 'metadata', doc_id, rank from m, req),
f as (select query_id, doc_id, sum(case source when 'vector' then 0.4 else 0.3 end / (60 + rank)) score, case when count(distinct source) > 1 then 'hybrid' else min(source) end source from lists group by 1, 2),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) final_rank from f qualify final_rank <= 10)
select query_id, doc_id, r.source as source, round(score, 6) as score, final_rank::INT as final_rank, d.lang as lang from r join documents d using (doc_id)""",
)
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: exact vectors, keywords and metadata, fused by weighted reciprocal ranks."""
    docs = table(spark, sf, "documents")
    fused = fusion.reciprocal_rank(three_lists(spark, sf), WEIGHTS).withColumn("nine", F.round("score", 9))
    best = retrieval.ranked(fused, ["query_id"], "nine", name="final_rank").filter("final_rank <= 10").join(docs.select("doc_id", "lang"), "doc_id")
    return best.select("query_id", "doc_id", "source", F.round("score", 6).alias("score"), "final_rank", "lang")


def three_lists(spark: SparkSession, sf: str) -> DataFrame:
    docs, req = table(spark, sf, "documents"), requests(spark, sf)
    v = retrieval.vector_top_k(vectors(spark, sf).join(docs.select("doc_id"), "doc_id", "left_semi"), vectors_of_requests(spark, sf), 20).select("query_id", F.lit("vector").alias("source"), "doc_id", "score")
    k = retrieval.keyword_search(docs, req, 20).select("query_id", F.lit("keyword").alias("source"), "doc_id", "score")
    m = retrieval.metadata_search(docs, {"lang": "en", "source": "src3"}).crossJoin(F.broadcast(req)).select("query_id", F.lit("metadata").alias("source"), "doc_id", "score")
    return v.unionByName(k).unionByName(m)


@query("vec_topk", f"select e.vec_id as doc_id, round({COS}, 6) as score, round(100 / (1 + exp(-5 * ({COS} - 0.5))), 4) as match from embeddings e, embeddings q where q.vec_id = 0 order by {COS} desc, e.vec_id limit 10")
def vec_topk(spark, sf):
    rows = retrieval.vector_top_k(vectors(spark, sf), one_vector(spark, sf), 10)
    return rows.select("doc_id", F.round("score", 6).alias("score"), F.round(100 * scoring.sigmoid(F.col("score")), 4).alias("match"))


@query("vec_topk_batch", f"select query_id, doc_id, round(s, 6) as score, rank from (select q.vec_id query_id, e.vec_id doc_id, {COS} s, row_number() over (partition by q.vec_id order by {COS} desc, e.vec_id)::INT rank from embeddings e, embeddings q where q.vec_id % 100 = 0) where rank <= 5")
def vec_topk_batch(spark, sf):
    return retrieval.vector_top_k(vectors(spark, sf), query_vectors(spark, sf), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("vec_index_search", f"select query_id, doc_id, round(s, 6) as score, rank from (select q.vec_id query_id, e.vec_id doc_id, {COS} s, row_number() over (partition by q.vec_id order by {COS} desc, e.vec_id)::INT rank from embeddings e, embeddings q where q.vec_id % 100 = 0 and {COS} >= 0.1) where rank <= 10")
def vec_index_search(spark, sf):
    """Every hundredth vector against a stored index of all of them."""
    index = vector_index.build(vectors(spark, sf), block_rows=64)
    return vector_index.search(index, query_vectors(spark, sf), 10, 0.1).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("vec_filtered_threshold", f"select query_id, doc_id, round(s, 6) as score, (rank - 2)::INT as rank from (select q.vec_id query_id, e.vec_id doc_id, {COS} s, row_number() over (partition by q.vec_id order by {COS} desc, e.vec_id) rank from embeddings e, embeddings q where q.vec_id % 100 = 0 and e.label = 1 and {COS} >= 0.05) where rank > 2 and rank <= 12")
def vec_filtered_threshold(spark, sf):
    rows = retrieval.vector_top_k(vectors(spark, sf), query_vectors(spark, sf), 10, F.col("label") == 1, 0.05, 2)
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), (F.col("rank") - 2).alias("rank"))


@query("vec_prefix_cosine", "select vec_id as doc_id, round(list_cosine_similarity(embedding[1:32]::DOUBLE[], (select embedding[1:32]::DOUBLE[] from embeddings where vec_id = 0)), 6) as score from embeddings")
def vec_prefix_cosine(spark, sf):
    q = one_vector(spark, sf)
    cut = vectors(spark, sf).select("doc_id", F.slice("embedding", 1, 32).alias("embedding"))
    return cut.crossJoin(F.broadcast(q)).select("doc_id", F.round(scoring.prefix_cosine(F.col("query"), F.col("embedding")), 6).alias("score"))


@query("vec_chunk_lookup", "select vec_id, label, len(embedding)::INT as dims from embeddings where vec_id = 7")
def vec_chunk_lookup(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 7").limit(1).select("vec_id", "label", F.size("embedding").alias("dims"))


@query("meta_search", "select doc_id, 1.0::DOUBLE as score from documents where lang = 'en' and source = 'src3' order by doc_id limit 10")
def meta_search(spark, sf):
    return retrieval.metadata_search(table(spark, sf, "documents"), {"lang": "en", "source": "src3"})


TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query("keyword_index", f"select term, doc_id, len(t)::INT as doc_len, count(*) as tf from (select doc_id, t, unnest(t) term from (select doc_id, {TOKENS.format('text')} t from documents)) group by all")
def keyword_index(spark, sf):
    return retrieval.inverted_index(table(spark, sf, "documents"))


def _lists_sql(tail: str) -> str:
    """Two lists for each language, full of ties: documents with a vector, by its label, and documents with a quality label."""
    return f"""with l as (select lang query_id, 'vector' source, doc_id, e.label::DOUBLE score from documents join embeddings e on e.vec_id = doc_id
union all select lang, 'graph', doc_id, (2 * quality + toxic) / 2.0::DOUBLE from documents join labels using (doc_id)) {tail}"""


def two_lists(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), "doc_id")
    v = docs.join(vectors(spark, sf), "doc_id").select("query_id", F.lit("vector").alias("source"), "doc_id", F.col("label").cast("double").alias("score"))
    g = docs.join(table(spark, sf, "labels"), "doc_id").select("query_id", F.lit("graph").alias("source"), "doc_id", ((2 * F.col("quality") + F.col("toxic")) / 2.0).cast("double").alias("score"))
    return v.unionByName(g)


SRC = "case when count(distinct source) > 1 then 'hybrid' else min(source) end as source"
RANKED = "r as (select *, row_number() over (partition by query_id, source order by score desc, doc_id) rank from l)"


@query("rrf_two", _lists_sql(f", {RANKED} select query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) as score, {SRC} from r group by 1, 2"))
def rrf_two(spark, sf):
    return fusion.reciprocal_rank(two_lists(spark, sf)).withColumn("score", F.round("score", 6))


@query("rrf_weighted", _lists_sql(f", {RANKED} select query_id, doc_id, round(sum(case source when 'vector' then 0.71 else 0.29 end / (60 + rank)), 6) as score, {SRC} from r group by 1, 2"))
def rrf_weighted(spark, sf):
    return fusion.reciprocal_rank(two_lists(spark, sf), {"vector": 0.71, "graph": 0.29}).withColumn("score", F.round("score", 6))


for how, sql in (("max", "max"), ("average", "avg"), ("sum", "sum")):
    query(f"merge_weighted_{how}", _lists_sql(f"select query_id, doc_id, round({sql}(score * case source when 'vector' then 0.7 else 0.3 end), 6) as score, {SRC} from l group by 1, 2"))(
        lambda spark, sf, how=how: fusion.weighted_merge(two_lists(spark, sf), {"vector": 0.7, "graph": 0.3}, how).withColumn("score", F.round("score", 6))
    )

NORM = "n as (select query_id, source, doc_id, case when max(score) over w = min(score) over w then {flat} else (score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0) end score from l window w as (partition by query_id, source))"


@query("merge_normalized", _lists_sql(f", {NORM.format(flat='0.0')} select query_id, doc_id, round(max(score * case source when 'vector' then 0.7 else 0.3 end), 6) as score, {SRC} from n group by 1, 2"))
def merge_normalized(spark, sf):
    return fusion.weighted_merge(fusion.min_max(two_lists(spark, sf)), {"vector": 0.7, "graph": 0.3}).withColumn("score", F.round("score", 6))


@query("minmax_half", _lists_sql(f", {NORM.format(flat='0.5')} select query_id, source, doc_id, round(score, 6) as score from n union all select source, 'flat', doc_id, 0.5 from documents"))
def minmax_half(spark, sf):
    flat = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.lit("flat").alias("source"), "doc_id", F.lit(3.0).alias("score"))
    return fusion.min_max(two_lists(spark, sf).unionByName(flat), 0.5).select("query_id", "source", "doc_id", F.round("score", 6).alias("score"))


@query("dedup_best", "select source, lang, doc_id, n_chars from documents qualify row_number() over (partition by source, lang order by n_chars desc, doc_id) = 1")
def dedup_best(spark, sf):
    return fusion.best_per_key(table(spark, sf, "documents"), ["source", "lang"], "n_chars", "doc_id").select("source", "lang", "doc_id", "n_chars")


Q = "the thing and on there"


@query(
    "match_vector",
    f"""with s as (select d.doc_id, lower(text) t, list_cosine_similarity(embedding::DOUBLE[], (select embedding::DOUBLE[] from embeddings where vec_id = 0)) c from documents d join embeddings e on e.vec_id = d.doc_id),
m as (select doc_id, round(least(100.0, 100 / (1 + exp(-5 * (c - 0.5))) + 20 * len(list_filter(list_distinct(string_split({quoted(Q)}, ' ')), lambda x: contains(t, x))) / 5.0 + case when contains(t, {quoted(Q)}) then 30 else 0 end), 1) as score from s)
select doc_id, score, case when score >= 90 then 'Excellent match' when score >= 75 then 'Strong match' when score >= 60 then 'Good match' when score >= 40 then 'Moderate match' when score >= 25 then 'Weak match' else 'Poor match' end as quality from m""",
)
def match_vector(spark, sf):
    q = one_vector(spark, sf).select("query")
    rows = table(spark, sf, "documents").join(vectors(spark, sf), "doc_id").crossJoin(F.broadcast(q))
    scored = rows.select("doc_id", scoring.vector_match(F.lit(Q), F.col("text"), scoring.cosine(F.col("embedding"), F.col("query"))).alias("score"))
    return scored.withColumn("quality", scoring.match_quality(F.col("score")))


def fusion_rows(spark, sf) -> DataFrame:
    docs, place = table(spark, sf, "documents"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1
    v = docs.join(vectors(spark, sf), "doc_id").withColumn("pos", place).select("lang", F.lit("vector").alias("source"), "pos", ((F.col("doc_id") * 7) % 100).cast("double").alias("match"), "text", F.lit(None).cast("int").alias("path_length"))
    g = docs.join(table(spark, sf, "labels"), "doc_id").withColumn("pos", place).select("lang", F.lit("graph").alias("source"), "pos", ((F.col("doc_id") * 13) % 100).cast("double").alias("match"), "text", F.col("toxic").alias("path_length"))
    return v.unionByName(g).withColumnsRenamed({"lang": "query_id", "text": "content"})


FUSION_SQL = """with l as (select lang q, 'vector' source, row_number() over (partition by lang order by doc_id) - 1 pos, (doc_id * 7 % 100)::DOUBLE m, lower(text[1:100]) k, null pl from documents join embeddings on vec_id = doc_id
union all select lang, 'graph', row_number() over (partition by lang order by doc_id) - 1, (doc_id * 13 % 100)::DOUBLE, lower(text[1:100]), toxic from documents join labels using (doc_id)),
r as (select q, source, k, m, m * case source when 'vector' then 0.7 else 0.3 end / (1 + 0.1 * pos) * case when source = 'graph' and coalesce(pl, 0) = 0 then 1.2 else 1 end ranking,
 row_number() over (partition by q, k order by source desc, pos) nth from l)"""


@query("rank_fusion", FUSION_SQL + " select q as query_id, md5(k) as key_id, max(m) as match, round(max(case when nth = 1 then ranking end) + 0.5 * coalesce(sum(case when nth > 1 then ranking end), 0), 6) as ranking, case when bool_or(nth > 1 and source = 'graph') then 'hybrid' else max(case when nth = 1 then source end) end as source from r group by q, k")
def rank_fusion(spark, sf):
    rows = fusion.rank_fusion(fusion_rows(spark, sf), {"vector": 0.7, "graph": 0.3})
    return rows.select("query_id", F.md5("key").alias("key_id"), "match", F.round("ranking", 6).alias("ranking"), "source")


for mode, dropped in (("prefer_graph", "vector"), ("prefer_vector", "graph")):
    query(f"rank_fusion_{mode}", FUSION_SQL + f" select q as query_id, md5(k) as key_id, m as match, round(ranking, 6) as ranking, source from r where nth = 1 or source <> '{dropped}'")(
        lambda spark, sf, mode=mode: fusion.rank_fusion(fusion_rows(spark, sf), {"vector": 0.7, "graph": 0.3}, mode).select("query_id", F.md5("key").alias("key_id"), "match", F.round("ranking", 6).alias("ranking"), "source")
    )

WC = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
BY_SOURCE = "select source query_id, doc_id, text, row_number() over (partition by source order by doc_id) rank from documents"


def budget_rows(spark, sf) -> DataFrame:
    return retrieval.ranked(table(spark, sf, "documents").withColumn("score", -F.col("doc_id")), ["source"]).select(F.col("source").alias("query_id"), "doc_id", "rank", F.col("text").alias("content"))


@query(
    "context_budget",
    f"""with r as ({BY_SOURCE}), t as (select *, {WC.format('text')} * 1.3 tok from r), b as (select *, coalesce(sum(tok) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) before from t),
o as (select *, sum((before + tok > 8000)::INT) over (partition by query_id order by rank rows unbounded preceding) n_over, before + tok > 8000 over_ from b)
select query_id, doc_id, rank::INT as rank, round(tok, 4)::DOUBLE as tokens, md5(case when over_ then array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:greatest(floor((8000 - before) / 1.3)::INT, 0)], ' ') || '...' else text end) as content_md5
from o where n_over = 0 or (over_ and n_over = 1 and 8000 - before > 100)""",
)
def context_budget(spark, sf):
    return fusion.context_budget(budget_rows(spark, sf)).select("query_id", "doc_id", "rank", F.round("tokens", 4).alias("tokens"), F.md5("content").alias("content_md5"))


@query("budget_api", f"with r as ({BY_SOURCE}), t as (select *, sum({WC.format('text')} * 1.3 + 50) over (partition by query_id order by rank rows unbounded preceding) running from r) select query_id, doc_id, rank::INT as rank from t where running <= 8000 and rank <= 10")
def budget_api(spark, sf):
    return fusion.api_budget(budget_rows(spark, sf)).select("query_id", "doc_id", "rank")


@query("hier_tuning", "select doc_id, round(least(1.0, (doc_id % 100) / 100.0 * case when doc_id % 5 = 0 then 1.2 else 1 end * case when doc_id % 3 = 0 then 1.1 else 1 end * case when doc_id % 2 = 0 then 1.05 else 1 end), 6)::DOUBLE as score from documents")
def hier_tuning(spark, sf):
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", F.when(i % 5 == 0, "summary").otherwise("text").alias("chunk_type"), (i % 3 == 0).alias("has_section"), (i % 2 == 0).alias("has_parent"), ((i % 100) / 100.0).alias("score"))
    return fusion.hierarchy_tuning(rows).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "rerank_boost",
    f"""with t as (select doc_id, lower(text) c, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') w, ['the', 'thing', 'and', 'there'] terms from documents)
select doc_id, round(case when contains(c, {quoted(Q)}) then 1.5 else 1 end * (1 + 0.3 * len(list_filter(terms, lambda x: contains(c, x))) / 4.0) * (1 + 0.2 * len(list_intersect(terms, w))), 6)::DOUBLE as boost from t""",
)
def rerank_boost(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(scoring.rank_boost(F.lit(Q), F.col("text"), F.lit(1.0)), 6).alias("boost"))


@query("mmr")
def mmr(spark, sf):
    """Greedy and order-dependent, hence without SQL: each language's 20 longest documents, diversified."""
    docs = retrieval.ranked(table(spark, sf, "documents").withColumn("score", F.col("n_chars").cast("double")), ["lang"]).filter("rank <= 20")
    w = F.max("score").over(Window.partitionBy("lang"))
    return fusion.mmr_order(docs.select(F.col("lang").alias("query_id"), "doc_id", (F.col("score") / w).alias("score"), F.col("text").alias("content")))


DAYS = "datediff('day', o_orderdate::DATE, DATE '2002-01-01')"


@query(
    "temporal_decay",
    f"""with o as (select o_orderkey, {DAYS} age, case o_orderpriority when '1-URGENT' then 'values' when '2-HIGH' then 'project' when '3-MEDIUM' then 'meeting' else 'default' end kind from orders)
select o_orderkey, kind, round(case kind when 'values' then 1.0 when 'project' then greatest(0.1, exp(-pow(age / 120.0, 2.5))) when 'meeting' then greatest(0.05, exp(-pow(age / 14.0, 0.8))) else greatest(0.1, exp(-pow(age / 60.0, 1.5))) end, 6) as weight from o""",
)
def temporal_decay(spark, sf):
    kind = reduce(lambda c, x: c.when(F.col("o_orderpriority") == x[0], x[1]), [("2-HIGH", "project"), ("3-MEDIUM", "meeting")], F.when(F.col("o_orderpriority") == "1-URGENT", "values")).otherwise("default")
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), F.round(temporal.decay(age, kind), 6).alias("weight"))


@query(
    "temporal_mix",
    f"""with o as (select o_orderkey, o_totalprice / 777777.7 s, greatest(0.1, exp(-pow(greatest({DAYS}, 0) / 60.0, 1.5))) f, case when o_orderkey % 3 = 0 then 0.5 when o_orderkey % 3 = 1 then 0.1 else 0.3 end w from orders)
select o_orderkey, round((1 - w) * s + w * f, 6) as score from o""",
)
def temporal_mix(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, "latest orders").when(F.col("o_orderkey") % 3 == 1, "old orders").otherwise("orders")
    fresh = temporal.decay(F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")), F.lit("default"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(temporal.temporal_mix(F.col("o_totalprice") / 777777.7, fresh, temporal.temporal_weight(text)), 6).alias("score"))
