"""Registered queries: whole retrievals over requests made from conversations, and what queries are turned into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepool import values
from tidepool.functions import scoring
from tidepool.operators import pipelines, queries as qu, retrieval
from tidepool.operators.config import FusionConfig
from tidepool.operators.skew import FEW_ROWS
from tidepool.plans.analysis import CONCEPTS, NAMES, PIECES, SCORES, SOURCE, WORDS, any_, has, texts
from tidepool.plans.graph import S_SQL, mentions, strong_edges
from tidepool.plans.registry import query, quoted
from tidepool.session import stored, table

#: First user turns of the conversations whose id is divisible by 100, each with a part's name and a way of asking.
OPENINGS = ["how many ", "explain ", "similar ", ""]
REQ_SQL = f"""rq as (select conv_id::BIGINT query_id, list_extract([{', '.join(map(quoted, OPENINGS))}], 1 + ((conv_id // 100) % 4)::INT) || lower(p_name) || ' ' || text as query, embedding
from (select conv_id, text, row_number() over (partition by conv_id order by turn, text) n from conversations where role = 'user' and conv_id % 100 = 0) join part on p_partkey = 1 + conv_id % 200 join embeddings on vec_id = conv_id % 500 where n = 1)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").filter("role = 'user' and conv_id % 100 = 0").groupBy("conv_id").agg(F.min(F.struct("turn", "text"))["text"].alias("text"))
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.floor(F.col("conv_id") / 100) % 4 + 1).cast("int"))
    part, vectors = table(spark, sf, "part"), table(spark, sf, "embeddings")
    rows = turns.join(part, part.p_partkey == 1 + turns.conv_id % 200).join(vectors, vectors.vec_id == turns.conv_id % 500)
    return stored(rows.select(F.col("conv_id").alias("query_id"), F.concat(opening, F.lower("p_name"), F.lit(" "), "text").alias("query"), "embedding"), "requests")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    return docs.join(vectors, docs.doc_id == vectors.vec_id).select("doc_id", F.col("text").alias("content"), "embedding")


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
LW = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"
ADAPT = " ".join(f"when {any_('lower(query)', w)} then {v}" for w, v in values.ADAPTIVE)


@query(
    "answer_requests",
    f"""with {S_SQL}, {REQ_SQL}, a as (select query_id, query, lower(query) l, embedding, case {ADAPT} else 0.7 end::DOUBLE vw from rq),
v as (select query_id, doc_id, text c, score, row_number() over (partition by query_id order by score desc, doc_id) - 1 pos from (select q.query_id, d.doc_id, d.text, {COS} score from rq q, embeddings e join documents d on d.doc_id = e.vec_id) qualify pos < 30),
vl as (select query_id, 'vector' source, pos, c, null::INT pl, vw w, round(least(100.0, 100 / (1 + exp(-5 * (score - 0.5))) + 20 * len(list_filter(list_distinct({LW.format('query')}), lambda x: contains(lower(c), x))) / len(list_distinct({LW.format('query')}))::DOUBLE + case when contains(lower(c), l) then 30 else 0 end), 1) m from v join a using (query_id)),
f as (select e, count(*) n from m group by 1), en as (select p_partkey id, p_name nm, p_type ty, coalesce(n, 1) n from part left join f on e = p_partkey),
g as (select query_id, id, nm, ty, l, vw, case when lower(nm) = l then 'exact' when contains(lower(nm), l) then 'contains' else 'contained_by' end mt, n from en, a where contains(lower(nm), l) or contains(l, lower(nm))),
gr as (select *, case mt when 'exact' then 1.0 when 'contains' then 0.95 else 0.9 end::DOUBLE conf, row_number() over (partition by query_id order by case mt when 'exact' then 0.95 when 'contains' then 0.86 else 0.80 end + n / 100 desc, n desc, id) - 1 pos from g qualify pos < 5),
sd as (select query_id, id seed from gr where pos < 2),
p as (select query_id, seed, b id, 1 hops, w / 10.0 mean from sd join u on a = seed union all
 select query_id, seed, y.b, 2, (x.w + y.w) / 20.0 from sd join u x on x.a = seed join u y on x.b = y.a where not (least(x.a, x.b) = least(y.a, y.b) and greatest(x.a, x.b) = greatest(y.a, y.b))),
pb as (select query_id, seed, p.id, min(hops)::INT hops, max(case hops when 1 then 0.8 else 0.6 end * mean + coalesce(en.n, 1) / 50) score, max(case when mean >= 0.7 then 0.9 when mean >= 0.5 then 0.8 else 0.7 end)::DOUBLE conf from p left join en on en.id = p.id where p.id <> seed group by 1, 2, 3),
p1 as (select * from pb qualify row_number() over (partition by query_id, id order by score desc, conf desc, seed) = 1),
pw as (select *, row_number() over (partition by query_id order by score desc, conf desc, id) rk from p1 qualify rk <= 2),
gl as (select query_id, pos, nm, ty, mt, conf, 0 pl from gr union all select query_id, (select count(*) from gr where gr.query_id = pw.query_id) + rk - 1, nm, ty, 'traversal', conf, hops from pw join en using (id)),
ge as (select query_id, 'graph' source, pos, 'Entity: ' || nm || ' (Type: ' || ty || ')' c, pl, 1 - vw w, round(least(100.0, conf * case when mt = 'exact' or l = lower(nm) then 95.0 when contains(l, lower(nm)) then 70 + 25 * length(nm) / greatest(length(l), 1)::DOUBLE when contains(lower(nm), l) then 60 + 30 * length(l) / greatest(length(nm), 1)::DOUBLE when mt = 'contains' then 75.0 else greatest(10.0, 40 - 10.0 * pl) end
 + 15 * len(list_intersect(list_distinct({LW.format('query')}), list_distinct({LW.format('nm')}))) / greatest(len(list_distinct({LW.format('query')})), 1)::DOUBLE), 1) m from gl join a using (query_id)),
li as (select *, lower(c[1:100]) k, m * w / (1 + 0.1 * pos) * case when source = 'graph' and coalesce(pl, 0) = 0 then 1.2 else 1 end ranking from (select query_id, source, pos, c, pl, w, m from vl union all select query_id, source, pos, c, pl, w, m from ge)),
nt as (select *, row_number() over (partition by query_id, k order by source desc, pos) nth from li),
fu as (select query_id, k, max(m) m, round(max(case when nth = 1 then ranking end) + 0.5 * coalesce(sum(case when nth > 1 then ranking end), 0), 9) ranking, case when bool_or(nth > 1 and source = 'graph') then 'hybrid' else max(case when nth = 1 then source end) end source, max(case when nth = 1 then c end) c from nt group by 1, 2),
rk as (select *, row_number() over (partition by query_id order by ranking desc, k) rank from fu), bu as (select *, sum(len(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> '')) * 1.3 + 50) over (partition by query_id order by rank rows unbounded preceding) run from rk),
ke as (select bu.*, count(*) over (partition by query_id) cnt from bu where run <= 8000 - 100 * (select count(*) from pw where pw.query_id = bu.query_id) and rank <= 10),
bo as (select ke.query_id, source, m, rank, c, list_filter(list_distinct({LW.format('query')}), lambda x: length(x) > 2) t, l, ranking, cnt from ke join a using (query_id)),
fi as (select query_id, source, m, rank, c, round(ranking * case when cnt > 1 then case when contains(lower(c), l) then 1.5 else 1 end * (1 + 0.3 * len(list_filter(t, lambda x: contains(lower(c), x))) / greatest(len(t), 1)::DOUBLE) * (1 + 0.2 * len(list_intersect(t, {LW.format('c')}))) else 1 end, 9) ranking from bo),
o as (select query_id, row_number() over (partition by query_id order by ranking desc, rank)::INT final_rank, source, m, round(ranking, 5) ranking, md5(c) content_md5 from fi)
select query_id, final_rank, source, m as match, ranking, content_md5 from o union all select query_id, 1, 'system', 0.0, null, md5({quoted(pipelines.NO_RESULTS)}) from a where query_id not in (select query_id from o)""",
)
def answer_requests(spark, sf):
    """The live query path over all documents with vectors, parts as entities and strong edges between them."""
    f = mentions(spark, sf).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("frequency"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    entities = parts.join(f, "id", "left").withColumn("frequency", F.coalesce("frequency", F.lit(1)))
    edges = strong_edges(spark, sf).withColumn("weight", F.col("weight") / 10.0)
    rows = pipelines.answer_requests(requests(spark, sf), chunks(spark, sf), entities, edges, least_weight=0.15)
    return rows.select("query_id", "final_rank", "source", "match", F.round("ranking", 5).alias("ranking"), F.md5("content").alias("content_md5"))


FULL = FusionConfig().with_(similarity_threshold=0.1, use_mmr=False)
L_ROWS = """m as (select distinct l_orderkey c, l_partkey e from lineitem where l_orderkey in (select vec_id from embeddings)),
vv as (select query_id, e.vec_id d, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) s, row_number() over (partition by query_id order by list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) desc, e.vec_id) rank from embeddings e, rq q),
v as (select query_id, 'vector' source, d, s from vv where rank <= 20 and s >= 0.1), s0 as (select distinct query_id, e, 0 depth from vv join m on c = d where rank <= 5),
s1 as (select distinct query_id, y.e, 1 depth from s0 join m x using (e) join m y on y.c = x.c where (query_id, y.e) not in (select (query_id, e) from s0)),
s2 as (select distinct query_id, y.e, 2 depth from s1 join m x using (e) join m y on y.c = x.c where (query_id, y.e) not in (select (query_id, e) from s0) and (query_id, y.e) not in (select (query_id, e) from s1)),
g as (select query_id, 'graph' source, c d, 0.6 / (min(depth) + 1) s from (select * from s0 union all select * from s1 union all select * from s2) join m using (e) group by 1, 3 qualify row_number() over (partition by query_id order by 0.6 / (min(depth) + 1) desc, c) <= 15),
l as (select * from v union all select * from g)"""


def chunk_mentions(spark, sf) -> DataFrame:
    """Mentions of the chunks that have a vector; the others go before rows are made distinct."""
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"))
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_ROWS else ids, "chunk_id", "left_semi").distinct()


def plain_vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query("retrieve_vector_graph", f"with {REQ_SQL}, {L_ROWS} select query_id, source, d as doc_id, round(s, 6)::DOUBLE as score from l")
def retrieve_vector_graph(spark, sf):
    """Both single retrievals of each request."""
    req = requests(spark, sf)
    rows = pipelines.vector_only(req, plain_vectors(spark, sf), FULL).unionByName(pipelines.graph_only(req, plain_vectors(spark, sf), chunk_mentions(spark, sf), FULL))
    return rows.withColumn("score", F.round(F.col("score").cast("double"), 6))


@query("retrieve_hybrid", f"with {REQ_SQL}, {L_ROWS} select query_id, d as doc_id, round(max(s * case source when 'vector' then 0.7 else 0.3 end), 6)::DOUBLE as score, case when count(distinct source) > 1 then 'hybrid' else min(source) end as source from l group by 1, 2")
def retrieve_hybrid(spark, sf):
    req = requests(spark, sf)
    lists = pipelines.vector_only(req, plain_vectors(spark, sf), FULL).unionByName(pipelines.graph_only(req, plain_vectors(spark, sf), chunk_mentions(spark, sf), FULL))
    return pipelines.merged(lists, FULL).withColumn("score", F.round(F.col("score").cast("double"), 6))


def described_chunks(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("content"), F.when(i % 5 == 0, "summary").otherwise("text").alias("chunk_type"), (i % 3 == 0).alias("has_section"), (i % 2 == 0).alias("has_parent"),
        F.when(i % 4 == 0, "project").otherwise("default").alias("doc_type"), (i % 90).cast("int").alias("age_days"),
    )


STRATEGY = f"case when greatest(c0, s0) / greatest(0.1 * {len(values.CONCEPTUAL) + len(values.SPECIFIC)}, 1.0) < 0.5 then 'hybrid' when s0 - c0 > 2 then 'vector' when c0 - s0 > 2 then 'graph' else 'hybrid' end"
AGED = f"""ct as (select query_id, query, ({has('lower(query)', values.CONCEPTUAL)}) + (len({LW.format('query')}) < 5)::INT c0, ({has('lower(query)', values.SPECIFIC)}) + 2 * (len({LW.format('query')}) > 10)::INT s0 from rq),
stg as (select query_id, query, {STRATEGY} stg from ct),
one as (select query_id, d, s, source from l join stg using (query_id) where stg = source), hy as (select query_id, d, max(s * case source when 'vector' then 0.7 else 0.3 end) s, case when count(distinct source) > 1 then 'hybrid' else min(source) end source from l join stg using (query_id) where stg = 'hybrid' group by 1, 2),
un as (select * from one union all select * from hy),
tu as (select query_id, query, d, un.source, least(1.0, s * case when d % 5 = 0 then 1.2 else 1 end * case when d % 3 = 0 then 1.1 else 1 end * case when d % 2 = 0 then 1.05 else 1 end) s, case when {any_('lower(query)', values.RECENT)} then 0.5 when {any_('lower(query)', values.HISTORICAL)} then 0.1 else 0.3 end tw,
 case when d % 4 = 0 then greatest(0.1, exp(-pow((d % 90) / 120.0, 2.5))) else greatest(0.1, exp(-pow((d % 90) / 60.0, 1.5))) end fr, text c from un join stg using (query_id) join documents on doc_id = d),
ra as (select *, round((1 - tw) * s + tw * fr, 9) sc from tu), rr as (select *, row_number() over (partition by query_id order by sc desc, d) rank from ra),
tk as (select *, len(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> '')) * 1.3 tok from rr), be as (select *, coalesce(sum(tok) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) bef from tk),
ov as (select *, sum((bef + tok > 8000)::INT) over (partition by query_id order by rank rows unbounded preceding) n_over, bef + tok > 8000 over_ from be)"""


@query(
    "retrieve_full",
    f"with {REQ_SQL}, {L_ROWS}, {AGED} select query_id, rank::INT as final_rank, d as doc_id, source, round(sc, 6)::DOUBLE as score, md5(case when over_ then array_to_string(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> '')[1:greatest(floor((8000 - bef) / 1.3)::INT, 0)], ' ') || '...' else c end) as content_md5 from ov where (n_over = 0 or (over_ and n_over = 1 and 8000 - bef > 100)) and rank <= 10",
)
def retrieve_full(spark, sf):
    """The whole retrieval without diversity, which has no SQL: strategy, both lists, tuning, age, budget."""
    rows = pipelines.retrieve(requests(spark, sf), plain_vectors(spark, sf), chunk_mentions(spark, sf), described_chunks(spark, sf), FULL)
    return rows.select("query_id", "final_rank", "doc_id", "source", F.round(F.col("score").cast("double"), 6).alias("score"), F.md5("content").alias("content_md5"))


#: A re-ranker's output in its simplest form: the share of the request's words that the first 512 characters hold, between -2 and 2.
SHARED = f"(4 * len(list_filter(list_distinct({LW.format('query')}), lambda x: contains(lower(c[1:512]), x))) / greatest(len(list_distinct({LW.format('query')})), 1) - 2)"


def word_overlap(query_: Column, content: Column) -> Column:
    w = F.array_distinct(scoring.words(query_))
    return 4 * F.size(F.filter(w, lambda x: F.contains(F.lower(content), x))) / F.greatest(F.size(w), F.lit(1)) - 2


@query(
    "retrieve_reranked",
    f"with {REQ_SQL}, {L_ROWS}, {AGED.replace('(1 - tw) * s + tw * fr, 9', f'0.4 * ((1 - tw) * s + tw * fr) + 0.6 / (1 + exp(-{SHARED})), 9')} select query_id, rank::INT as final_rank, d as doc_id, source, round(sc, 6)::DOUBLE as score, md5(case when over_ then array_to_string(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> '')[1:greatest(floor((8000 - bef) / 1.3)::INT, 0)], ' ') || '...' else c end) as content_md5 from ov where (n_over = 0 or (over_ and n_over = 1 and 8000 - bef > 100)) and rank <= 10",
)
def retrieve_reranked(spark, sf):
    """``retrieve_full`` with a re-ranker of weight .6."""
    rows = pipelines.retrieve(requests(spark, sf), plain_vectors(spark, sf), chunk_mentions(spark, sf), described_chunks(spark, sf), FULL.with_(reranker_weight=0.6), rerank=word_overlap)
    return rows.select("query_id", "final_rank", "doc_id", "source", F.round(F.col("score").cast("double"), 6).alias("score"), F.md5("content").alias("content_md5"))


def metadata_rows(spark, sf) -> DataFrame:
    """Documents with fields and tags: source, language, and tags by length."""
    size = F.when(F.col("n_chars") > 2000, "long").when(F.col("n_chars") > 500, "middle").otherwise("short")
    return table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("fields"), F.array(size, F.concat(size, F.lit("-"), "lang")).alias("tags"))


def metadata_filters(spark, sf) -> DataFrame:
    i = F.col("query_id")
    fields = F.when(i % 200 == 0, F.create_map(F.lit("source"), F.concat(F.lit("src"), (i / 100 % 20).cast("int").cast("string")))).otherwise(F.create_map(F.lit("lang"), F.lit("en")))
    return requests(spark, sf).select("query_id", fields.alias("fields"), F.array(F.lit("long")).alias("tags"))


@query(
    "metadata_batch",
    f"with {REQ_SQL} select query_id, doc_id, 1.0::DOUBLE as score, row_number() over (partition by query_id order by doc_id)::INT as rank from rq join documents on n_chars > 2000 and case when query_id % 200 = 0 then source = 'src' || (query_id // 100 % 20)::VARCHAR else lang = 'en' end qualify rank <= 10",
)
def metadata_batch(spark, sf):
    """Long documents of a source or a language, by the request."""
    return retrieval.metadata_search_batch(metadata_rows(spark, sf), metadata_filters(spark, sf))


def enhanced_search(spark, sf, own: DataFrame) -> DataFrame:
    ages = described_chunks(spark, sf).select("doc_id", "doc_type", "age_days")
    metadata = retrieval.metadata_search_batch(metadata_rows(spark, sf), metadata_filters(spark, sf).join(own.select("query_id"), "query_id", "left_semi"))
    return pipelines.retrieve_enhanced(own, plain_vectors(spark, sf), table(spark, sf, "documents").select("doc_id", "text"), ages, FusionConfig(), metadata=metadata, rerank=word_overlap)


@query("retrieve_enhanced")
def retrieve_enhanced(spark, sf):
    """Parts of requests; vectors, keywords and metadata; age, re-ranking, budget. No SQL: composed of operators that have it each; tested on a small table."""
    rows = enhanced_search(spark, sf, requests(spark, sf))
    return rows.select("query_id", "final_rank", "doc_id", "source", F.round("score", 6).alias("score"), F.md5("content").alias("content_md5"))


# --- what queries are turned into -----------------------------------------------------------------------------------------------

count_of = lambda mark: f"(length(q) - length(replace(q, {quoted(mark)}, '')))"
SIGNS = [f"contains(lower(q), ' {w} ')::INT" for w in ("and", "then", "before", "after")] + [f"({count_of('?')} > 1)::INT", f"({count_of(',')} > 1)::INT", f"(len({WORDS}) > 15)::INT"]
KIND = f"case greatest({', '.join(NAMES)}) {' '.join(f'when {n} then {quoted(n)}' for n in NAMES)} end"
COMPLEX = f"least(1.0, (len(w) / 30 + (length(q) - length(regexp_replace(q, '[,;]', '', 'g'))) / 5 + ({' + '.join(NAMES)}) / 10 + (contains(l, 'and') and contains(l, 'or'))::INT) / 4)"
ENTRIES = "[" + ", ".join("{'term': " + quoted(k) + ", 'syn': [" + ", ".join(map(quoted, v)) + "]}" for k, v in values.SYNONYMS.items()) + "]"
FIRSTS = f"list_filter({CONCEPTS}, lambda x, i: list_position({CONCEPTS}, x) = i)[1:10]"
NEAR = "list_filter(en, lambda e: contains(e.term, k) or contains(k, e.term))"
ASKS = "case when regexp_matches(p, '^(what|when|where|who|why|how)') then p || '?' else 'What about ' || p || '?' end"
BACK = any_("lower(s)", values.BACK_REFERENCES)
ENHANCED = f"""{SOURCE}, {SCORES}, e0 as (select q, {KIND} kind, {COMPLEX} cx, ({' + '.join(SIGNS)}) >= 2 needs from s),
e1 as (select q, kind, cx, needs, case when cx > 0.5 or needs then list_transform({PIECES}, lambda p: {ASKS}) else [q] end subs from e0),
d0 as (select q, lower(q) l, {FIRSTS} c, {ENTRIES} en from t), d1 as (select q, l, c, en, list_filter(en, lambda e: contains(l, e.term) or list_contains(c, e.term)) dr from d0),
d2 as (select q, l, list_concat(dr, list_transform(list_filter(c, lambda k: not list_contains(list_transform(dr, lambda d: d.term), k) and len({NEAR}) > 0), lambda k: {{'term': k, 'syn': {NEAR}[1].syn}})) ex from d1),
d3 as (select q, l, list_concat([q], list_filter(flatten(list_transform(ex, lambda e: list_transform(e.syn[1:2], lambda y: replace(l, e.term, y)))), lambda v: v <> l)) al from d2),
d4 as (select q, list_filter(al, lambda x, i: list_position(al, x) = i) fs from d3),
va as (select q, case when suffix(q, '?') then list_concat(fs, list_filter(['Can you explain ' || q[:-2] || '?', 'Tell me about ' || q[:-2], 'What do you know about ' || q[:-2] || '?', 'Show me information on ' || q[:-2]], lambda v: not list_contains(list_transform(fs, lambda f: lower(f)), lower(v)))) else fs end[1:7] va from d4)"""


@query(
    "query_enhanced",
    f"""with {ENHANCED}, r as (select q, kind, cx, needs, subs, list_filter(subs, lambda s, i: i = 1 or not {BACK}) roots, list_filter(list_transform(subs, lambda s, i: case when i > 1 and {BACK} then 'Then use results from (' || subs[i - 1] || ') to answer: ' || s end), lambda x: x is not null) th from e1)
select q, kind, round(cx, 6)::DOUBLE as complexity, needs as needs_decomposition, array_to_string(subs, '|') as sub_queries, array_to_string(va, '|') as variations,
case when (kind = 'multi_hop' or len(subs) > 2) and len(subs) > 0 then array_to_string(list_concat(['Start with: ' || array_to_string(roots, ', ')], th), ' → ') end as reasoning_path,
(kind = 'multi_hop' or {any_('lower(q)', values.HOP_WORDS)}) as multi_hop, case when kind = 'multi_hop' then 1.0 else 0.8 end::DOUBLE as w_sub, case when kind = 'navigational' then 0.2 else 0.4 end::DOUBLE as w_expanded from r join va using (q)""",
)
def query_enhanced(spark, sf):
    rows = texts(spark, sf).withColumn("e", qu.enhanced(F.col("q"))).withColumn("w", qu.component_weights(F.col("e.kind")))
    return rows.select(
        "q", "e.kind", F.round("e.complexity", 6).alias("complexity"), qu.needs_decomposition(F.col("q")).alias("needs_decomposition"), F.array_join("e.sub_queries", "|").alias("sub_queries"),
        F.array_join("e.variations", "|").alias("variations"), "e.reasoning_path", qu.needs_multi_hop(F.col("q")).alias("multi_hop"), F.col("w.sub_queries").alias("w_sub"), F.col("w.expanded").alias("w_expanded"),
    )


@query(
    "query_answers",
    """with d as (select doc_id, source, row_number() over (partition by source order by doc_id) n from documents), p as (select distinct source, (doc_id % 3)::INT pos from documents), r as (select source, (doc_id % 3)::INT pos, row_number() over (partition by source, doc_id % 3 order by doc_id) rank, lang || doc_id c from documents),
b as (select source, pos, string_agg(c, chr(10) order by rank) body from r where rank <= 3 group by 1, 2) select source as query_id, string_agg(chr(10) || '## part ' || pos || chr(10) || chr(10) || body, chr(10) order by pos) as text from p join b using (source, pos) group by 1""",
)
def query_answers(spark, sf):
    """Results of each part of a request under its heading: sources as requests, ids modulo 3 as parts."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("query_id"), (F.col("doc_id") % 3).cast("int").alias("pos"), "doc_id", F.concat("lang", F.col("doc_id").cast("string")).alias("content"))
    results = retrieval.ranked(docs.withColumn("score", -F.col("doc_id")), ["query_id", "pos"])
    parts = docs.select("query_id", "pos").distinct().withColumn("part", F.concat(F.lit("part "), F.col("pos").cast("string")))
    return qu.combined_answers(parts, results)


REC = " ".join(f"when {quoted(k)} then {v[0]}" for k, v in values.RECOMMENDED.items())
WHY = " ".join(f"when {quoted(k)} then {quoted(v[1])}" for k, v in values.RECOMMENDED.items())


@query("weight_recommendation", f"with {SOURCE}, {SCORES}, k as (select q, {KIND} kind from s) select q, (case kind {REC} else {values.RECOMMENDED_ELSE[0]} end)::DOUBLE as weight, case kind {WHY} else {quoted(values.RECOMMENDED_ELSE[1])} end as reason from k")
def weight_recommendation(spark, sf):
    rec = qu.weight_recommendation(qu.kind(F.col("q")))
    return texts(spark, sf).select("q", rec["weight"].cast("double").alias("weight"), rec["reason"].alias("reason"))


@query(
    "ranking_texts",
    """with r as (select doc_id, case doc_id % 3 when 0 then 'vector' when 1 then 'graph' else 'hybrid' end source, (doc_id % 1000) / 10.0 m, (doc_id % 5) / 4.0 w, (doc_id % 7)::INT rk from documents)
select doc_id, 'Match Quality: ' || printf('%.1f', m::DOUBLE) || '% | ' || case source when 'vector' then 'Source: Vector Search (weight: ' || printf('%.0f', (100 * w)::DOUBLE) || '%)' when 'graph' then 'Source: Graph Search (weight: ' || printf('%.0f', (100 * w)::DOUBLE) || '%)' else 'Source: Hybrid (found by both)' end || case when rk > 0 then ' | Rank: #' || rk else '' end as explanation from r""",
)
def ranking_texts(spark, sf):
    i = F.col("doc_id")
    source = F.when(i % 3 == 0, "vector").when(i % 3 == 1, "graph").otherwise("hybrid")
    return table(spark, sf, "documents").select("doc_id", scoring.ranking_explanation((i % 1000) / 10, source, (i % 5) / 4, (i % 7).cast("int")).alias("explanation"))


@query(
    "score_blends",
    """with r as (select l_orderkey k, l_linenumber n, l_discount d, l_tax t, [l_partkey, l_suppkey, l_partkey % 2] nodes, case when l_linenumber % 2 = 0 then 100 * l_tax end v, case when l_linenumber % 3 = 0 then 100 * l_discount end g, case l_linenumber % 3 when 0 then 'vector' when 1 then 'graph' else 'hybrid' end src from lineitem)
select k, n, round(sum(0.5 * d + 0.5 / (1 + exp(-(t - d)))), 6) as blend, round(sum(0.3 * 0.5 + 0.25 * d + 0.25 * len(list_distinct(nodes)) / 3.0 + 0.2 * 0.81), 6)::DOUBLE as path, round(sum(case when n % 2 = 0 then (d + t) / 2 else 0.4 * t + 0.3 * d + 0.3 * t end), 6) as relevance,
round(sum(case when src = 'vector' and v is not null then v when src = 'graph' and g is not null then g when v is not null and g is not null then greatest(v, g) else 50.0 end), 6) as hybrid from r group by 1, 2""",
)
def score_blends(spark, sf):
    d, t, n = F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    nodes = F.array("l_partkey", "l_suppkey", F.col("l_partkey") % 2)
    v, g = F.when(n % 2 == 0, 100 * t), F.when(n % 3 == 0, 100 * d)
    source = F.when(n % 3 == 0, "vector").when(n % 3 == 1, "graph").otherwise("hybrid")
    six = lambda c, name: F.round(F.sum(c), 6).alias(name)
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), n.alias("n")).agg(
        six(scoring.rerank_blend(d, t - d), "blend"), six(scoring.path_score(nodes, d, F.lit(None).cast("double")), "path"),
        six(scoring.relevance(F.when(n % 2 == 1, t), d, t), "relevance"), six(scoring.hybrid_match(v, g, source), "hybrid"),
    )


@query("graph_match", f"""with p as (select p_partkey, p_name nm, lower(p_name || ' ' || p_brand) q, case p_partkey % 4 when 0 then 'exact' when 1 then 'contains' when 2 then 'fuzzy' else 'traversal' end mt, (p_partkey % 3)::INT h, (1 + p_partkey % 10) / 10.0 cf from part)
select p_partkey, round(least(100.0, cf * case when mt = 'exact' then 95.0 else 70 + 25 * length(nm) / length(q)::DOUBLE end + 15 * len(list_intersect(list_distinct({LW.format('q')}), list_distinct({LW.format('nm')}))) / len(list_distinct({LW.format('q')}))::DOUBLE), 1)::DOUBLE as score from p""")
def graph_match(spark, sf):
    i = F.col("p_partkey")
    kind = F.when(i % 4 == 0, "exact").when(i % 4 == 1, "contains").when(i % 4 == 2, "fuzzy").otherwise("traversal")
    q = F.lower(F.concat("p_name", F.lit(" "), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", scoring.graph_match(q, F.col("p_name"), kind, (i % 3).cast("int"), (1 + i % 10) / 10, F.lit(0.5)).alias("score"))

