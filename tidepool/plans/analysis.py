"""Registered queries: query understanding, evaluation, analytics, storage."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidepool import values
from tidepool.functions import temporal
from tidepool.operators import evaluation, queries as qu, retrieval, storage
from tidepool.plans.registry import query, quoted, values_sql
from tidepool.session import table

TEXTS = [
    "What is the vector database?", "How does GraphRAG compare with plain retrieval, and why is it better?", "find the latest api config error", "Explain the architecture; then show me documentation or code",
    "compare auth and login versus deploy performance between old and new services?", "define log", "", "Where can I find the exact function parameter setting example for this api class command step?", "Does the Machine Learning model use camelCase with \"quoted text\" in AWS?",
    "what happens and then what does it affect or cause, given that this leads to errors in tests?", "relationship between user and update overview",
]
TEXT_SQL = values_sql([(t,) for t in TEXTS], "v(q)")
USERS = "conversations where role = 'user'"


def texts(spark, sf):
    """The fixed texts and every user turn."""
    own = spark.createDataFrame([(t,) for t in TEXTS], "q string")
    return own.union(table(spark, sf, "conversations").filter("role = 'user'").select("text")).distinct()


SOURCE = f"t as (select distinct q from (select q from {TEXT_SQL} union all select text from {USERS}))"
#: Where the two engines' word boundaries differ on accented letters, the fixed texts alone.
has = lambda x, needles: " + ".join(f"contains({x}, {quoted(n)})::INT" for n in needles)
any_ = lambda x, needles: "(" + " or ".join(f"contains({x}, {quoted(n)})" for n in needles) + ")"
WORDS = "list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda x: x <> '')"
SCORES = f"""s as (select q, lower(q) l, {WORDS} w, {', '.join(f'{has("lower(q)", m)} {k}' for k, m in qu.KINDS)}, case when suffix(q, '?') and len({WORDS}) > 10 then 2 else 0 end exploratory from t)"""
NAMES = [k for k, _ in qu.KINDS] + ["exploratory"]


@query(
    "query_classify",
    f"""with {SOURCE}, {SCORES} select q, case greatest({', '.join(NAMES)}) {' '.join(f'when {n} then {quoted(n)}' for n in NAMES)} end as kind,
round(least(1.0, (len(w) / 30 + (length(q) - length(regexp_replace(q, '[,;]', '', 'g'))) / 5 + ({' + '.join(NAMES)}) / 10 + (contains(l, 'and') and contains(l, 'or'))::INT) / 4), 6)::DOUBLE as complexity from s""",
)
def query_classify(spark, sf):
    q = F.col("q")
    return texts(spark, sf).select("q", qu.kind(q).alias("kind"), F.round(qu.complexity(q), 6).alias("complexity"))


STOPS = "[" + ", ".join(map(quoted, values.STOP_WORDS)) + "]"
# Ordered distinct: a word stays where it stands first.
CONCEPTS = f"list_filter({WORDS}, lambda x: not list_contains({STOPS}, x) and length(x) > 2)"
FIRSTS = f"list_filter({CONCEPTS}, lambda x, i: list_position({CONCEPTS}, x) = i)[1:10]"


@query("query_concepts", f"with {SOURCE} select q, array_to_string({FIRSTS}, '|') as concepts from t")
def query_concepts(spark, sf):
    return texts(spark, sf).select("q", F.array_join(qu.concepts(F.col("q")), "|").alias("concepts"))


DICT = values_sql([(i, k, "|".join(v)) for i, (k, v) in enumerate(values.SYNONYMS.items())], "d(i, term, syn)")


@query(
    "query_expand",
    f"""with {SOURCE}, c as (select q, {FIRSTS} c from t), dr as (select q, term, syn from c, {DICT} where contains(lower(q), term) or list_contains(c, term)),
cc as (select q, unnest(c) k from c), p as (select q, k term, syn from cc, {DICT} where (contains(term, k) or contains(k, term)) and not exists (select 1 from dr where dr.q = cc.q and dr.term = k) qualify row_number() over (partition by q, k order by i) = 1)
select q, term, syn as synonyms from dr union all select q, term, syn from p""",
)
def query_expand(spark, sf):
    return texts(spark, sf).select("q", F.explode(qu.expanded(F.col("q"))).alias("e")).select("q", "e.term", F.array_join("e.synonyms", "|").alias("synonyms"))


PIECES = "list_filter(list_transform(string_split(regexp_replace(q, '\\s+(?:and|then|but|or)\\s+|[,;?]', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1:5]"


@query(
    "query_decompose",
    f"""with {SOURCE}, p as (select q, unnest(generate_series(0, len(p) - 1)) pos, unnest(p) p from (select q, {PIECES} p from t)),
a as (select q, pos::INT pos, case when regexp_matches(p, '^(what|when|where|who|why|how)') then p || '?' else 'What about ' || p || '?' end part from p)
select q, pos, part, pos > 0 and {any_('lower(part)', ['it', 'this', 'that', 'these', 'those'])} as depends from a""",
)
def query_decompose(spark, sf):
    rows = texts(spark, sf).select("q", F.posexplode(qu.parts(F.col("q"))).alias("pos", "part"))
    return rows.withColumn("depends", (F.col("pos") > 0) & qu.depends_on_previous(F.col("part")))


DECIDE = f"case when greatest(c, s) / greatest(0.1 * {len(values.CONCEPTUAL) + len(values.SPECIFIC)}, 1.0) < {{}} then 'hybrid' when s - c > 2 then 'vector' when c - s > 2 then 'graph' else 'hybrid' end"


@query(
    "query_strategy",
    f"""with {SOURCE}, u as (select q from t union select 'explain the relationship and compare the concept: ' || q from t), s as (select q, len({WORDS}) n, {has('lower(q)', values.CONCEPTUAL)} c0, {has('lower(q)', values.SPECIFIC)} s0 from u),
x as (select q, c0 + (n < 5)::INT c, s0 + 2 * (n > 10)::INT s from s) select q, {DECIDE.format(0.5)} as strategy, {DECIDE.format(0.9)} as strict, {DECIDE.format(0.1)} as loose from x""",
)
def query_strategy(spark, sf):
    """Every user turn as it is and asked in conceptual words, at three thresholds."""
    own = texts(spark, sf).select("q")
    both = own.union(own.select(F.concat(F.lit("explain the relationship and compare the concept: "), "q"))).distinct()
    return both.select("q", *(qu.strategy(F.col("q"), t).alias(n) for n, t in (("strategy", 0.5), ("strict", 0.9), ("loose", 0.1))))


ASCII = "regexp_replace(regexp_replace(regexp_replace(q, '[\\p{Z}\\x{85}]', ' ', 'g'), '[^\\x00-\\x7F\\p{L}\\p{N}]', '.', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


@query("query_entities", f"""with {SOURCE}, u as (select q from t union select 'Ask Émile Zola about GPT and camelCase or "quoted Words" über BERT: ' || q from t), a as (select q, {ASCII} x from u),
e as (select q, list_concat(list_concat(regexp_extract_all(x, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1), regexp_extract_all(x, '\\b([A-Z]{{2,}}|[a-z]+[A-Z][a-zA-Z]*)\\b', 1)), list_concat(regexp_extract_all(q, '"([^"]+)"', 1), list_filter([{', '.join(map(quoted, values.TECH_KEYWORDS))}], lambda k: contains(lower(q), k)))) f from a)
select q, array_to_string(list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i), '|') as entities from e""")
def query_entities(spark, sf):
    """All user turns, as they are and after a sentence with names of every sort."""
    own = texts(spark, sf).select("q")
    both = own.union(own.select(F.concat(F.lit('Ask Émile Zola about GPT and camelCase or "quoted Words" über BERT: '), "q"))).distinct()
    return both.select("q", F.array_join(qu.entities(F.col("q")), "|").alias("entities"))


@query("temporal_weight", f"with {SOURCE} select q, (case when {any_('lower(q)', values.RECENT)} then 0.5 when {any_('lower(q)', values.HISTORICAL)} then 0.1 else 0.3 end)::DOUBLE as weight from t")
def temporal_weight(spark, sf):
    return texts(spark, sf).select("q", temporal.temporal_weight(F.col("q")).cast("double").alias("weight"))


# --- evaluation and analytics -------------------------------------------------------------------------------------------------


@query(
    "metrics_prf",
    """with g as (select lang q, doc_id from documents qualify row_number() over (partition by lang order by n_chars desc, doc_id) <= 20), t as (select lang q, doc_id from documents join labels using (doc_id) where quality = 1),
n as (select q, count(*) n from g group by 1), m as (select q, count(distinct doc_id) m from t group by 1), h as (select q, count(*) h from (select * from g intersect select * from t) group by 1),
x as (select q, coalesce(h / nullif(n, 0), 0) p, coalesce(h / nullif(m, 0), 0) r from n full join m using (q) left join h using (q))
select q as query_id, round(p, 6)::DOUBLE as precision, round(r, 6)::DOUBLE as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6)::DOUBLE as f1 from x""",
)
def metrics_prf(spark, sf):
    docs = table(spark, sf, "documents")
    got = retrieval.ranked(docs.withColumn("score", F.col("n_chars")), ["lang"]).filter("rank <= 20").select(F.col("lang").alias("query_id"), "doc_id")
    truth = docs.join(table(spark, sf, "labels").filter("quality = 1"), "doc_id").select(F.col("lang").alias("query_id"), "doc_id")
    return evaluation.precision_recall(got, truth).select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(
    "grid_eval",
    f"""with k as (select unnest([5, 10, 20]) k), s as (select q.vec_id q, q.label l, e.vec_id d, e.label el, row_number() over (partition by q.vec_id order by {COS} desc, e.vec_id) rn from embeddings e, embeddings q where q.vec_id % 100 = 0),
m as (select l, count(*) m from (select label l from embeddings) group by 1), x as (select k, q, count(*) n, sum((el = s.l)::INT) h, any_value(m) m from s join k on rn <= k join m on m.l = s.l group by 1, 2), y as (select k, h / n p, h / m r from x)
select k, round(avg(p), 6)::DOUBLE as precision, round(avg(r), 6)::DOUBLE as recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6)::DOUBLE as f1 from y group by 1""",
)
def grid_eval(spark, sf):
    """Depths of the list compared by macro precision, recall and F1; truth is equality of the vectors' labels."""
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = vectors.filter("doc_id % 100 = 0")
    lists = retrieval.vector_top_k(vectors, asked.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query")), 20).select("query_id", "doc_id", "rank")
    truth = asked.select(F.col("doc_id").alias("query_id"), "label").join(vectors.select("label", "doc_id"), "label").select("query_id", "doc_id")
    depths = spark.createDataFrame([(5,), (10,), (20,)], "k int")
    key = F.struct("k", "query_id")
    got = lists.join(F.broadcast(depths), F.col("rank") <= F.col("k")).select(key.alias("query_id"), "doc_id")
    want = truth.crossJoin(F.broadcast(depths)).select(key.alias("query_id"), "doc_id")
    rows = evaluation.precision_recall(got, want).select(F.col("query_id.k").alias("k"), "precision", "recall", "f1")
    return evaluation.macro(rows, ["k"]).select("k", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("latency_histogram", "select case when v < 100 then '<100' when v < 500 then '100-500' when v < 1000 then '500-1000' else '>=1000' end as bucket, count(*) as n, round(100 * count(*) / (select count(*) from events), 6)::DOUBLE as percent from (select value * 10 v from events) group by 1")
def latency_histogram(spark, sf):
    rows = table(spark, sf, "events")
    counts = rows.groupBy(evaluation.histogram(F.col("value") * 10).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.select("bucket", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@query("latency_percentiles", "with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 i, count(*) over (partition by event_type) n from events) select event_type, max(case when i = n // 2 then value end) as p50, max(case when i = floor(0.95 * n)::BIGINT then value end) as p95, max(case when i = floor(0.99 * n)::BIGINT then value end) as p99 from r group by 1")
def latency_percentiles(spark, sf):
    return evaluation.percentiles_by_index(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("strategy_counts", "select coalesce(event_type, 'unknown') as strategy, count(*) as n, round(avg(coalesce(value, 0)), 6) as mean_value, sum((value > 5)::INT)::BIGINT as rich from events group by 1")
def strategy_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("strategy")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("value", F.lit(0.0))), 6).alias("mean_value"), F.sum((F.col("value") > 5).cast("int")).alias("rich"))


@query("source_distribution", "select source, count(*) as n, round(100 * count(*) / (select count(*) from documents), 6)::DOUBLE as percent, round(avg(n_chars), 6) as mean_score from documents group by 1")
def source_distribution(spark, sf):
    rows = evaluation.source_distribution(table(spark, sf, "documents").select("source", F.col("n_chars").alias("score")))
    return rows.select("source", "n", F.round("percent", 6).alias("percent"), F.round("mean_score", 6).alias("mean_score"))


@query("newest_history", "select event_type, event_id, rn::INT as place from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) rn from events) where rn <= 20")
def newest_history(spark, sf):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("place", F.row_number().over(w)).filter("place <= 20").select("event_type", "event_id", "place")


@query("entity_coverage", "with m as (select distinct l_orderkey c, l_partkey e from lineitem), f as (select e, count(*) n from m group by 1) select round(avg(n), 6) as mean_frequency, (select count(distinct c) from m) as documents, count(*) as entities from f")
def entity_coverage(spark, sf):
    m = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    f = m.groupBy("l_partkey").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_frequency"), F.count("*").alias("entities"))
    return f.crossJoin(m.agg(F.count_distinct("l_orderkey").alias("documents"))).select("mean_frequency", "documents", "entities")


@query("chunk_quality", "select source, count(*) as n, round(avg(n_chars / 4.0), 6)::DOUBLE as mean_tokens, case when avg(n_chars) = 0 then 'FAIL' when avg(n_chars / 4.0) between 256 and 512 then 'PASS' else 'WARN' end as verdict, round(avg(regexp_matches(trim(text), '[.!?]$')::INT), 6)::DOUBLE as ends_well from documents group by 1")
def chunk_quality(spark, sf):
    mean = F.avg(F.col("n_chars") / 4)
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.round(mean, 6).alias("mean_tokens"), F.when(F.avg("n_chars") == 0, "FAIL").when(mean.between(256, 512), "PASS").otherwise("WARN").alias("verdict"), F.round(F.avg(F.trim("text").rlike("[.!?]$").cast("int")), 6).alias("ends_well")
    )


@query("json_props", "select event_id, json_extract_string(props, '$.k') as k from events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("grid_layout", "with n as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 i, ceil(sqrt(count(*) over (partition by source)))::INT cols from documents) select source, doc_id, (i % cols)::INT as x, (i // cols)::INT as y from n")
def grid_layout(spark, sf):
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    cols = F.ceil(F.sqrt(F.count("*").over(Window.partitionBy("source")))).cast("int")
    return table(spark, sf, "documents").withColumns({"i": i, "cols": cols}).select("source", "doc_id", (F.col("i") % F.col("cols")).cast("int").alias("x"), F.floor(F.col("i") / F.col("cols")).cast("int").alias("y"))


# --- storage ------------------------------------------------------------------------------------------------------------------


@query("upsert_latest", "select c_custkey, max(o_orderkey) as o_orderkey from (select o_custkey c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) where n = 1 group by 1")
def upsert_latest(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return storage.latest(rows, ["c_custkey"], "o_orderdate", "o_orderkey").select("c_custkey", "o_orderkey")


@query("upsert_documents", "select d.doc_id, case when l.doc_id is null then d.source else 'changed' end as source, d.lang as lang from documents d left join labels l using (doc_id) union all select -1, 'changed', 'en'")
def upsert_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    changes = table(spark, sf, "labels").select("doc_id", F.lit("changed").alias("source"), F.lit("xx").alias("lang"))
    new = spark.createDataFrame([(-1, "changed", "en")], docs.schema)
    return storage.upsert(docs, changes.unionByName(new), "doc_id", keep=["lang"])


@query("cascade_delete", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return storage.delete_cascade(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey", gone)[1].select("o_orderkey", "o_custkey")


@query("orphan_delete", "with c as (select distinct l_suppkey % 50 d, l_orderkey e from lineitem), g as (select d from c where d < 10) select distinct e as entity_id from c where d in (select d from g) and e not in (select e from c where d not in (select d from g))")
def orphan_delete(spark, sf):
    """Suppliers' groups as documents, orders as entities: those that only deleted documents contain."""
    own = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("document_id"), F.col("l_orderkey").alias("entity_id")).distinct()
    gone = own.filter("document_id < 10").select("document_id").distinct()
    return storage.orphans(own.select("entity_id").distinct(), own, gone)


@query("merge_edges", "with e as (select l_orderkey src, l_partkey dst, l_returnflag type, l_linenumber seq, l_quantity weight from lineitem) select src, dst, type, seq, weight from e join (select p_partkey from part where p_size > 10) on p_partkey = dst qualify row_number() over (partition by src, type, dst order by seq desc, weight desc) = 1")
def merge_edges(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("weight"))
    nodes = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id")).union(table(spark, sf, "orders").select("o_orderkey"))
    known = e.join(table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("dst")), "dst", "left_semi")
    return storage.merge_edges(known, nodes.union(known.select("src"))).select("src", "dst", "type", "seq", "weight")


@query("array_contains_scan", "select o_orderkey as document_id, (select count(*) from (select distinct l_partkey from lineitem where l_orderkey = o_orderkey)) as n_entities from orders where o_orderkey in (select l_orderkey from lineitem where l_partkey = 5)")
def array_contains_scan(spark, sf):
    lines = table(spark, sf, "lineitem")
    own = lines.join(lines.filter("l_partkey = 5").select("l_orderkey").distinct(), "l_orderkey", "left_semi")
    sets = own.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.collect_set("l_partkey").alias("entity_ids"))
    return sets.filter(F.array_contains("entity_ids", 5)).select("document_id", F.size("entity_ids").cast("long").alias("n_entities"))


@query("point_lookup", "select doc_id, source, lang from documents where doc_id = 17")
def point_lookup(spark, sf):
    return table(spark, sf, "documents").filter("doc_id = 17").select("doc_id", "source", "lang").limit(1)


@query("fallback_read", "with p as (select doc_id, 'labels' store from labels where quality = 2), s as (select doc_id, 'documents' store from documents where lang = 'fr') select * from p union all select * from s where not exists (select 1 from p)")
def fallback_read(spark, sf):
    """The second store counts only if the first has no row at all."""
    first = table(spark, sf, "labels").filter("quality = 2").select("doc_id", F.lit("labels").alias("store"), F.lit(0).alias("p"))
    second = table(spark, sf, "documents").filter("lang = 'fr'").select("doc_id", F.lit("documents").alias("store"), F.lit(1).alias("p"))
    both = first.unionByName(second)
    least = both.agg(F.min("p").alias("least"))
    return both.join(F.broadcast(least), F.col("p") == F.col("least")).select("doc_id", "store")


@query("search_box", "select doc_id from documents where contains(lower(source), 'src1') or contains(lower(text), 'idiot')")
def search_box(spark, sf):
    return table(spark, sf, "documents").filter(F.lower("source").contains("src1") | F.lower("text").contains("idiot")).select("doc_id")


@query("node_sizes", "with m as (select l_partkey e, count(distinct l_orderkey) n from lineitem group by 1) select e as id, least(20 + 5 * n, 60)::BIGINT as size from m")
def node_sizes(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_orderkey").alias("n"))
    return m.select("id", F.least(20 + 5 * F.col("n"), F.lit(60)).cast("long").alias("size"))


ADAPTIVE = " ".join(f"when {any_('lower(q)', w)} then {v}" for w, v in values.ADAPTIVE)


@query("adaptive_weights", f"with {SOURCE} select q, (case {ADAPTIVE} else 0.7 end)::DOUBLE as vector_weight from t")
def adaptive_weights(spark, sf):
    return texts(spark, sf).select("q", qu.vector_weight(F.col("q")).cast("double").alias("vector_weight"))
