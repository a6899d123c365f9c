"""Registered queries: extraction, chunk trees, id maps, vector storage, summaries of results and of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool import values
from tidepool.functions import blocks, scoring, temporal, text as tx
from tidepool.operators import chunking, evaluation, graph, links, retrieval, storage
from tidepool.operators.skew import FEW_ROWS
from tidepool.plans.analysis import SOURCE, texts
from tidepool.plans.graph import M_SQL, S_SQL, mentions, strong_edges
from tidepool.plans.registry import query, values_sql
from tidepool.session import stored, table

six = lambda c, name: F.round(c, 6).alias(name)
#: A document with headers, code, a table and dates around its whole text, the same in both engines.
HEAD = "'intro' || chr(10) || '# ' || source || chr(10) || text || chr(10) || '## Code' || chr(10) || '```python' || chr(10) || 'x = ''' || lang || '''' || chr(10) || '```' || chr(10) || '| a | b |' || chr(10) || '| - | - |' || chr(10) || '| 1 | ' || doc_id || ' |' || chr(10) || '### Deep' || chr(10) || chr(10) || 'tail'"


def marked(docs):
    parts = ["intro\n# ", F.col("source"), "\n", F.col("text"), "\n## Code\n```python\nx = '", F.col("lang"), "'\n```\n| a | b |\n| - | - |\n| 1 | ", F.col("doc_id").cast("string"), " |\n### Deep\n\ntail"]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("chunk_tree_nodes")
def chunk_tree_nodes(spark, sf):
    """Summaries, code, tables and packed paragraphs along the tree of headers; sequential within a document, so tested on texts."""
    docs = table(spark, sf, "documents")
    rows = chunking.tree_chunks(docs.withColumn("marked", marked(docs)), 400, 50, text_col="marked", title=F.concat_ws("/", "source", "doc_id"))
    return rows.select("doc_id", "chunk_index", "kind", "node", "parent", "level", "title", F.md5("content").alias("digest"), "tokens")


#: Whole texts in a frame of headers, code and a table.
MARKED = "('intro' || chr(10) || '# ' || source || chr(10) || text || chr(10) || '## Code' || chr(10) || '```python' || chr(10) || 'x = ''' || lang || '''' || chr(10) || '```' || chr(10) || '| a | b |' || chr(10) || '| - | - |' || chr(10) || '| 1 | ' || doc_id || ' |' || chr(10) || '### Deep' || chr(10) || chr(10) || 'tail')"
TABLE = r"(\|.*\|[\s\S]*?\n)(?:\|.*\|.*\n)+"
BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"


@query("table_blocks", f"select doc_id, (unnest(generate_series(1, len(t))) - 1)::INT as pos, regexp_replace(unnest(t), '{BLANKS}$', '') as content from (select doc_id, regexp_extract_all({MARKED}, '{TABLE}', 0) t from documents)")
def table_blocks(spark, sf):
    docs = table(spark, sf, "documents")
    return chunking.tables(docs, marked(docs))


@query("text_without_blocks", f"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({MARKED}, '```[\\s\\S]*?```', '', 'g'), '{TABLE}', '', 'g'), '^{BLANKS}', ''), '{BLANKS}$', '')) as digest from documents")
def text_without_blocks(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(blocks.without_blocks(marked(docs))).alias("digest"))


@query("summaries", "select doc_id, md5(case when length(f) > 300 then f[1:300] || '...' else f end) as digest from (select doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))[1] f from documents)")
def summaries(spark, sf):
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(chunking.summary(t)).alias("digest"))


@query("chunk_overlaps")
def chunk_overlaps(spark, sf):
    """Share of each chunk that repeats the one before it: strings compared in turn, tested on texts."""
    rows = evaluation.chunk_overlap(chunking.chunk(table(spark, sf, "documents"), "semantic"))
    return rows.select("doc_id", "chunk_index", six(F.col("percent"), "percent"))


@query("document_chunks", "select doc_id, source from documents where source = 'src3' order by doc_id")
def document_chunks(spark, sf):
    """The chunks of one document, in order."""
    return table(spark, sf, "documents").filter("source = 'src3'").orderBy("doc_id").select("doc_id", "source")


# --- extraction ------------------------------------------------------------------------------------------------------------------

TECH = "text || ' The transformer model uses PyTorch, and ' || source || ' needs redis with a Vector  Database; GPT-4 and few-shot retrieval on AWS.'"
FOUND = f"""fd as (select doc_id, source, i, j, trim(m) nm, kind, lower(t) low from (select doc_id, source, t, i, kind, unnest(ms) m, unnest(generate_series(1, len(ms))) j from (select doc_id, source, {TECH} t, i, kind, regexp_extract_all({TECH}, p, 0, 'i') ms from documents, {values_sql([(i, p, k) for i, (p, k) in enumerate(values.TECHNICAL)], 'v(i, p, kind)')}))),
on1 as (select doc_id, source, lower(nm) key, min(i * 100000 + j) pos, arg_min(nm, i * 100000 + j) nm, arg_min(kind, i * 100000 + j) kind, any_value(low) low from fd where length(nm) between 3 and 99 group by 1, 2, 3)"""


def tech_chunks(spark, sf):
    t = F.concat("text", F.lit(" The transformer model uses PyTorch, and "), "source", F.lit(" needs redis with a Vector  Database; GPT-4 and few-shot retrieval on AWS."))
    return table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_index"), t.alias("content"))


@query("extract_entities", f"with {FOUND} select source as document_id, key, arg_min(nm, doc_id) as name, arg_min(kind, doc_id) as type, count(distinct doc_id) as frequency from on1 group by 1, 2")
def extract_entities(spark, sf):
    return graph.extract_graph(tech_chunks(spark, sf))[0]


@query("extract_relations", f"with {FOUND} select a.source as document_id, a.key as src, b.key as dst, 'CO_OCCURS' as type, count(*) as weight from on1 a join on1 b on a.doc_id = b.doc_id and a.pos < b.pos and abs(instr(a.low, a.key) - instr(b.low, b.key)) < 200 group by 1, 2, 3")
def extract_relations(spark, sf):
    return graph.extract_graph(tech_chunks(spark, sf))[1]


@query("resolve_names", "with r as (select distinct upper(a.p_name) s, b.p_name || case when b.p_size > 25 then '' else '?' end d, a.p_type t from part a join part b on b.p_partkey = a.p_partkey + 1), e as (select lower(p_name) k, min(p_partkey) id from part group by 1) select x.id as src, y.id as dst, t as type from r join e x on x.k = lower(s) join e y on y.k = lower(d) where x.id <> y.id")
def resolve_names(spark, sf):
    parts = table(spark, sf, "part")
    nxt = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.when(F.col("p_size") > 25, "").otherwise("?")).alias("dst"))
    rel = parts.join(nxt, "p_partkey").select(F.upper("p_name").alias("src"), "dst", F.col("p_type").alias("type")).distinct()
    return graph.resolve_names(rel, parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("relation_counts", "select l_suppkey as src, l_partkey as dst, l_returnflag as type, count(*) as weight from lineitem group by 1, 2, 3")
def relation_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type")).agg(F.count("*").alias("weight"))


@query("entities_by_frequency", f"with {M_SQL} select e as entity_id, count(*) as frequency, row_number() over (order by count(*) desc, e)::INT as place from m group by 1 order by 2 desc, 1 limit 100")
def entities_by_frequency(spark, sf):
    """The hundred commonest entities in order."""
    top = mentions(spark, sf).groupBy("entity_id").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "entity_id").limit(100)
    return retrieval.ranked(top.withColumn("one", F.lit(1)), ["one"], "frequency", "entity_id", "place").drop("one")


@query("name_lengths", "select p_partkey, p_name from part where length(trim(p_name)) > 2 and length(trim(p_name)) < 100")
def name_lengths(spark, sf):
    return table(spark, sf, "part").filter(F.length(F.trim("p_name")).between(3, 99)).select("p_partkey", "p_name")


@query("entity_box", "select p_partkey, p_name from part where contains(lower(p_name), 'an') or contains(lower(p_type), 'an') order by p_partkey limit 50")
def entity_box(spark, sf):
    """The first 50 entities whose name or type has the text of the box."""
    return table(spark, sf, "part").filter(F.lower("p_name").contains("an") | F.lower("p_type").contains("an")).orderBy("p_partkey").limit(50).select("p_partkey", "p_name")


@query("edge_widths", f"with {S_SQL} select src, dst, least(1 + w, 5)::BIGINT as width from s")
def edge_widths(spark, sf):
    return strong_edges(spark, sf).select("src", "dst", F.least(1 + F.col("weight"), F.lit(5)).cast("long").alias("width"))


@query("document_relations", f"with {S_SQL}, d as (select distinct o_custkey d, e from orders join m on c = o_orderkey where o_custkey % 100 = 0) select distinct x.d as document_id, src, dst, s.w as weight from s join d x on x.e = src join d y on y.e = dst and y.d = x.d")
def document_relations(spark, sf):
    """Edges with both ends in one document, for the documents whose id is divisible by 100."""
    own, m = table(spark, sf, "orders").filter("o_custkey % 100 = 0"), mentions(spark, sf)
    d = own.join(m, own.o_orderkey == m.chunk_id).select(F.col("o_custkey").alias("document_id"), "entity_id").distinct()
    a, b = d.withColumnRenamed("entity_id", "src"), d.withColumnRenamed("entity_id", "dst")
    return strong_edges(spark, sf).join(a, "src").join(b, ["document_id", "dst"]).select("document_id", "src", "dst", "weight").distinct()


# --- id maps and vectors -----------------------------------------------------------------------------------------------------------

EXP = f"""{M_SQL}, sd as (select p_partkey e from part where p_partkey % 500 = 0), h1 as (select distinct sd.e s, y.e from sd join m x using (e) join m y on y.c = x.c where y.e <> sd.e), h2 as (select distinct s, y.e from h1 join m x on x.e = h1.e join m y on y.c = x.c where y.e <> s),
al as (select e, 1 d from h1 union all select e, 2 from h2)"""


@query("expand_seeds", f"with {EXP} select e as entity_id, min(d)::INT as distance, (1.0 / min(d))::DOUBLE as weight from al where e not in (select e from sd) group by 1")
def expand_seeds(spark, sf):
    seeds = table(spark, sf, "part").filter("p_partkey % 500 = 0").select(F.col("p_partkey").alias("entity_id"))
    return links.expand_seeds(mentions(spark, sf), seeds, 2)


V_SQL = f"{M_SQL}, vc as (select vec_id v, min(c) c from embeddings join (select distinct c from m) on c = vec_id group by 1)"


@query("vector_nodes", f"with {V_SQL} select v as vector_id, c as chunk_id, coalesce((select string_agg(e::VARCHAR, ',' order by e) from m where m.c = vc.c), '') as entity_ids, coalesce((select string_agg(distinct l_suppkey::VARCHAR, ',') from lineitem where false), '') as node_ids from vc")
def vector_nodes(spark, sf):
    m = mentions(spark, sf)
    v = table(spark, sf, "embeddings").join(m.select("chunk_id").distinct(), F.col("vec_id") == F.col("chunk_id")).select(F.col("vec_id").alias("vector_id"), "chunk_id")
    nodes = m.limit(0).select("chunk_id", F.col("entity_id").alias("node_id"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return links.nodes_of_vectors(v, m, nodes).select("vector_id", "chunk_id", joined("entity_ids"), joined("node_ids"))


@query("hybrid_chunk_scores", f"with {M_SQL}, g as (select c, max(coalesce(l, 0.5)) w from (select c, (e % 10) / 10.0 l from m where c % 3 = 0) group by 1), v as (select vec_id c, label::DOUBLE s from embeddings) select coalesce(v.c, g.c) as chunk_id, round(0.7 * coalesce(s, 0) + 0.3 * coalesce(w, 0), 6)::DOUBLE as score from v full join g on v.c = g.c")
def hybrid_chunk_scores(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("double").alias("score"))
    g = mentions(spark, sf).filter("chunk_id % 3 = 0").groupBy(((F.col("entity_id") % 10) / 10).alias("weight")).agg(F.collect_set("chunk_id").alias("chunk_ids"))
    return links.hybrid_scores(v, g).select("chunk_id", six(F.col("score"), "score"))


@query("ingest_links", "with c as (select o_custkey d, o_orderkey c from orders), m as (select distinct l_orderkey c, l_partkey e from lineitem), n as (select distinct l_orderkey c, l_suppkey n from lineitem), l as (select 'document' a, d::VARCHAR b, 'chunk' x, c::VARCHAR y, 'contains' r from c union all select 'document', d::VARCHAR, 'entity', e::VARCHAR, 'mentions' from c join m using (c) union all select 'chunk', c::VARCHAR, 'vector', 'v' || c, 'embeds' from c union all select 'chunk', c::VARCHAR, 'entity', e::VARCHAR, 'mentions' from c join m using (c) union all select 'chunk', c::VARCHAR, 'graph_node', n::VARCHAR, 'represents' from c join n using (c) union all select 'chunk', c::VARCHAR, 'chunk', (c - 1)::VARCHAR, 'parent' from c where c % 4 <> 0) select a as a_type, x as b_type, r as relation, count(*) as n, sum(hash_ok)::BIGINT as ids from (select distinct *, (length(b) + length(y)) hash_ok from l) group by 1, 2, 3")
def ingest_links(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("c")).agg(F.collect_set("l_partkey").alias("entity_ids"), F.collect_set("l_suppkey").alias("node_ids"))
    own = table(spark, sf, "orders").join(rows, F.col("c") == F.col("o_orderkey"), "left")
    chunks = own.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") - 1).alias("parent_id"), F.concat(F.lit("v"), "o_orderkey").alias("vector_id"), "entity_ids", "node_ids")
    return links.ingest_links(chunks).groupBy("a_type", "b_type", "relation").agg(F.count("*").alias("n"), F.sum(F.length("a_id") + F.length("b_id")).cast("long").alias("ids"))


@query("bulk_links", "select count(*) as n from orders")
def bulk_links(spark, sf):
    own = links.make_links(table(spark, sf, "orders"), "document", "o_custkey", "chunk", "o_orderkey", "contains")
    return links.add_and_count(own.limit(10), own)[1]


@query("vectors_upserted", "select vec_id as chunk_id, case when vec_id % 3 = 0 then 'new' else 'old' end as state, case when vec_id % 3 = 0 then 1 else label end::INT as label from embeddings where vec_id % 5 <> 0")
def vectors_upserted(spark, sf):
    """Every third vector written anew, every fifth deleted."""
    e = table(spark, sf, "embeddings")
    store = e.select(F.col("vec_id").alias("chunk_id"), F.lit("old").alias("state"), "label")
    part = e.filter("vec_id % 3 = 0")
    new = storage.upsert_vectors(store, part.select(F.col("vec_id").alias("chunk_id"), F.lit("new").alias("state")), part.select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("label")))
    return storage.delete_vectors(new, e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("chunk_id")))


@query("payload_refreshed", f"with {M_SQL} select vec_id as chunk_id, (select string_agg(e::VARCHAR, ',' order by e) from m where c = vec_id) as entity_ids, (select string_agg(n::VARCHAR, ',' order by n) from (select distinct l_suppkey n from lineitem where l_orderkey = vec_id)) as graph_node_ids from embeddings")
def payload_refreshed(spark, sf):
    store = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    nodes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("node_id")).distinct()
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return storage.refresh_payload(store, mentions(spark, sf), nodes).select("chunk_id", joined("entity_ids"), joined("graph_node_ids"))


@query("cleared", "select 'orders' as \"table\", count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'part', count(*) from part")
def cleared(spark, sf):
    return storage.clear({n: table(spark, sf, n) for n in ("orders", "lineitem", "part")})[1]


@query("start_entities", f"with {M_SQL}, n as (select c % 10 q, e, 0.5 conf from m where c % 100 = 0), k as (select p_partkey % 10 q, p_partkey e, 0.9 conf from part where p_size < 3) select q as query_id, e as id, max(conf)::DOUBLE as confidence from (select * from n union all select * from k) group by 1, 2 qualify row_number() over (partition by q order by max(conf) desc, e) <= 10")
def start_entities(spark, sf):
    near = mentions(spark, sf).filter("chunk_id % 100 = 0").select((F.col("chunk_id") % 10).alias("query_id"), F.col("entity_id").alias("id"), F.lit(0.5).alias("confidence"))
    named = table(spark, sf, "part").filter("p_size < 3").select((F.col("p_partkey") % 10).alias("query_id"), F.col("p_partkey").alias("id"), F.lit(0.9).alias("confidence"))
    return graph.start_entities(near, named)


@query(
    "path_contexts",
    f"""with {M_SQL}, p as (select o_custkey q, o_orderkey k, o_orderpriority ch, row_number() over (partition by o_custkey order by o_orderkey) rk from orders where o_custkey % 100 = 0 qualify rk <= 3),
no as (select q, rk, e, row_number() over (partition by q, rk order by e) pl from p join m on c = k), ch as (select p_partkey id, t.pos, p_size * 10 + t.pos cid, repeat(p_name || ' ', 60) txt from part, (values (0), (1), (2)) t(pos)),
ev as (select q, cid, min((rk, pl, pos, txt[1:500])) x from no join ch on id = e where pos < 2 group by 1, 2), pc as (select q, rk, 0 a, 0 b, 'Reasoning path: ' || ch t from p union all select q, x[1], x[2], x[3], 'Evidence: ' || x[4] from ev)
select q as query_id, md5(string_agg(t, chr(10) || chr(10) order by rk, a, b, t)) as digest from pc group by 1""".replace("x[1]", "struct_extract(x, 1)").replace("x[2]", "struct_extract(x, 2)").replace("x[3]", "struct_extract(x, 3)").replace("x[4]", "struct_extract(x, 4)"),
)
def path_contexts(spark, sf):
    """Orders as paths of their parts, parts' chunks as evidence."""
    orders = table(spark, sf, "orders").filter("o_custkey % 100 = 0").select(F.col("o_custkey").alias("query_id"), "o_orderkey", F.col("o_orderpriority").alias("chain"))
    first = stored(retrieval.ranked(orders.withColumn("score", -F.col("o_orderkey")), ["query_id"], tie="o_orderkey").filter("rank <= 3"), "first")
    asked = first.select("o_orderkey")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    own = rows.join(F.broadcast(asked) if asked.count() <= FEW_ROWS else asked, "o_orderkey", "left_semi")
    nodes = own.groupBy("o_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("nodes"))
    paths = first.join(nodes, "o_orderkey", "left")
    pos = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos")
    chunks = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), pos, "p_size", F.expr("repeat(concat(p_name, ' '), 60)").alias("content")).withColumn("chunk_id", F.col("p_size") * 10 + F.col("pos"))
    return graph.path_contexts(paths, chunks).select("query_id", F.md5("context").alias("digest"))


@query("path_answers", f"select o_orderkey, md5(case when o_orderkey % 7 = 0 then 'Unable to find relevant information to answer this question.' else 'Based on the knowledge graph traversal, I found the following connection:' || chr(10) || o_orderpriority || chr(10) || chr(10) || 'This shows that:' || chr(10) || '- a R ' || o_custkey || chr(10) || chr(10) || 'Confidence in this answer: ' || printf('%.1f', ((o_orderkey % 100) * 1.0)::DOUBLE) || '%' end) as digest from orders")
def path_answers(spark, sf):
    k = F.col("o_orderkey")
    edges = F.array(F.struct(F.lit("a").alias("src"), F.lit("R").alias("type"), F.col("o_custkey").cast("string").alias("dst")))
    chain = F.when(k % 7 != 0, F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", F.md5(graph.path_answer(chain, edges, (k % 100) / 100)).alias("digest"))


# --- summaries ---------------------------------------------------------------------------------------------------------------------

RES = "r as (select (doc_id // 10) q, row_number() over (partition by doc_id // 10 order by doc_id) rank, case doc_id % 3 when 0 then 'vector' when 1 then 'graph' else 'hybrid' end s, (n_chars % 100)::DOUBLE sc, source d, case when doc_id % 4 = 0 then '' else lang end en from documents)"


def results(spark, sf):
    i = F.col("doc_id")
    docs = table(spark, sf, "documents").select(F.floor(i / 10).alias("query_id"), "doc_id", F.when(i % 3 == 0, "vector").when(i % 3 == 1, "graph").otherwise("hybrid").alias("source"), (F.col("n_chars") % 100).cast("double").alias("score"), F.col("source").alias("document_id"), F.when(i % 4 == 0, "").otherwise(F.col("lang")).alias("entity_id"))
    return retrieval.ranked(docs.withColumn("_o", -i), ["query_id"], "_o")


N_OF = ", ".join(f"sum((s = '{k}')::INT)::BIGINT n_{k}" for k in ("vector", "graph", "hybrid"))


@query("source_overview", f"with {RES}, g as (select q, count(*) n, {N_OF}, avg(sc) m, coalesce(avg(case when s = 'vector' then sc end), 0) mv, coalesce(avg(case when s = 'graph' then sc end), 0) mg, sum((s = 'vector' and rank <= 3)::INT) tv, sum((s = 'graph' and rank <= 3)::INT) tg, sum((s = 'hybrid' and rank <= 3)::INT) th from r group by 1) select q as query_id, n, n_vector, n_graph, n_hybrid, round(100 * n_vector / n, 6)::DOUBLE as percent_vector, round(100 * n_graph / n, 6)::DOUBLE as percent_graph, round(100 * n_hybrid / n, 6)::DOUBLE as percent_hybrid, round(m, 6) as mean_score, round(mv, 6) as mean_vector, round(mg, 6) as mean_graph, case when tv >= greatest(tg, th) then 'vector' when tg >= th then 'graph' else 'hybrid' end as top_source from g")
def source_overview(spark, sf):
    rows = evaluation.source_overview(results(spark, sf))
    return rows.select("query_id", "n", "n_vector", "n_graph", "n_hybrid", *(six(F.col(c), c) for c in rows.columns if c.startswith(("percent", "mean"))), "top_source")


@query("results_summary", f"with {RES} select q as query_id, {N_OF}, round(avg(sc), 6) as mean_score, count(distinct d) as documents, count(distinct nullif(en, '')) as entities from r group by 1")
def results_summary(spark, sf):
    return evaluation.results_summary(results(spark, sf)).withColumn("mean_score", F.round("mean_score", 6))


@query("titled_results", "select d.doc_id, coalesce(u.url, 'Unknown') as title from documents d left join pages u on u.page_id = d.doc_id")
def titled_results(spark, sf):
    """Results with their documents' titles, 'Unknown' where there is none."""
    return table(spark, sf, "documents").join(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left").select("doc_id", F.coalesce("url", F.lit("Unknown")).alias("title"))


@query("corpus_totals", "select (select count(*) from orders) as chunks, (select count(*) from customer) as documents, round((select count(*) from orders) / greatest((select count(*) from customer), 1), 6)::DOUBLE as chunks_per_document, round((select count(distinct l_partkey) from lineitem) / greatest((select count(*) from customer), 1), 6)::DOUBLE as entities_per_document, (select max(n_chars // 4) from documents) as most_tokens, round((select avg(value) from events) / 1000, 6)::DOUBLE as mean_seconds")
def corpus_totals(spark, sf):
    """One row of totals and guarded ratios; mean latency once more by 1000."""
    n = lambda name, c, agg=F.count("*"): table(spark, sf, name).agg(agg.alias(c))
    row = n("orders", "chunks").crossJoin(n("customer", "documents")).crossJoin(n("lineitem", "entities", F.count_distinct("l_partkey"))).crossJoin(n("documents", "most_tokens", F.max(F.floor(F.col("n_chars") / 4)))).crossJoin(n("events", "mean", F.avg("value")))
    per = lambda c: F.col(c) / F.greatest("documents", F.lit(1))
    return row.select("chunks", "documents", six(per("chunks"), "chunks_per_document"), six(per("entities"), "entities_per_document"), "most_tokens", six(F.col("mean") / 1000, "mean_seconds"))


@query("mean_confidence", f"with {RES}, a as (select q, avg(sc) m from r group by 1) select q as query_id, s as source, sc as score, round(m, 6) as mean_of_all from r join a using (q) where rank <= 3")
def mean_confidence(spark, sf):
    """The mean over all rows of a request, then its first three."""
    rows = results(spark, sf)
    return rows.join(rows.groupBy("query_id").agg(six(F.avg("score"), "mean_of_all")), "query_id").filter("rank <= 3").select("query_id", "source", "score", "mean_of_all")


@query("entity_density", f"with {M_SQL}, d as (select o_custkey d, count(distinct e) n from orders join m on c = o_orderkey group by 1) select d as document_id, round(1000.0 * n / (d % 7 * 300), 6)::DOUBLE as per_1k, case when 1000.0 * n / (d % 7 * 300) between 15 and 30 then 'PASS' else 'WARN' end as verdict from d where d % 7 <> 0 union all select d, 0, 'FAIL' from d where d % 7 = 0")
def entity_density(spark, sf):
    own, m = table(spark, sf, "orders"), mentions(spark, sf)
    d = own.join(m, own.o_orderkey == m.chunk_id).groupBy(F.col("o_custkey").alias("document_id")).agg(F.count_distinct("entity_id").alias("n"))
    got = evaluation.graded_density(F.col("n"), F.col("document_id") % 7 * 300)
    return d.select("document_id", six(got["per_1k"].cast("double"), "per_1k"), got["verdict"].alias("verdict"))


@query("grades", "select source, case when p >= 0.9 then 'A' when p >= 0.8 then 'B' when p >= 0.7 then 'C' when p >= 0.6 then 'D' else 'F' end as grade from (select source, (100.0 * sum((doc_id % 3 <> 0)::INT) + 50.0 * sum((doc_id % 3 = 0)::INT)) / (100 * count(*)) p from documents group by 1)")
def grades(spark, sf):
    n = F.sum((F.col("doc_id") % 3 != 0).cast("int"))
    return table(spark, sf, "documents").groupBy("source").agg(scoring.evaluation_grade(n, F.count("*") - n, F.count("*")).alias("grade"))


@query("reasoning_scores", "select o_orderkey, round(((o_orderkey % 3 > 0)::INT * 1.0 + 0 + 0.5 + 1.0 / 3) / 4, 6)::DOUBLE as overall from orders")
def reasoning_scores(spark, sf):
    steps = F.array(F.when(F.col("o_orderkey") % 3 > 0, 0.9).otherwise(0.1))
    return table(spark, sf, "orders").select("o_orderkey", six(evaluation.reasoning_quality(steps, F.lit(0.5), F.lit(None).cast("double")), "overall"))


# --- texts -------------------------------------------------------------------------------------------------------------------------


@query("suggestions", f"with {SOURCE} select q, case when contains(lower(q), 'how') then q || ' work?|' || q || ' implemented?|' || q || ' configured?' when contains(lower(q), 'what') then q || ' is?|' || q || ' are the benefits?|' || q || ' are the components?' else 'How does ' || q || ' work?|What is ' || q || '?|Explain ' || q end as suggestions from t")
def suggestions(spark, sf):
    return texts(spark, sf).select("q", F.array_join(tx.suggestions(F.col("q")), "|").alias("suggestions"))


@query("marked_up", "select doc_id, md5(regexp_replace(regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi'), '(und)', '<mark>\\1</mark>', 'gi')) as digest from documents")
def marked_up(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.marked_up(F.col("text"), F.lit("the to und"))).alias("digest"))


@query("cut_texts", "select doc_id, md5(substr(text, 1, 512)) as reranked, md5(substr(text, 1, 8000)) as extracted from documents")
def cut_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.cut_to(F.col("text"), 512)).alias("reranked"), F.md5(tx.cut_to(F.col("text"), 8000)).alias("extracted"))


@query("json_replies", "select event_id, json_extract_string(props, '$.k') as k from events")
def json_replies(spark, sf):
    """The object in a reply that talks around it."""
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, sf, "events").select("event_id", F.get_json_object(tx.json_of(reply), "$.k").alias("k"))


@query("merged_metadata", "select doc_id, source as a, lang || '!' as b, lang as c from documents")
def merged_metadata(spark, sf):
    """Two maps merged, the right one winning."""
    left, right = F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.col("lang")), F.create_map(F.lit("b"), F.concat("lang", F.lit("!")), F.lit("c"), F.col("lang"))
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    m = F.map_concat(kept, right)
    return table(spark, sf, "documents").select("doc_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query("tag_lists", "select doc_id, source || ',' || lang as tags, lang as last from documents")
def tag_lists(spark, sf):
    tags = F.split(F.concat_ws(",", "source", "lang"), ",")
    return table(spark, sf, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"), F.element_at(tags, -1).alias("last"))


@query("first_documents", f"with {M_SQL} select e as entity_id, min(o_custkey) as document_id from m join orders on o_orderkey = c group by 1")
def first_documents(spark, sf):
    own, m = table(spark, sf, "orders"), mentions(spark, sf)
    ids = m.join(own, own.o_orderkey == m.chunk_id).groupBy("entity_id").agg(F.sort_array(F.collect_set("o_custkey")).alias("ids"))
    return ids.select("entity_id", F.get("ids", F.lit(0)).alias("document_id"))


DATED = "'Created: 2024-0' || (1 + doc_id % 9) || '-15' || chr(10) || text || chr(10) || 'Valid until: ' || (1 + doc_id % 12) || '/20/2024' || chr(10)"


@query(
    "temporal_metadata",
    f"""with d as (select doc_id, make_timestamp(2024, (1 + doc_id % 9)::INT, 15, 0, 0, 0) c, make_timestamp(2024, (1 + doc_id % 12)::INT, 20, 0, 0, 0) e from documents where doc_id % 2 = 0 and not regexp_matches(lower(text), 'sprint|milestone|expires?[:\\s]|valid until|deadline')),
n as (select doc_id, make_timestamp(2023, (1 + doc_id % 12)::INT, 7, 0, 0, 0) c from documents where doc_id % 2 = 1)
select doc_id, c::DATE as created, e::DATE as expires, case when e < TIMESTAMP '2024-06-15' then 'expired' else 'active' end as stage, '1.' || (doc_id % 10) as version, 'meeting' as doc_type from d
union all select doc_id, c::DATE, null, 'historical', '1.' || (doc_id % 10), 'meeting' from n""",
)
def temporal_metadata(spark, sf):
    """Dates in texts for even ids, in file names for odd ones."""
    i, month = F.col("doc_id"), lambda n: (1 + F.col("doc_id") % n).cast("string")
    even = F.concat(F.lit("Created: 2024-0"), month(9), F.lit("-15\n"), "text", F.lit("\nValid until: "), month(12), F.lit("/20/2024\n"))
    content = F.when(i % 2 == 0, even).otherwise(F.col("text"))
    name = F.concat(F.lit("notes_v1."), (i % 10).cast("string"), F.when(i % 2 == 1, F.concat(F.lit("_2023-"), F.lpad(month(12), 2, "0"), F.lit("-07"))).otherwise(""), F.lit(".txt"))
    got = temporal.enriched({}, content, name, F.lit("2024-06-15").cast("timestamp"))
    rows = table(spark, sf, "documents").select("doc_id", got.alias("m"))
    return rows.select("doc_id", F.col("m.created_at").cast("date").alias("created"), F.col("m.expires_at").cast("date").alias("expires"), F.col("m.lifecycle_stage").alias("stage"), F.col("m.version").alias("version"), F.col("m.doc_type").alias("doc_type"))


@query("id_union", "select l_suppkey as id from lineitem union select l_partkey from lineitem")
def id_union(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select(F.col("l_suppkey").alias("id")).union(t.select("l_partkey")).distinct()
