"""Registered queries: lookups, shares, groupings and files over whole tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidepool import values
from tidepool.functions import scoring
from tidepool.operators import chunking, evaluation, graph, links
from tidepool.plans.graph import M_SQL, mentions, strong_edges
from tidepool.plans.pipelines import COS
from tidepool.plans.registry import query, quoted
from tidepool.plans.retrieval import query_vectors, vectors
from tidepool.plans.text import SECTIONS, markdown
from tidepool.session import scratch, table
from tidepool.sources import files


@query(
    "vector_chunks",
    f"""with v as (select q.vec_id qi, e.vec_id vi, {COS} s, row_number() over (partition by q.vec_id order by {COS} desc, e.vec_id) rank from embeddings e, embeddings q where q.vec_id % 100 = 0 qualify rank <= 10),
m as (select distinct l_orderkey c, l_partkey e from lineitem), o as (select o_orderkey, o_custkey from orders)
select qi as query_id, rank::INT as rank, vi as vector_id, round(s, 6) as score, coalesce((select string_agg(e, ',' order by e) from m where c = vi), '') as entity_ids, coalesce((select string_agg(o_custkey, ',' order by o_custkey) from o where o_orderkey = vi), '') as node_ids from v""",
)
def vector_chunks(spark, sf):
    """The ten nearest vectors of every hundredth one, with the parts and the customer of the order of that number."""
    v = vectors(spark, sf).select("doc_id", "embedding")
    owners = v.select(F.col("doc_id").alias("vector_id"), F.col("doc_id").alias("chunk_id")).filter("vector_id % 2 = 0")
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("node_id"))
    rows = links.chunks_of_search(v, query_vectors(spark, sf), owners, mentions(spark, sf), nodes)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("query_id", "rank", "vector_id", F.round("score", 6).alias("score"), text("entity_ids"), text("node_ids"))


@query(
    "entity_search",
    """with q as (select p_partkey qi, lower(string_split(p_name, ' ')[2]) q, case when p_partkey % 200 = 0 then p_type end ty from part where p_partkey % 100 = 0)
select qi as query_id, row_number() over (partition by qi order by (lower(p_name) <> q)::INT, p_partkey)::INT as rank, p_partkey as id, p_name as name, p_type as type from q join part on contains(lower(p_name), q) and (ty is null or ty = p_type) qualify rank <= 10""",
)
def entity_search(spark, sf):
    """The second word of every hundredth part's name, with its type for half of them."""
    part = table(spark, sf, "part")
    asked = part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.split("p_name", " ")[1].alias("query"), F.when(F.col("p_partkey") % 200 == 0, F.col("p_type")).alias("type"))
    return graph.entity_search(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")), asked)


@query(
    "grouped_mentions",
    """with r as (select l_suppkey d, p_name nm, p_type ty from lineitem join part on p_partkey = l_partkey), c as (select l_suppkey d, count(distinct l_orderkey) n, min(l_orderkey) lo from lineitem group by 1)
select d as document_id, lower(nm) as key, min(nm) as name, lower(ty) as type, count(*) as frequency, any_value(n) as n_chunks, any_value(lo) as first_chunk from r join c using (d) group by 1, 2, 4""",
)
def grouped_mentions(spark, sf):
    """Replies made of each supplier's parts, as JSON after some words."""
    part = table(spark, sf, "part")
    own = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    replies = own.groupBy(F.col("l_suppkey").alias("document_id"), "l_orderkey").agg(F.concat(F.lit("Here they are: "), F.to_json(F.collect_list(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type")))), F.lit(" done")).alias("reply"))
    rows = graph.grouped_mentions(replies.select("document_id", "reply"), own.select(F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("chunk_id")))
    return rows.select("document_id", "key", "name", "type", "frequency", F.size("chunk_ids").cast("long").alias("n_chunks"), F.col("chunk_ids")[0].alias("first_chunk"))


@query("chunk_children", f"with {SECTIONS}, p as (select a.doc_id, a.section, (select max(b.section) from sec b where b.doc_id = a.doc_id and b.section < a.section and b.lvl < a.lvl) as parent from sec a) select doc_id, parent as section, string_agg(section, ',' order by section) as children from p where parent is not null group by 1, 2")
def chunk_children(spark, sf):
    """The sections right under each section."""
    rows = chunking.children(chunking.parents(chunking.header_sections(table(spark, sf, "documents"), markdown())))
    return rows.select("doc_id", F.col("section").cast("int").alias("section"), F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


BAD = f"((not regexp_matches(t, {quoted(values.GOOD_START)}) and not ({' or '.join(f'starts_with(t, {quoted(w)})' for w in values.CONTINUED)}))::INT + (not regexp_matches(t, {quoted(values.GOOD_END)}))::INT)"


@query("boundary_preservation", f"with c as (select source, trim(unnest(string_split(text, chr(10)))) t from documents), r as (select source, count(*) n, 1 - sum(0.5 * {BAD}) / count(*) rate from c where length(t) > 0 group by 1) select source, n, round(rate, 6)::DOUBLE as rate, case when rate >= 0.95 then 'PASS' when rate >= 0.8 then 'WARN' else 'FAIL' end as verdict from r")
def boundary_preservation(spark, sf):
    """Lines as chunks, by source."""
    rows = table(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("content"))
    return evaluation.boundary_preservation(rows, ["source"]).select("source", "n", F.round("rate", 6).alias("rate"), "verdict")


@query("result_shares", "with k as (select doc_id % 97 q, count(*) n from documents where source = 'src3' or doc_id % 5 = 0 group by 1), a as (select distinct doc_id % 97 q from documents) select count(*) as requests, round(avg((coalesce(n, 0) > 5)::INT), 6)::DOUBLE as rich, round(avg((coalesce(n, 0) = 0)::INT), 6)::DOUBLE as empty from a left join k using (q)")
def result_shares(spark, sf):
    """Shares of requests with over five and with no results."""
    docs = table(spark, sf, "documents").withColumn("q", F.col("doc_id") % 97)
    found = docs.filter("source = 'src3' or doc_id % 5 = 0").groupBy("q").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    rows = docs.select("q").distinct().join(found, "q", "left").agg(F.count("*").alias("requests"), F.avg((n > 5).cast("int")).alias("rich"), F.avg((n == 0).cast("int")).alias("empty"))
    return rows.select("requests", F.round("rich", 6).alias("rich"), F.round("empty", 6).alias("empty"))


@query("json_round_trip", "select doc_id, source, lang, n_chars::VARCHAR as n_chars, null::VARCHAR as missing from documents")
def json_round_trip(spark, sf):
    """Metadata as JSON text and back: a map of open keys."""
    coded = table(spark, sf, "documents").select("doc_id", F.to_json(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang", F.lit("n_chars"), F.col("n_chars").cast("string"))).alias("json"))
    m = F.from_json("json", "map<string,string>")
    return coded.select("doc_id", *(F.element_at(m, k).alias(k) for k in ("source", "lang", "n_chars", "missing")))


@query("relations_by_weight", f"with {M_SQL}, ed as (select x.e src, y.e dst, count(*) w from m x join m y on x.c = y.c and x.e < y.e group by 1, 2 having count(*) >= 2) select src, dst, w as weight, row_number() over (order by w desc, src, dst)::INT as place from ed order by w desc, src, dst limit 100")
def relations_by_weight(spark, sf):
    """The hundred heaviest relations in order."""
    top = strong_edges(spark, sf).orderBy(F.desc("weight"), "src", "dst").limit(100)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("weight"), "src", "dst")))


@query(
    "match_texts",
    """with r as (select event_id, floor(abs(value) % 100) s, case event_id % 3 when 0 then 'vector' when 1 then 'graph' else 'hybrid' end src, case event_id % 4 when 0 then 'exact' when 1 then 'contains' when 2 then 'traversal' else 'fuzzy' end mt, (1 + event_id % 3)::INT h from events)
select event_id, case when s >= 90 then 'Excellent match' when s >= 75 then 'Strong match' when s >= 60 then 'Good match' when s >= 40 then 'Moderate match' when s >= 25 then 'Weak match' else 'Poor match' end || ' (' || printf('%.1f', s::DOUBLE) || '%)'
|| case when src = 'graph' then case mt when 'exact' then ' - Exact entity match' when 'contains' then ' - Partial entity match' when 'traversal' then ' - Related entity (' || h || ' hop' || case when h = 1 then '' else 's' end || ')' else '' end when src = 'vector' then ' - Semantic similarity' else '' end as explanation from r""",
)
def match_texts(spark, sf):
    i = F.col("event_id")
    source = F.when(i % 3 == 0, "vector").when(i % 3 == 1, "graph").otherwise("hybrid")
    kind = F.when(i % 4 == 0, "exact").when(i % 4 == 1, "contains").when(i % 4 == 2, "traversal").otherwise("fuzzy")
    return table(spark, sf, "events").select("event_id", scoring.match_explanation(F.floor(F.abs("value") % 100).cast("double"), source, kind, (1 + i % 3).cast("int")).alias("explanation"))


@query("files_scan", "select source, 'txt' as extension, length(t) as n_chars, substr(md5(t), 1, 12) as document_id from (select source, string_agg(text, chr(10) order by doc_id) || chr(10) t from documents group by 1)")
def files_scan(spark, sf):
    """A text file for each source, written and read back as bytes."""
    path = scratch(spark, "files")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n")
    table(spark, sf, "documents").groupBy("source").agg(text.alias("value")).write.partitionBy("source").text(path)
    rows = files.load_files(spark, f"{path}/*/*.txt")
    return rows.select(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source"), "extension", F.length("text").cast("long").alias("n_chars"), "document_id")
