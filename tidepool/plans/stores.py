"""Registered queries: what committed tables and the stored keyword index hold after writes, replays and deletes over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepool.functions.text import content_id
from tidepool.operators.committed import CommittedTable, delete_document
from tidepool.operators.keyword_index import KeywordIndex
from tidepool.plans.registry import query
from tidepool.plans.retrieval import REQUEST_SQL, requests
from tidepool.session import scratch, table
from tidepool.sources import files


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", F.lit("2024-01-01").alias("created"))


@query(
    "stored_documents",
    """select doc_id, case when doc_id % 5 = 0 then md5(text || '!') else md5(text) end as text_md5, lang, case when doc_id % 5 = 0 then 'changed' else source end as source, '2024-01-01' as created from documents where doc_id % 11 <> 0
union all select -doc_id - 1, md5(text || '!'), lang, 'changed', '2025-01-01' from documents where doc_id % 5 = 0 and doc_id % 10 = 0""",
)
def stored_documents(spark, sf):
    """All documents; then every fifth anew, keeping created, and some new ones; then a delete; and all three once more, as a job that is replayed would."""
    docs = documents(spark, sf)
    store = CommittedTable(spark, scratch(spark, "documents"), docs.schema, ["doc_id"], 32)
    later = docs.filter("doc_id % 5 = 0").withColumns({"text": F.concat("text", F.lit("!")), "source": F.lit("changed"), "created": F.lit("2025-01-01")})
    both = later.unionByName(later.filter("doc_id % 10 = 0").withColumn("doc_id", -F.col("doc_id") - 1))
    for _ in range(2):
        store.upsert(docs, ("load", 0))
        store.upsert(both, ("load", 1), keep=["created"])
        store.delete(docs.filter("doc_id % 11 = 0").select("doc_id"), batch=("load", 2))
    return store.read().select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "created")


LINES = "select doc_id, unnest(generate_series(0, len(x) - 1))::INT n, unnest(x) line from (select doc_id, string_split(text, chr(10)) x from documents)"


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return rows.withColumn("chunk_id", files.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("content")))


@query("stored_chunks", f"with l as ({LINES}) select doc_id, n as chunk_index, substr(md5(doc_id || '_' || n || '_' || substr(line, 1, 50)), 1, 12) as chunk_id, md5(line) as content_md5 from l union all select doc_id, -1, 'extra', md5('more') from documents where doc_id % 3 = 0")
def stored_chunks(spark, sf):
    """Lines as chunks, inserted once; then again with other contents and a new chunk each for a third: what was there stays."""
    rows = line_chunks(spark, sf)
    store = CommittedTable(spark, scratch(spark, "chunks"), rows.schema, ["doc_id", "chunk_index"], 32, spread=["doc_id"])
    store.upsert(rows, ("load", 0), replace=False)
    again = rows.filter("doc_id % 3 = 0").withColumn("content", F.lit("other"))
    new = again.select("doc_id", F.lit(-1).alias("chunk_index"), F.lit("more").alias("content"), F.lit("extra").alias("chunk_id")).distinct()
    for _ in range(2):
        store.upsert(again.unionByName(new), ("load", 1), replace=False)
    return store.read().select("doc_id", "chunk_index", "chunk_id", F.md5("content").alias("content_md5"))


@query("stored_cascade", f"""with l as ({LINES}) select 'chunks' as "table", doc_id, count(*) as n from l where doc_id % 100 > 0 group by 2 union all select 'documents', doc_id, 1 from documents where doc_id % 100 > 0 union all select 'vectors', vec_id, 1 from embeddings where vec_id % 100 > 0""")
def stored_cascade(spark, sf):
    """Documents, their lines as chunks and their vectors, without what belongs to every hundredth document; the delete runs twice."""
    own = {"chunks": line_chunks(spark, sf), "vectors": table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "documents": documents(spark, sf)}
    keys = {"chunks": ["doc_id", "chunk_index"], "vectors": ["doc_id"], "documents": ["doc_id"]}
    stores = {n: CommittedTable(spark, scratch(spark, n), df.schema, keys[n], 32, spread=["doc_id"]) for n, df in own.items()}
    for n, df in own.items():
        stores[n].upsert(df, ("load", 0))
    for _ in range(2):
        delete_document(stores, own["documents"].filter("doc_id % 100 = 0").select("doc_id").union(own["vectors"].filter("doc_id % 100 = 0").select("doc_id")), ("delete", 0), "doc_id")
    counts = [s.read().groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "doc_id", "n") for n, s in stores.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("stored_vectors", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * case when label = 1 then 2 else 1 end, 4) as total, label from embeddings where label <> 2")
def stored_vectors(spark, sf):
    """Vectors stored, those of one label doubled, those of another deleted by label."""
    rows = table(spark, sf, "embeddings")
    store = CommittedTable(spark, scratch(spark, "vectors"), rows.schema, ["vec_id"], 16)
    store.upsert(rows, ("v", 0))
    store.upsert(rows.filter("label = 1").withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float"))), ("v", 1))
    store.delete(rows.filter("label = 2").select("label").distinct(), ["label"], ("v", 2))
    return store.read().select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), "label")


@query("evaluation_report", "select event_type as strategy, count(*) as n, round(avg(value), 6) as mean_value, round(max(value), 6) as max_value from events group by 1")
def evaluation_report(spark, sf):
    """Latency by strategy written as a JSON report over an older one, and read back."""
    path = scratch(spark, "report")
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.max("value"), 6).alias("max_value"))
    files.write_report(rows.limit(1), path)
    files.write_report(rows, path)
    return spark.read.schema("strategy string, n bigint, mean_value double, max_value double").json(path)


@query("relation_ids", "select distinct l_partkey as src, l_suppkey as dst, l_returnflag as type, substr(md5(l_partkey || '_' || l_suppkey || '_' || l_returnflag), 1, 12) as relation_id from lineitem")
def relation_ids(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    return rows.withColumn("relation_id", content_id(F.concat_ws("_", F.col("src").cast("string"), F.col("dst").cast("string"), "type")))


WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(
    "keyword_index_search",
    f"""with req as (select * from {REQUEST_SQL}), d as (select doc_id, case when doc_id % 7 = 0 then text || ' ' || lang || ' ' || lang else text end t, source || ' ' || lang title from documents where doc_id % 11 <> 0),
k as (select doc_id, {WORDS.format('t')} w, {WORDS.format('title')} h from d), n as (select count(*) n_docs, avg(len(w)) mean_len from k),
tok as (select doc_id, len(w) size, unnest(w) term, 1.0 x from k union all select doc_id, len(w), unnest(h), 0.5 from k), want as (select query_id, unnest(list_distinct({WORDS.format('query')})) term from req),
tf as (select term, doc_id, size, sum(x)::DOUBLE tf from tok where term in (select term from want) group by all), df as (select term, count(*) df from tf group by 1),
s as (select query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_len))) score from tf join df using (term) join want using (term), n group by 1, 2)
select query_id, doc_id, round(score, 6) as score from s qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 20""",
)
def keyword_index_search(spark, sf):
    """An index of all documents with titles; every seventh is then replaced and every eleventh removed; requests are searched in what is left."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("title"), F.array("lang").alias("tags"))
    index = KeywordIndex.at(spark, scratch(spark, "keywords"), buckets=16)
    index.put(docs, ("load", 0))
    index.put(docs.filter("doc_id % 7 = 0").withColumn("text", F.concat_ws(" ", "text", F.col("tags")[0], F.col("tags")[0])), ("load", 1))
    index.remove(docs.filter("doc_id % 11 = 0").select("doc_id"), ("load", 2))
    return index.search(requests(spark, sf), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"))
