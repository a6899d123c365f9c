"""Registered queries: sentences, counts, sections, chunks, names and entities, over documents and over composed texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool import values
from tidepool.functions import temporal, text as tx
from tidepool.functions.scoring import word_jaccard
from tidepool.operators import chunking, graph, lateral
from tidepool.plans.registry import query, quoted, values_sql
from tidepool.session import table

SENT = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"


@query("sentence_split", f"select doc_id, len(s)::INT as n_sentences, md5(array_to_string(s, '|')) as digest from (select doc_id, {SENT.format('text')} s from documents)")
def sentence_split(spark, sf):
    s = tx.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


@query("sentence_protected")
def sentence_protected(spark, sf):
    """Needs lookbehind, which DuckDB's patterns lack: tested on hand-made rows."""
    s = tx.protected_sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


@query("token_counts", f"select doc_id, floor(length(text) / 4)::BIGINT as by_length, round(len({WORDS.format('text')}) * 1.3, 4)::DOUBLE as by_words, len({WORDS.format('text')})::INT as words from documents")
def token_counts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.tokens_by_length(t).alias("by_length"), F.round(tx.tokens_by_words(t).cast("double"), 4).alias("by_words"), tx.word_count(t).alias("words"))


#: A markdown text made of each document's columns, the same in both engines.
MD = "'lost' || chr(10) || '# ' || source || chr(10) || text || chr(10) || '## ' || lang || chr(10) || '### Deep' || chr(10) || 'tail' || chr(10) || '## Last'"
LINES = f"li as (select doc_id, unnest(generate_series(0, len(l) - 1)) line_no, unnest(l) line from (select doc_id, string_split({MD}, chr(10)) l from documents))"


def markdown():
    nl = F.lit("\n")
    return F.concat(F.lit("lost"), nl, F.lit("# "), F.col("source"), nl, F.col("text"), nl, F.lit("## "), F.col("lang"), nl, F.lit("### Deep"), nl, F.lit("tail"), nl, F.lit("## Last"))


SECTIONS = f"""{LINES}, h as (select *, regexp_matches(line, '^#{{1,6}}\\s+.+$') hd from li), s as (select *, sum(hd::INT) over (partition by doc_id order by line_no) section from h),
sec as (select doc_id, section::INT section, max(case when hd then length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) end)::INT lvl, max(case when hd then trim(regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1)) end) title, trim(coalesce(string_agg(case when not hd then line end, chr(10) order by line_no), '')) body from s where section > 0 group by 1, 2)"""


@query("sections_header", f"with {SECTIONS} select doc_id, section, lvl as level, title, body from sec")
def sections_header(spark, sf):
    return chunking.header_sections(table(spark, sf, "documents"), markdown()).withColumn("section", F.col("section").cast("int"))


@query("chunk_tree", f"with {SECTIONS} select a.doc_id, a.section, a.lvl as level, (select max(b.section) from sec b where b.doc_id = a.doc_id and b.section < a.section and b.lvl < a.lvl) as parent from sec a")
def chunk_tree(spark, sf):
    rows = chunking.parents(chunking.header_sections(table(spark, sf, "documents"), markdown()))
    return rows.select("doc_id", F.col("section").cast("int").alias("section"), "level", F.col("parent").cast("int").alias("parent"))


NUMBERED = "'1. Top ' || source || chr(10) || text || chr(10) || '1.2. Sub ' || source || chr(10) || replace(text, '. ', chr(10) || doc_id || '.3. ') || chr(10) || '4 not a section'"


@query("sections_numbered", f"""with l as (select doc_id, unnest(x) line, unnest(generate_series(0, len(x) - 1)) n from (select doc_id, string_split({NUMBERED}, chr(10)) x from documents)),
g as (select doc_id, n, regexp_extract(line, '^(\\d+(?:\\.\\d+)*)\\.\\s+(.+)$', ['num', 'title']) g from l where regexp_matches(line, '^(\\d+(?:\\.\\d+)*)\\.\\s+(.+)$'))
select doc_id, n::INT as line_no, g.num as number, len(string_split(g.num, '.'))::INT as level, md5(g.title) as title_md5 from g""")
def sections_numbered(spark, sf):
    """Whole texts, once as they are and once with a number at every sentence."""
    t = F.concat(F.lit("1. Top "), "source", F.lit("\n"), "text", F.lit("\n1.2. Sub "), "source", F.lit("\n"), F.replace(F.col("text"), F.lit(". "), F.concat(F.lit("\n"), F.col("doc_id").cast("string"), F.lit(".3. "))), F.lit("\n4 not a section"))
    return chunking.numbered_sections(table(spark, sf, "documents"), t).select("doc_id", "line_no", "number", "level", F.md5("title").alias("title_md5"))


PARAS = "text || chr(10) || ' ' || chr(10) || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10))"


@query("sections_paragraph", f"select doc_id, pos::INT as pos, substr(regexp_split_to_array(c, '[.!?]')[1], 1, 50) as title, md5(c) as digest from (select doc_id, unnest(generate_series(0, len(p) - 1)) pos, trim(unnest(p)) c from (select doc_id, regexp_split_to_array({PARAS}, '\\n\\s*\\n') p from documents)) where length(c) > 100")
def sections_paragraph(spark, sf):
    t = F.concat(F.col("text"), F.lit("\n \n"), F.col("source"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.paragraphs(table(spark, sf, "documents"), t).select("doc_id", "pos", "title", F.md5("content").alias("digest"))


CODED = "'before ```python' || chr(10) || text || chr(10) || '``` between ```' || lang || chr(10) || text || '``` and ``` ' || source || ' ```' || text"


@query("code_blocks", f"""with m as (select doc_id, regexp_extract_all({CODED}, '(?s)```(?:([\\p{{L}}\\p{{N}}_]+)\\n)?(.*?)```', 1) l, regexp_extract_all({CODED}, '(?s)```(?:([\\p{{L}}\\p{{N}}_]+)\\n)?(.*?)```', 2) c from documents)
select doc_id, pos, case when coalesce(lang, '') = '' then 'text' else lang end as language, md5(regexp_replace(regexp_replace(c, '^[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+', ''), '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+$', '')) as code_md5
from (select doc_id, (unnest(generate_series(1, len(c))) - 1)::INT pos, unnest(l) lang, unnest(c) c from m)""")
def code_blocks(spark, sf):
    """Whole texts inside, between and after fences."""
    t = F.concat(F.lit("before ```python\n"), "text", F.lit("\n``` between ```"), "lang", F.lit("\n"), "text", F.lit("``` and ``` "), "source", F.lit(" ```"), "text")
    return chunking.code_blocks(table(spark, sf, "documents"), t).select("doc_id", "pos", "language", F.md5("code").alias("code_md5"))


for name in ("standard", "semantic"):
    query(f"chunk_{name}")(lambda spark, sf, name=name: chunking.chunk(table(spark, sf, "documents"), name))


@query("chunk_lateral")
def chunk_lateral(spark, sf):
    """The standard chunker as a table function in SQL text; the rows of chunk_standard."""
    table(spark, sf, "documents").createOrReplaceTempView("tidepool_lateral_documents")
    lateral.register(spark)
    return spark.sql("select d.doc_id, c.chunk_index, c.content, c.tokens from tidepool_lateral_documents d, lateral chunk_standard(d.text, 400, 80) c")


@query("chunk_levels")
def chunk_levels(spark, sf):
    """Sections into header and part chunks: sequential within a document, hence without SQL."""
    return chunking.level_chunks(table(spark, sf, "documents"))


@query("chunk_groups", "with c as (select source doc_id, (row_number() over (partition by source order by doc_id) - 1)::INT i, text from documents) select doc_id, (i // 4)::INT as \"group\", count(*) as n_chunks, substr(string_agg(substr(text, 1, 100), ' ' order by i), 1, 300) as preview from c group by 1, 2")
def chunk_groups(spark, sf):
    return chunking.groups_of(numbered(spark, sf))


def numbered(spark, sf):
    from tidepool.operators.retrieval import ranked

    rows = ranked(table(spark, sf, "documents").withColumn("score", -F.col("doc_id")), ["source"])
    return rows.select(F.col("source").alias("doc_id"), (F.col("rank") - 1).alias("chunk_index"), F.col("text").alias("content"), F.col("doc_id").alias("chunk"))


@query("chunk_siblings", "with o as (select distinct l_orderkey d, l_linenumber c from lineitem) select a.d as document_id, a.c as chunk, b.c as sibling from o a join o b on a.d = b.d and a.c <> b.c")
def chunk_siblings(spark, sf):
    """Lines of an order as chunks of a node."""
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.struct("l_orderkey", "l_linenumber").alias("chunk")).distinct()
    return chunking.siblings(own, ["document_id"]).select(F.col("chunk.l_orderkey").alias("document_id"), F.col("chunk.l_linenumber").alias("chunk"), F.col("sibling.l_linenumber").alias("sibling"))


@query("chunk_min_length", "select doc_id, n_chars from documents where length(trim(text)) > 50")
def chunk_min_length(spark, sf):
    return table(spark, sf, "documents").filter(F.length(F.trim("text")) > 50).select("doc_id", "n_chars")


@query("snippets", f"select doc_id, md5(case when len(w) > 36 then array_to_string(w[1:36], ' ') || '...' else array_to_string(w, ' ') end) as digest from (select doc_id, {WORDS.format('text')} w from documents)")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.snippet(F.col("text"))).alias("digest"))


@query(
    "highlights",
    f"""with s as (select doc_id, list_filter(string_split(text, '.')[1:5], lambda p: contains(lower(p), 'the') or contains(lower(p), 'und')) h from documents),
t as (select doc_id, list_transform(h, lambda p: case when len({WORDS.format('p')}) > 5 then array_to_string(({WORDS.format('p')})[1:10], ' ') || '...' else trim(p) end)[1:3] h from s)
select doc_id, array_to_string(h, '|') as highlights from t""",
)
def highlights(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.highlights(F.col("text"), F.lit("the und")), "|").alias("highlights"))


@query("name_normalize", "select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ')  v-2'), '[^a-z0-9\\s-]', '', 'g'), '\\s+', ' ', 'g')) as name from part")
def name_normalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.normal_name(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")  v-2"))).alias("name"))


@query("content_id", "select doc_id, substr(md5(text), 1, 12) as content_id from documents")
def content_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.content_id(F.col("text")).alias("content_id"))


W = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query("word_jaccard", f"with p as (select a.doc_id, {W.format('a.text')} x, {W.format('b.text')} y from documents a join documents b on b.doc_id = a.doc_id + 1) select doc_id, round(case when len(x) = 0 or len(y) = 0 then 0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end, 6)::DOUBLE as jaccard from p")
def neighbour_jaccard(spark, sf):
    docs = table(spark, sf, "documents")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(nxt, "doc_id").select("doc_id", F.round(word_jaccard(F.col("text"), F.col("other")), 6).alias("jaccard"))


#: Pairs of names made of each part and the next.
PAIRS = "pr as (select a.p_partkey, a.p_name || case a.p_partkey % 5 when 0 then ' v' || (a.p_partkey % 7) || '.2' when 1 then '-' || a.p_size when 2 then ' RAG' else '' end a, b.p_name || case b.p_partkey % 5 when 0 then ' 3' when 3 then ' retrieval augmented generation' when 4 then ' AI' else '' end b from part a join part b on b.p_partkey = a.p_partkey + 1)"


def name_pairs(spark, sf):
    part, k = table(spark, sf, "part"), F.col("p_partkey") % 5
    a = F.concat("p_name", F.when(k == 0, F.concat(F.lit(" v"), (F.col("p_partkey") % 7).cast("string"), F.lit(".2"))).when(k == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"))).when(k == 2, " RAG").otherwise(""))
    b = F.concat("p_name", F.when(k == 0, " 3").when(k == 3, " retrieval augmented generation").when(k == 4, " AI").otherwise(""))
    return part.select("p_partkey", a.alias("a")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), b.alias("b")), "p_partkey")


@query("version_match", f"with {PAIRS} select p_partkey, a, b, nullif(regexp_extract(lower(a), '^(.+?)[\\s\\-]*(v?\\d+(?:\\.\\d+)*|\\d+)$', 1), '') as a_base, nullif(regexp_extract(lower(b), '^(.+?)[\\s\\-]*(v?\\d+(?:\\.\\d+)*|\\d+)$', 1), '') as b_base from pr")
def version_match(spark, sf):
    return name_pairs(spark, sf).select("p_partkey", "a", "b", tx.version_base(F.col("a")).alias("a_base"), tx.version_base(F.col("b")).alias("b_base"))


ACRONYM_SQL = " or ".join(f"(contains({p}, {quoted(k)}) and contains({q}, {quoted(v)}))" for p, q in (("lower(a)", "lower(b)"), ("lower(b)", "lower(a)")) for k, v in values.ACRONYMS.items())


@query("acronym_match", f"with {PAIRS} select p_partkey, a, b, ({ACRONYM_SQL}) as is_acronym from pr")
def acronym_match(spark, sf):
    return name_pairs(spark, sf).select("p_partkey", "a", "b", tx.acronym_pair(F.col("a"), F.col("b")).alias("is_acronym"))


TECH = "text || ' The transformer model uses PyTorch, and ' || source || ' needs redis with a Vector  Database; GPT-4 and few-shot retrieval on AWS.'"


@query("tech_entities", f"with f as (select doc_id, kind, i, lower(trim(m)) m from (select doc_id, kind, i, unnest(regexp_extract_all({TECH}, p, 0, 'i')) m from documents, {values_sql([(i, p, k) for i, (p, k) in enumerate(values.TECHNICAL)], 'v(i, p, kind)')})), o as (select doc_id, m, arg_min(kind, i) kind from f where length(m) between 3 and 99 group by 1, 2) select doc_id, kind, string_agg(m, ',' order by m) as found from o group by 1, 2")
def tech_entities(spark, sf):
    t = F.concat("text", F.lit(" The transformer model uses PyTorch, and "), "source", F.lit(" needs redis with a Vector  Database; GPT-4 and few-shot retrieval on AWS."))
    found = graph.technical_entities(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), t.alias("content")))
    return found.groupBy(F.col("chunk_id").alias("doc_id"), F.col("type").alias("kind")).agg(F.array_join(F.sort_array(F.collect_set(F.lower("name"))), ",").alias("found"))


@query("entity_group", "select lower(p_name) as key, min(p_name) as name, count(distinct p_brand) as frequency, count(*) as mentions from part group by 1")
def entity_group(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower("p_name").alias("key")).agg(F.min("p_name").alias("name"), F.count_distinct("p_brand").alias("frequency"), F.count("*").alias("mentions"))


REL_SQL = " ".join(f"when {' or '.join(f'contains(lower(t), {quoted(w)})' for w in ws)} then {quoted(k)}" for k, ws in values.RELATIONS.items())


@query("relation_words", f"with w as (select conv_id, turn, text || case (conv_id + turn) % 4 when 0 then ' uses it' when 1 then ' is part of it' else '' end t from conversations) select conv_id, turn, md5(t) as digest, case {REL_SQL} else case when len({WORDS.format('t')}) < 10 then 'RELATES_TO' end end as relation from w")
def relation_words(spark, sf):
    k = (F.col("conv_id") + F.col("turn")) % 4
    t = F.concat("text", F.when(k == 0, " uses it").when(k == 1, " is part of it").otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(t).alias("digest"), tx.relation_between(t).alias("relation"))


@query("between_names", "with b as (select doc_id, lower(text) t, instr(lower(text), 'the') i, instr(lower(text), 'und') j from documents) select doc_id, md5(case when i = 0 or j = 0 then '' when i < j then substr(t, i + 3, greatest(j - i - 3, 0)) else substr(t, j + 3, greatest(i - j - 3, 0)) end) as digest from b")
def between_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.text_between(F.col("text"), F.lit("The"), F.lit("und"))).alias("digest"))


@query("proximity", "select doc_id, (instr(text, 'the') > 0 and instr(text, 'and') > 0 and abs(instr(text, 'the') - instr(text, 'and')) < 200) as near from documents")
def proximity(spark, sf):
    a, b = F.instr("text", "the"), F.instr("text", "and")
    return table(spark, sf, "documents").select("doc_id", ((a > 0) & (b > 0) & (F.abs(a - b) < 200)).alias("near"))


DAY = "o_orderdate::DATE"


@query("parse_dates", f"select o_orderkey, case when o_orderkey % 6 < 4 then {DAY} end as d from orders")
def parse_dates(spark, sf):
    """Order dates written in four ways, as no real date, or not at all."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    written = [F.date_format(day, f) for f in ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy")]
    text = F.when(k == 0, written[0]).when(k == 1, written[1]).when(k == 2, written[2]).when(k == 3, written[3]).when(k == 4, F.lit("31/31/2020 and 2024-13-45")).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", temporal.parse_date(F.concat(F.lit("due "), text, F.lit(" or so"))).alias("d"))


@query("lifecycle", "select o_orderkey, case when o_orderkey % 4 = 0 then case when o_orderdate::DATE < DATE '1999-01-01' then 'expired' else 'active' end when datediff('day', o_orderdate::DATE, DATE '1999-01-01') <= 30 then 'current' when datediff('day', o_orderdate::DATE, DATE '1999-01-01') <= 90 then 'recent' else 'historical' end as stage from orders")
def lifecycle(spark, sf):
    day, now = F.col("o_orderdate").cast("date"), F.lit("1999-01-01").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", temporal.lifecycle(day, F.when(F.col("o_orderkey") % 4 == 0, day), now).alias("stage"))


@query(
    "relevance_window",
    """with o as (select o_orderkey k, datediff('day', DATE '1999-01-01', o_orderdate::DATE) l from orders)
select k as o_orderkey, (case when k % 4 = 0 then case when l < -30 then 0.1 when l < 0 then 0.3 when l < 7 then 0.9 else 1.0 end when k % 4 = 1 then 0.8 when k % 4 = 2 then 0.7 else case when -l <= 7 then 1.0 when -l <= 30 then 0.8 when -l <= 90 then 0.5 else 0.3 end end)::DOUBLE as weight from o""",
)
def relevance_window(spark, sf):
    day, now, k = F.col("o_orderdate").cast("date"), F.lit("1999-01-01").cast("date"), F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select("o_orderkey", temporal.relevance_window(day, F.when(k == 0, day), F.when(k == 1, "m"), F.when(k == 2, "s"), now).cast("double").alias("weight"))


TYPE_SQL = " ".join(f"when {' or '.join(f'contains({c}, {quoted(w)})' for w in ws)} then {quoted(k)}" for c, rules in (("lower(url)", values.PATH_TYPES), ("lower(substr(html, 1, 500))", values.TEXT_TYPES)) for k, ws in rules.items())


@query("doc_type", f"select page_id, case {TYPE_SQL} else 'default' end as doc_type from pages")
def doc_type(spark, sf):
    return table(spark, sf, "pages").select("page_id", temporal.doc_type(F.col("url"), F.col("html")).alias("doc_type"))


@query("page_titles", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("bridge_relations", "with f as (select p_partkey id, p_brand d from part qualify row_number() over (partition by p_brand order by p_partkey) = 1) select a.id as src, b.id as dst, 0.7::DOUBLE as weight from f a join f b on a.d < b.d")
def bridge_relations(spark, sf):
    return graph.bridges(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("Concept").alias("type"), F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("seq")))
