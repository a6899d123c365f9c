"""Registered queries: links and graphs. Documents are customers, chunks their orders, entities the parts ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepool.operators import clusters, graph, links
from tidepool.plans.registry import query
from tidepool.session import table

M_SQL = "m as (select distinct l_orderkey c, l_partkey e from lineitem)"
E_SQL = f"{M_SQL}, ed as (select x.e src, y.e dst, count(*) w from m x join m y on x.c = y.c and x.e < y.e group by 1, 2)"
#: Strong edges: two orders or more share the pair.
S_SQL = f"{E_SQL}, s as (select * from ed where w >= 2), u as (select src a, dst b, w from s union all select dst, src, w from s)"


def mentions(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id")).distinct()


def strong_edges(spark, sf) -> DataFrame:
    return graph.cooccurrence(mentions(spark, sf)).filter("weight >= 2")


def all_links(spark, sf) -> DataFrame:
    own = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    m = mentions(spark, sf)
    named = own.join(m, own.o_orderkey == m.chunk_id)
    rows = links.make_links(own, "document", "o_custkey", "chunk", "o_orderkey", "contains").unionByName(links.make_links(m, "chunk", "chunk_id", "entity", "entity_id", "mentions"))
    return rows.unionByName(links.make_links(named, "document", "o_custkey", "entity", "entity_id", "mentions"))


L_SQL = f"""{M_SQL}, l as (select 'document' a_type, o_custkey::VARCHAR a_id, 'chunk' b_type, o_orderkey::VARCHAR b_id, 'contains' relation from orders
union all select 'chunk', c::VARCHAR, 'entity', e::VARCHAR, 'mentions' from m union all select 'document', o_custkey::VARCHAR, 'entity', e::VARCHAR, 'mentions' from orders join m on c = o_orderkey)"""


@query("link_add", f"with {L_SQL}, b as (select * from l union select b_type, b_id, a_type, a_id, relation from l) select a_type, b_type, relation, count(*) as n from b group by all")
def link_add(spark, sf):
    return links.add_links(all_links(spark, sf)).groupBy("a_type", "b_type", "relation").agg(F.count("*").alias("n"))


@query("link_ingest", f"with {L_SQL} select distinct * from l")
def link_ingest(spark, sf):
    return links.add_links(all_links(spark, sf), bidirectional=False)


@query("link_traverse", f"with {L_SQL}, t as (select distinct b_type, b_id from l where a_type = 'document' and a_id = '7' union select a_type, a_id from l where b_type = 'document' and b_id = '7') select b_type as type, string_agg(b_id, ',' order by b_id) as ids from t group by 1")
def link_traverse(spark, sf):
    return links.traverse(all_links(spark, sf), "document", "7").select("type", F.array_join("ids", ",").alias("ids"))


#: Seeds are the parts whose id is divisible by 100.
SEEDS = "sd as (select p_partkey e from part where p_partkey % 100 = 0)"
REACHED = f"""{M_SQL}, {SEEDS}, h1 as (select distinct sd.e s, y.e from sd join m x using (e) join m y on y.c = x.c where y.e <> sd.e),
h2 as (select distinct s, y.e from h1 join m x on x.e = h1.e join m y on y.c = x.c where y.e <> s), re as (select s, e, min(d)::INT d from (select *, 1 d from h1 union all select *, 2 from h2) group by 1, 2)"""


def part_seeds(spark, sf, name="entity_id") -> DataFrame:
    return table(spark, sf, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias(name))


@query("related_entities", f"with {REACHED} select s as seed, e as entity_id, d as depth from re")
def related_entities(spark, sf):
    return links.related_entities(mentions(spark, sf), part_seeds(spark, sf), 2)


@query("seeds_retrieve", f"with {REACHED}, n as (select e, min(d) d from (select e, 0 d from sd union all select e, d from re) group by 1) select c as chunk_id, round(max(0.6 / (d + 1)), 6)::DOUBLE as score from n join m using (e) group by 1")
def seeds_retrieve(spark, sf):
    return links.retrieve_from_seeds(mentions(spark, sf), part_seeds(spark, sf), 0.6, 2).withColumn("score", F.round("score", 6))


@query("cooccur", f"with {E_SQL} select src, dst, w as weight from ed")
def cooccur(spark, sf):
    return graph.cooccurrence(mentions(spark, sf))


@query(
    "entity_lookup",
    f"""with {M_SQL}, f as (select e, count(*) n from m group by 1), p as (select p_partkey id, p_name nm, lower(p_name) l, coalesce(n, 0) n from part left join f on e = p_partkey), q as (select min(lower(p_name)) q from part),
r as (select id, nm, n, case when l = q then 0.95 when contains(l, q) then 0.86 else 0.80 end + n / 100 rel, case when l = q then 1.0 when contains(l, q) then 0.95 else 0.9 end::DOUBLE conf from p, q where contains(l, q) or contains(q, l))
select id, nm as name, n as frequency, round(rel, 6)::DOUBLE as relevance, conf as confidence from r order by rel desc, n desc, id limit 20""",
)
def entity_lookup(spark, sf):
    parts = table(spark, sf, "part")
    f = mentions(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"))
    entities = parts.join(f, parts.p_partkey == f.entity_id, "left").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.coalesce("n", F.lit(0)).alias("frequency"))
    name = parts.agg(F.min(F.lower("p_name"))).first()[0] or ""
    return graph.entity_lookup(entities, name).withColumn("relevance", F.round("relevance", 6))


@query("hops_min", f"with {S_SQL}, {SEEDS}, h1 as (select distinct e seed, b id from u join sd on a = e), h2 as (select distinct seed, b id from u join h1 on a = id) select seed, id, min(d)::INT as distance from (select *, 1 d from h1 union all select *, 2 from h2) where id <> seed group by 1, 2")
def hops_min(spark, sf):
    return graph.within_hops(strong_edges(spark, sf), part_seeds(spark, sf, "id"), 2)


SAME = "(least({x}.a, {x}.b) = least({y}.a, {y}.b) and greatest({x}.a, {x}.b) = greatest({y}.a, {y}.b))"


@query("weighted_traversal", f"""with {S_SQL}, {SEEDS}, f as (select e, count(*) n from m group by 1),
p as (select e seed, b id, 1 hops, w / 10.0 mean from u join sd on a = e union all select e, y.b, 2, (x.w + y.w) / 20.0 from sd join u x on x.a = e join u y on x.b = y.a where not {SAME.format(x='x', y='y')}
 union all select e, z.b, 3, (x.w + y.w + z.w) / 30.0 from sd join u x on x.a = e join u y on x.b = y.a join u z on y.b = z.a where not {SAME.format(x='x', y='y')} and not {SAME.format(x='x', y='z')} and not {SAME.format(x='y', y='z')})
select seed, id, min(hops)::INT as hops, round(max(case hops when 1 then 0.8 when 2 then 0.6 else 0.4 end * mean + coalesce(n, 1) / 50), 6)::DOUBLE as score, max(case when mean >= 0.7 then 0.9 when mean >= 0.5 then 0.8 else 0.7 end)::DOUBLE as confidence from p left join f on f.e = id where id <> seed group by 1, 2""")
def weighted_traversal(spark, sf):
    edges = strong_edges(spark, sf).withColumn("weight", F.col("weight") / 10.0)
    f = mentions(spark, sf).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("frequency"))
    return graph.weighted_paths(edges, part_seeds(spark, sf, "id"), f, 3, 0.0).withColumn("score", F.round("score", 6))


@query(
    "shortest_path",
    f"""with {S_SQL}, x as (select min(id) e from (select distinct y.b id from u x join u y on x.b = y.a where x.a = 5) where id not in (select b from u where a = 5) and id <> 5)
select distinct 2 as hops, '5,' || p.b || ',' || q.b as path from u p join u q on p.b = q.a where p.a = 5 and q.b = (select e from x) order by path limit 5""",
)
def shortest_path(spark, sf):
    """From part 5 to the first part two hops away; the driver reads that one id."""
    edges = strong_edges(spark, sf)
    far = graph.within_hops(edges, spark.createDataFrame([(5,)], "id long"), 2).filter("distance = 2").agg(F.min("id")).first()[0]
    rows = graph.shortest_paths(edges, 5, far if far is not None else -1, 2, 1_000_000)
    return rows.select("hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path")).orderBy("path").limit(5)


def beam_hops(hops: int, width: int, reach: str) -> str:
    """CTEs of a beam: b0 (q, s, place, nodes, rel, conf) to b``hops``. ``reach``: a select of q, s, place, dst, r, c, ty from b{h} and what it meets."""
    out, visited = [], "(select q, s, s dst from b0)"
    for h in range(hops):
        out.append(f"""r{h} as ({reach.format(h=h, visited=visited)}),
k{h} as (select *, row_number() over (partition by q, s, place order by r desc, dst) nth from r{h} qualify nth <= {width}),
b{h + 1} as (select x.q, x.s, x.place * {width} + nth - 1 place, list_append(nodes, dst) nodes, rel * r rel, least(conf, c) conf, list_append(types, ty) types from b{h} x join k{h} using (q, s, place))""")
        visited += f" union all (select q, s, dst from r{h})"
    return ", ".join(out)


BEAM = beam_hops(2, 5, "select q, s, place, b dst, least(1.0, w / 10.0)::DOUBLE r, 0.8::DOUBLE c, '' ty from b{h} x join u on u.a = x.nodes[-1] where not exists (select 1 from ({visited}) v where v.q = x.q and v.s = x.s and v.dst = b) qualify row_number() over (partition by q, s, b order by place, w desc) = 1")


@query("beam_search", f"with {S_SQL}, b0 as (select 0 q, p_partkey s, 0 place, [p_partkey] nodes, 1.0::DOUBLE rel, 1.0::DOUBLE conf, ['']::VARCHAR[] types from part where p_partkey % 100 = 0), {BEAM} select s as start, array_to_string(nodes, ',') as path, round(rel, 6) as relevance, conf as confidence from b2")
def beam_search(spark, sf):
    """Two hops from every hundredth part."""
    both = graph.undirected(strong_edges(spark, sf)).select("src", "dst", F.least(F.lit(1.0), F.col("weight") / 10).alias("relevance"), F.lit(0.8).alias("confidence"))
    rows = graph.beam_search(both, part_seeds(spark, sf, "id"), 2, 5)
    return rows.select("start", F.array_join("path", ",").alias("path"), F.round("relevance", 6).alias("relevance"), "confidence")



@query("link_exact", "with p as (select p_partkey id, lower(p_name) k, p_brand d from part where length(p_name) > 2), g as (select k from p group by k having min(d) < max(d)) select x.id as src, y.id as dst, 'SAME_AS' as type, 0.95::DOUBLE as weight from p x join p y using (k) join g using (k) where x.id < y.id")
def link_exact(spark, sf):
    return graph.exact_links(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("document_id")))


@query("link_type", "select lower(p_type) || '_' || lower(p_name)[1:3] as key, count(*) as n, min(p_partkey) as first_id from part where length(p_type) > 2 and length(p_name) > 2 group by 1")
def link_type(spark, sf):
    return graph.type_groups(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")))


@query("link_types", "with p as (select p_partkey id, lower(p_type) || '_' || lower(p_name)[1:3] k, lower(p_name) nm, p_brand d from part where length(p_type) > 2 and length(p_name) > 2), g as (select k from p group by 1 having min(d) < max(d)), n as (select nm from p group by 1 having min(d) < max(d)) select x.id as src, y.id as dst, 'CROSS_DOCUMENT_TYPE' as type, 0.4::DOUBLE as weight from p x join p y on x.k = y.k and x.id < y.id join g on g.k = x.k where not (x.nm = y.nm and x.nm in (select nm from n))")
def link_types(spark, sf):
    """Type edges of parts (brands as documents), beside the exact links."""
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("document_id"))
    return graph.type_edges(own)


@query("link_fuzzy")
def link_fuzzy(spark, sf):
    """Ratcliff-Obershelp likeness has no SQL equal: distinct part names and types against each other; candidates by bounds that lose none, tested against all pairs."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type")).distinct()
    pairs = graph.match_candidates(names)
    return graph.match_kind(pairs)


@query("link_clusters")
def link_clusters(spark, sf):
    """Greedy clusters of parts by name and brand, sizes as documents. The likeness has no SQL equal and its order matters: tested against the loop."""
    part = table(spark, sf, "part")
    own = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.regexp_extract("p_brand", r"\d+", 0)).alias("name"), F.col("p_size").alias("document_id"))
    return clusters.cluster_links(own).select("src", "dst", "leader", F.round("ratio", 6).alias("ratio"), F.round("weight", 6).alias("weight"))


@query("entity_in_chunk", "select distinct c.page_id as chunk_id, n.id as entity_id from pages c join (select min(item_id) id, lower(split_part(text, ' ', 1)) nm from benchmark group by 2) n on contains(lower(c.html), n.nm) where nm <> ''")
def entity_in_chunk(spark, sf):
    """First words of the benchmark items, looked for in pages."""
    names = table(spark, sf, "benchmark").groupBy(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("name")).agg(F.min("item_id").alias("entity_id"))
    return graph.entity_in_chunk(table(spark, sf, "pages").select(F.col("page_id").alias("chunk_id"), F.col("html").alias("content")), names)


@query("graph_statistics", f"with {E_SQL} select count(*) as relationships, count(distinct src) as sources, max(w) as max_weight from ed")
def graph_statistics(spark, sf):
    return graph.cooccurrence(mentions(spark, sf)).agg(F.count("*").alias("relationships"), F.count_distinct("src").alias("sources"), F.max("weight").alias("max_weight"))


@query("entity_relationships", f"with {E_SQL} select other, weight from (select case when src = 5 then dst else src end other, w::DOUBLE weight from ed where src = 5 or dst = 5) order by weight desc, other limit 50")
def entity_relationships(spark, sf):
    near = graph.undirected(graph.cooccurrence(mentions(spark, sf))).filter("src = 5")
    return near.select(F.col("dst").alias("other"), F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight").cast("double")).alias("weight")).orderBy(F.desc("weight"), "other").limit(50)


@query("document_entities", f"with {M_SQL} select o_custkey as document_id, e as entity_id, count(*) as frequency from orders join m on c = o_orderkey group by 1, 2")
def document_entities(spark, sf):
    own, m = table(spark, sf, "orders"), mentions(spark, sf)
    return own.join(m, own.o_orderkey == m.chunk_id).groupBy(F.col("o_custkey").alias("document_id"), "entity_id").agg(F.count("*").alias("frequency"))
