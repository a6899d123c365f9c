"""How far the sources of a language differ in their words: smoothed shares compared term by term, and per pair of sources.

Occurrences are counted in Arrow batches and added up per (language, source, term). Two sources' difference is a sum over all kept terms
of the language, but it depends on a term's two counts alone: so per pair the combinations of counts are tallied, and the difference is
evaluated once for each and multiplied. Only terms that both sources have are met term by term (in shards of terms of a bounded size);
cells with a zero on either side follow from each source's own histogram of counts, less what was met, and the cell of two zeros from the
number of kept terms. All of it is whole numbers: sums of multiplicities, of which those of a cell add up in one aggregation.

Defined cases: null texts, languages and sources are read as ''; very long texts are read whole, a piece at a time; every occurring
(language, source) has its pairs, with value 0 if the language keeps no term; ties are broken by the item's UTF-8 bytes; repeated rows
count once each; extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepool.llm.common import materialize, salted_join, word_pieces

#: Lower-cases A-Z, keeps a-z and all bytes of other characters, and blanks the rest.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: So many (language, source) groups may be broadcast (some 10 MB).
FEW_GROUPS = 100_000


class Numbers(dict):
    """term -> its number in this block; ``terms`` is the way back."""

    def __init__(self):
        super().__init__()
        self.terms: list[bytes] = []

    def __missing__(self, term: bytes) -> int:
        value = self[term] = len(self.terms)
        self.terms.append(term)
        return value


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = 500_000) -> DataFrame:
    """lang, source, term, n (occurrences), docs: added up within blocks of documents with some ``block`` distinct terms each, not yet across them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, groups, held = Numbers(), Numbers(), []

        def added() -> pa.RecordBatch:
            m = len(number.terms)
            key = np.concatenate([g * m + ids for g, ids, _ in held])
            keys, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([x[2] for x in held]))
            docs_ = np.bincount(at)
            group, term = pa.array(keys // m), pa.array(keys % m)
            lang, source = (pa.array([g[i] for g in groups.terms], pa.string()).take(group) for i in (0, 1))
            out = pa.RecordBatch.from_arrays([lang, source, pa.array(number.terms, pa.binary()).cast(pa.string()).take(term), pa.array(n.astype(np.int64)), pa.array(docs_)], names=["lang", "source", "term", "n", "docs"])
            held.clear(), number.clear(), number.terms.clear()
            return out

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                parts = [np.unique(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), return_counts=True) for words in word_pieces(text.as_py(), _LETTERS) if words]
                if len(parts) > 1:
                    ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    parts = [(ids, np.bincount(at, weights=np.concatenate([p[1] for p in parts])))]
                if parts:
                    held.append((groups[(lang.as_py(), source.as_py())], *parts[0]))
                    size += len(parts[0][0])
                if size >= block:
                    yield added()
                    size = 0
        if held:
            yield added()

    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "_text"))))
    return texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(count: str, total: str, kept: str) -> Column:
    """The smoothed share of a term in parts of 10^9, plus 1, in whole numbers."""
    return F.expr(f"1 + ((cast({count} as decimal(20, 0)) + 5) * 1000000000 div greatest({total} + 5 * {kept}, 1))")


def _met(rows: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb, m: for sources a < b, how many of a shard's terms have ca > 0 occurrences in a and cb > 0 in b."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        source = table["source"].combine_chunks().dictionary_encode()
        names = np.array(source.dictionary.to_pylist(), object)
        order = np.argsort(np.array([x.encode("utf-8") for x in names], object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        s, n = place[source.indices.to_numpy()], table["n"].to_numpy()
        t = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        at = np.lexsort((s, t))
        s, n, t = s[at], n[at], t[at]
        found, held = [], 0

        def tally(parts: list[np.ndarray]) -> np.ndarray:
            rows = np.concatenate(parts, axis=1)
            rows = rows[:, np.lexsort(rows[3::-1])]
            first = np.flatnonzero(np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)]))
            return np.concatenate([rows[:4, first], np.add.reduceat(rows[4:], first, axis=1)], axis=0)

        for step in range(1, int(np.bincount(t).max(initial=0))):
            i = np.flatnonzero(t[:-step] == t[step:])  # each term's rows that lie ``step`` apart
            found.append(np.stack([s[i], s[i + step], n[i], n[i + step], np.ones(len(i), np.int64)]))
            held += len(i)
            if held >= 1_000_000:
                found = [tally(found)]
                held = 0
        rows = tally(found) if any(x.shape[1] for x in found) else np.empty((5, 0), np.int64)
        by_place = names[order]
        lang = pa.array([key[0].as_py()] * rows.shape[1], pa.string())
        return pa.table([lang, pa.array(by_place[rows[0]], pa.string()), pa.array(by_place[rows[1]], pa.string()), *(pa.array(x) for x in rows[2:])], names=["lang", "a", "b", "ca", "cb", "m"])

    return rows.groupBy("lang", "shard").applyInArrow(run, "lang string, a string, b string, ca bigint, cb bigint, m bigint")


def joint_histograms(kept: DataFrame, groups: DataFrame, shard_rows: int = 10_000) -> DataFrame:
    """lang, a, b, ca, cb, m: for all sources a < b of a language, how many of its kept terms have ca and cb occurrences, zeros included.

    ``kept``: lang, source, term, n > 0 of the kept terms; ``groups``: lang, source, own (its number of such terms), terms (kept ones of the language).
    """
    shards = max(1, -(-kept.count() // shard_rows))
    met = materialize(_met(kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")), "met")
    left, right = (groups.select("lang", F.col("source").alias(x), F.col("own").alias(f"own_{x}"), "terms") for x in "ab")
    pairs = left.join(right.drop("terms"), "lang").filter("a < b")
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("bigint")
    cell = lambda ca, cb, m: F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m"))
    ca, cb, m = F.col("ca"), F.col("cb"), F.col("m")
    parts = [
        met.select("lang", "a", "b", F.inline(F.array(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m)))),
        pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), (F.col("terms") - F.col("own_a") - F.col("own_b")).alias("m")),
        pairs.select("lang", "a", "b").join(own.select("lang", F.col("source").alias("a"), F.col("n").alias("ca"), "m"), ["lang", "a"]).select("lang", "a", "b", "ca", zero.alias("cb"), "m"),
        pairs.select("lang", "a", "b").join(own.select("lang", F.col("source").alias("b"), F.col("n").alias("cb"), "m"), ["lang", "b"]).select("lang", "a", "b", zero.alias("ca"), "cb", "m"),
    ]
    cells = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).filter("m > 0")


def audit_sources(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows for every other source, ``term`` rows for the ``top`` terms a source has more of than its language."""
    counts = materialize(term_counts(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    whole = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(counts.drop("docs").join(whole, ["lang", "term"]), "kept")
    by_lang = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total_lang"))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    there = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    groups = materialize(there.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0), "groups")

    few = groups.count() <= FEW_GROUPS
    met = kept.join(F.broadcast(groups), ["lang", "source"]) if few else salted_join(kept, groups, ["lang", "source"], F.col("term"))
    p, q = share("n", "total", "terms"), share("n_lang", "total_lang", "terms")
    terms = met.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    cells = joint_histograms(kept, groups)
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), "terms")
    pairs = side("a").join(side("b").drop("terms"), "lang").filter("a < b")
    p, q = (share(f"c{x}", f"total_{x}", "terms") for x in "ab")
    sums = cells.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(F.abs(p - q) * F.col("m")).alias("value"))
    both = pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left").select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), F.coalesce("value", F.lit(0)).alias("value"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return both.unionByName(terms)


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents),
w as (select row_number() over () id, lang, source, regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ws from d),
o as (select id, lang, source, unnest(ws) term from w),
c as (select lang, source, term, count(*) n from o group by all),
v as (select lang, term, count(distinct id) from o group by 1, 2 having count(distinct id) >= 30),
g as (select distinct lang, source from d),
k as (select g.lang, g.source, v.term, coalesce(c.n, 0) n from g join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = v.term),
ng as (select lang, source, sum(n)::hugeint big, count(*) v from k group by all),
nl as (select lang, term, sum(n)::hugeint n from k group by all),
tl as (select lang, sum(n)::hugeint big, count(*) v from nl group by all),
p as (select k.lang, k.source, k.term, k.n, 1 + (1000000000::hugeint * (k.n + 5)) // (big + 5 * v) p from k join ng on ng.lang = k.lang and ng.source = k.source),
ql as (select nl.lang, term, 1 + (1000000000::hugeint * (n + 5)) // (big + 5 * v) q from nl join tl on tl.lang = nl.lang),
pv as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term item, (p - q)::bigint as value from p join ql on ql.lang = p.lang and ql.term = p.term where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 50"""
