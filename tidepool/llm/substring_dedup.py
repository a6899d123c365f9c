"""Removal of text that repeats across a corpus, by hashing lines and pieces of lines.

The unit is the line. So that passages are also found where they start or end within a line, a line is divided further, at sentence
marks and after words whose hash has its low three bits clear: equal lines are divided alike, and the same passage is cut at the same
places wherever it stands. Units are normalised (ASCII case, punctuation and white space), digested, and digests grouped globally with
pre-aggregation; each digest's earliest occurrence, by document id and position, is kept. Other occurrences that follow each other in a
document form runs; runs of at least ``min_words`` words, at least half of them in units of ``telling`` words or more, are removed, so
that a chain of short phrases each of which is common is no repeat. Spans are offsets (code points) into the original text.

Defined cases: null and empty texts have no units and stay as they are; very long texts are read whole; documents with equal ids count
as one document, whose occurrences never remove each other, but a span belongs to the text it was found in (id and digest of the text);
repeated rows are cut alike; rows with a null id are left alone; extra columns pass through. Within one document later repeats go too.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepool.llm.common import HASHES, Bitmap, WordHashes, alone, bitmap_of, by_filter, hot_keys, materialize, salted_join, scramble

_NORMAL = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
_MARK = np.zeros(256, bool)
_MARK[[10, 33, 46, 63]] = True
_ANCHOR = np.uint64(7)
_FACTORS = scramble(np.arange(1, 1 << 12, dtype=np.uint64)) | np.uint64(1)


def _factors(n: int) -> np.ndarray:
    return _FACTORS[:n] if n <= len(_FACTORS) else scramble(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def units_of(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, words, digest) of each unit; starts and stops in code points, tiling the text from its first word on."""
    raw = (text or "").encode("utf-8", "replace")
    normal = raw.translate(_NORMAL)
    words = normal.split()
    n = len(words)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    solid = np.frombuffer(normal, np.uint8) != 32
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = hashes.of(words)
    marks = np.concatenate([[0], np.cumsum(_MARK[b])])
    last = np.ones(n, bool)  # does a unit end after this word?
    last[:-1] = ((h[:-1] & _ANCHOR) == 0) | (marks[begins[1:]] > marks[ends[:-1]])
    first = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
    counts = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, counts)
    digest = scramble(np.add.reduceat(scramble(h) * _factors(int(counts.max()))[place], first) + counts.astype(np.uint64))
    start = begins[first]
    stop = np.append(start[1:], len(raw))
    if len(raw) != len(text):
        points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        start, stop = points[start], points[stop]
    return start, stop, counts, digest


def text_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _doc (hash of the text), unit, start, stop, words, digest, again (the text has the digest earlier); one row per unit."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_doc"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(HASHES)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                got = [units_of(x.as_py(), HASHES) for x in batch.column(2).slice(at, 500)]
                sizes = np.array([len(g[0]) for g in got])
                if not sizes.sum():
                    continue
                start, stop, words, digest = (np.concatenate([g[i] for g in got]) for i in range(4))
                unit = np.concatenate([np.arange(k) for k in sizes])
                again = np.ones(len(unit), bool)
                again[np.concatenate([at_ + np.unique(g[3], return_index=True)[1] for at_, g in zip(np.cumsum([0, *sizes[:-1]]), got, strict=True)])] = False
                row = pa.array(np.repeat(np.arange(at, at + len(got)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(row) for i in (0, 1)), *(pa.array(x.astype(np.int32)) for x in (unit, start, stop, words)), pa.array(digest.view(np.int64)), pa.array(again)],
                    names=["_id", "_doc", "unit", "start", "stop", "words", "digest", "again"],
                )

    return rows.mapInArrow(run, f"_id {kind}, _doc bigint, unit int, start int, stop int, words int, digest bigint, again boolean")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, telling: int = 5) -> DataFrame:
    """One row per removed run: id, start, stop, n_units, n_words, and kept_id: the document that keeps its first unit (itself, if it has the unit earlier)."""
    return _spans(docs, id_col, text_col, min_words, telling).drop("_doc").distinct()


def _spans(docs: DataFrame, id_col: str, text_col: str, min_words: int, telling: int) -> DataFrame:
    """``repeated_spans`` with _doc.

    Shuffled are narrow rows only: a document's first units by digest, pre-aggregated to the least id; those whose digest several
    documents have (by a fixed-size bitmap first), to meet that id in a join that deals hot digests over many tasks; then repeated
    units by document.
    """
    units = materialize(text_units(docs, id_col, text_col), "units")
    firsts = units.filter("not again")
    seen = materialize(firsts.groupBy("digest").agg(F.min("_id").alias("kept_id"), F.max("_id").alias("last"), F.count("*").alias("n")).filter("kept_id < last").select("digest", "kept_id", "n"), "repeated")
    passing = _passing(units, bitmap_of(seen, position=F.col("digest").bitwiseAND(F.lit(DIGEST_BITS - 1)), size=DIGEST_BITS), min_words, telling)
    met = salted_join(passing.filter("not again").drop("again"), seen.drop("n"), ["digest"], F.col("_id"), hot=hot_keys(seen, ["digest"]))
    later = met.filter(F.col("_id") > F.col("kept_id")).select("_id", "_doc", "unit", "start", "stop", "words", "kept_id")
    inside = passing.filter("again").select("_id", "_doc", "unit", "start", "stop", "words", F.col("_id").alias("kept_id"))
    text = ["_id", "_doc"]
    repeats = later.unionByName(inside).repartition(*text).dropDuplicates([*text, "unit", "start", "stop"])
    runs = repeats.withColumn("run", F.col("unit") - F.dense_rank().over(Window.partitionBy(*text).orderBy("unit")))
    spans = runs.groupBy(*text, "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), F.min_by("kept_id", "unit").alias("kept_id"),
        F.sum(F.when(F.col("words") >= telling, F.col("words")).otherwise(0)).alias("told"),
    )
    return spans.filter((F.col("n_words") >= min_words) & (2 * F.col("told") >= F.col("n_words"))).select(F.col("_id").alias(id_col), "_doc", "start", "stop", "n_units", "n_words", "kept_id")


#: Bits of the fixed-size filter of repeated digests.
DIGEST_BITS = 1 << 26


def _passing(units: DataFrame, wanted: Bitmap, min_words: int, telling: int) -> DataFrame:
    """The units that may be part of a removed run: ``again``, or the bitmap lets their digest through, among neighbours with which they have the words a run needs.

    A removed run lies within a run of such units, so that one has at least ``min_words`` words, half as many of them in telling units.
    Units of a text stand in order; a run that the edge of a batch cuts is let through, as its words can't be told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, unit, words, digest = (batch.column(i).to_numpy() for i in (1, 2, 5, 6))
            hit = batch.column(7).to_numpy(zero_copy_only=False) | wanted.at(digest & (wanted.size - 1))
            follows = np.zeros(len(hit), bool)
            follows[1:] = hit[:-1] & (doc[1:] == doc[:-1]) & (unit[1:] == unit[:-1] + 1)
            own = np.cumsum(~(hit & follows))  # the number of each row's run; rows that don't pass are runs of their own
            total, told = (np.bincount(own, weights=np.where(hit, w, 0)) for w in (words, np.where(words >= telling, words, 0)))
            enough = (total >= min_words) & (2 * told >= min_words)
            if len(own):
                enough[[own[0], own[-1]]] = True
            yield batch.filter(pa.array(hit & enough[own]))

    kinds = dict(units.dtypes)
    columns = ["_id", "_doc", "unit", "start", "stop", "words", "digest", "again"]
    return units.select(*columns).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, length_col: str | None = None, telling: int = 5) -> DataFrame:
    """``docs`` with the repeated spans cut out of the text; ``length_col``, if given, gets the new length. Only rows that may have spans are shuffled."""
    spans = _spans(docs, id_col, text_col, min_words, telling).groupBy(F.col(id_col).alias("_id"), "_doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
    spans = materialize(spans, "spans")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_doc"), F.struct(*docs.columns).alias("_row"))
    passing, maybe = by_filter(rows, spans, ["_id", "_doc"])
    joined = maybe.join(spans, ["_id", "_doc"], "left")
    text = F.col("_row").getField(text_col)
    starts = F.concat(F.array(F.lit(0)), F.col("_spans.stop"))
    stops = F.concat(F.col("_spans.start"), F.array(F.length(text)))
    parts = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.substring(text, x["a"] + 1, F.greatest(x["b"] - x["a"], F.lit(0))))
    cut = F.col("_row").withField(text_col, F.array_join(parts, ""))
    if length_col:
        cut = cut.withField(length_col, F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x)).cast(dict(docs.dtypes)[length_col]))
    changed = joined.select(F.when(F.col("_spans").isNull(), F.col("_row")).otherwise(cut).alias("_row"))
    return passing.select("_row").unionByName(changed).select("_row.*")
