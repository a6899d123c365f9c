"""Importance resampling toward a target: hashed word n-grams, a gain per bucket, and a seeded draw of the best share.

Two passes over the texts in Arrow batches. The first counts features per bucket, one vector of a fixed size a partition, merged by a
tree of partial sums. The driver makes gains of the two vectors (10,000 numbers, whatever the corpus); the second pass gathers them for
each feature and sums them by document. Log-ratio weights with Gumbel noise, cut at a rank, are a sample without replacement in
proportion to the ratios. Ranks are counted in ranges of the order, put end to end by the ranges' sizes: no task holds all scores.

Defined cases: a null text has no features; very long texts are read whole, a piece at a time; ties of score go to the smaller id;
repeated rows are ranked once each, in any order among themselves; a null id draws as the empty string and comes after others; extra
columns are ignored, whatever their names. An empty table gives an empty result; without target texts gains only tell rare from common.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepool.llm.common import materialize, merged_vector, word_pieces

#: Lower-cases A-Z, keeps digits, a-z and all bytes of other characters, and blanks the rest.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Buckets(dict):
    """feature -> its bucket; emptied when it reaches ``limit`` entries."""

    def __init__(self, buckets: int, limit: int = 300_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value

    def of(self, text: str | None, longest: int) -> Iterator[np.ndarray]:
        """Buckets of all runs of 1 to ``longest`` words of a text, a piece of the text at a time."""
        before: list[bytes] = []
        for words in word_pieces(text, _WORDS):
            if longest == 1:
                features = words
            else:
                new, words = len(before), before + words
                features = [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(max(0, new - n + 1), len(words) - n + 1)]
                before = words[1 - longest :]
            yield np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for at in known.of(text.as_py(), longest):
                    total += np.bincount(at, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return merged_vector(texts.select(F.col(text_col).alias("_text")).mapInArrow(run, "counts binary"), buckets)


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: 1000 times the logarithm of the target's smoothed share over the corpus's, rounded down."""
    n, (s, t) = len(corpus), (float(corpus.sum()), float(target.sum()))
    ratio = (target + 1.0) * (s + n) / ((corpus + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_features, n_words, weight of every document."""
    kind = dict(docs.select(F.col(id_col).alias("_id")).dtypes)["_id"]
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, known = sent.value, Buckets(len(sent.value))
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            row, at, held = [], [], 0

            def add() -> None:
                nonlocal held
                if row:
                    of, buckets = np.repeat(row, list(map(len, at))), np.concatenate(at)
                    n[:] += np.bincount(of, minlength=len(n))
                    weight[:] += np.bincount(of, weights=gain[buckets], minlength=len(n))
                row.clear(), at.clear()
                held = 0

            for i, text in enumerate(batch.column(1)):
                for buckets in known.of(text.as_py(), longest):
                    row.append(i)
                    at.append(buckets)
                    held += len(buckets)
                    if held >= 1 << 20:
                        add()
            add()
            # Of n words, longest runs have n + (n - 1) + ... words in all; the words are told from that.
            words = n if longest == 1 else np.array([_words_for(int(x), longest) for x in n], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(words), pa.array(weight.astype(np.int64))], names=["_id", "n_features", "n_words", "weight"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_features bigint, n_words bigint, weight bigint")


def _words_for(features: int, longest: int) -> int:
    """How many words give so many runs of 1 to ``longest`` words."""
    for words in range(longest):
        if words * (words + 1) // 2 == features:
            return words
    return (features + longest * (longest - 1) // 2) // longest


def gumbel(id_col: str, seed: int = 2024) -> Column:
    """1000 times a standard Gumbel number that depends on the seed and the id alone, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def with_ranks(rows: DataFrame, order: list[Column], partitions: int) -> DataFrame:
    """``rows`` and their 0-based ``rank`` in a total ``order``: each range of the order counts its own, the sizes of those before it are added."""
    placed = materialize(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumns({"_part": F.shiftrightunsigned("_at", 33), "_at": F.col("_at") % (1 << 33)})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each of ``partitions``
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every document's id, n_features, weight, score and rank: 1, 2, ... for the drawn ``percent`` of those with ``least_words`` words, else null."""
    gains = gains_of(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    scored = weighted(docs, gains, longest, id_col, text_col).withColumns({"score": F.col("weight") + gumbel("_id", seed), "_able": F.col("n_words") >= least_words, "_row": F.monotonically_increasing_id()})
    scored = materialize(scored.drop("n_words"), "scored")
    able = scored.filter("_able").count()
    order = [F.desc("_able"), F.desc("score"), F.asc_nulls_last("_id"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.when(F.col("_able") & (F.col("rank") < able * percent // 100), F.col("rank") + 1)
    return with_ranks(scored, order, partitions).select(F.col("_id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))


#: CRC-32 by its table: bit steps for the 256 entries, then a fold over the bytes of each distinct word.
ORACLE_SQL = r"""
with recursive steps(b, c, k) as (
  select range::bigint, range::bigint, 0 from range(256)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc_table as (select list(c order by b) tab from steps where k = 8),
lowered as (select 'd' side, doc_id id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents
  union all select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
words as (select side, id, unnest(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from lowered),
counted as (select side, id, w, count(*) n from words group by all),
bytes as (select w, hex(encode(w)) h from (select distinct w from counted)),
hashed as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(h, 2 * i::int - 1, 2))::bigint)),
  lambda acc, x: xor(tab[xor(acc & 255, x) + 1], acc >> 8)), 4294967295) % 10000 bucket from bytes, crc_table),
placed as (select side, id, bucket, sum(n)::bigint n from counted join hashed using (w) group by all),
s as (select bucket, sum(n) c from placed where side = 'd' group by 1),
t as (select bucket, sum(n) c from placed where side = 'b' group by 1),
gains as (select b.range bucket, floor(1000 * ln((coalesce(t.c, 0) + 1)::double * ((select coalesce(sum(c), 0) from s) + 10000)::double
  / ((coalesce(s.c, 0) + 1)::double * ((select coalesce(sum(c), 0) from t) + 10000)::double)))::bigint gain
  from range(10000) b left join s on s.bucket = b.range left join t on t.bucket = b.range),
per_doc as (select id, sum(n)::bigint n, sum(n * gain)::bigint weight from placed join gains using (bucket) where side = 'd' group by 1),
scored as (select doc_id, coalesce(n, 0) n_features, coalesce(weight, 0) weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::bigint + 0.5) / 4294967296)))::bigint score
  from documents left join per_doc on id = doc_id),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) k from scored where n_features >= 20)
select s.doc_id, n_features, weight, score, case when k <= (select count(*) from drawn) * 10 // 100 then k end as rank
from scored s left join drawn using (doc_id)"""
