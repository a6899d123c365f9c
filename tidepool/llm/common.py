"""What the text operators share: tables, shared storage, hashing of words and shingles."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Odd multipliers of the shingle hash; any odd 64-bit numbers do.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and the master is local (tests) a new temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-tidepool-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Per thread: tables that the stages of a pipeline have written, to be removed when the next stage begins.
_OWN = threading.local()


@contextmanager
def stage_tables(docs: DataFrame) -> Iterator[None]:
    """Inside, ``materialize`` keeps a list of its tables. Those of the stage before are removed first, if ``docs``, which that stage's result has become, doesn't read them."""
    jvm, conf = docs.sparkSession._jvm, docs.sparkSession._jsc.hadoopConfiguration()
    left, read = getattr(_OWN, "tables", []), docs.inputFiles()
    for path in left:
        if not any(path.rpartition("/")[2] in f for f in read):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    _OWN.tables, _OWN.on = [p for p in left if any(p.rpartition("/")[2] in f for f in read)], True
    try:
        yield
    finally:
        _OWN.on = False


def keep_stage_tables() -> None:
    """Tables of the last stage stay, since its result is handed on unread."""
    _OWN.tables = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidepool/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(_OWN, "on", False):
        _OWN.tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def word_pieces(text: str | None, translation: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a whole text as UTF-8, after ``translation`` of its bytes (to spaces where no word is), some ``size`` bytes at a time."""
    data = (text or "").encode("utf-8", "replace").translate(translation)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = end if end >= 0 else len(data)
        yield data[at:end].split()
        at = end


def merged_vector(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors of ``size`` 64-bit numbers, one to a row of a binary column, added up in a tree: the driver gets at most some 64 of them."""
    rdd = parts.rdd.map(lambda row: np.frombuffer(bytes(row[0]), np.int64))
    n = rdd.getNumPartitions()
    if n == 0:
        return np.zeros(size, np.int64)
    depth = next(d for d in range(2, 64) if n ** (1 / d) <= 64)
    return rdd.union(parts.sparkSession.sparkContext.parallelize([np.zeros(size, np.int64)], 1)).treeReduce(np.add, depth)


_CACHES: list[dict] = []


def alone(cache: dict) -> dict:
    """``cache``, with those of other operators emptied: a Python worker that serves one operator after the other holds one of them."""
    for other in _CACHES:
        if other is not cache and other:
            other.clear()
    if not any(other is cache for other in _CACHES):
        _CACHES.append(cache)
    pa.default_memory_pool().release_unused()
    return cache


class WordHashes(dict):
    """bytes of a word -> its 64-bit hash. Emptied at ``limit`` entries, so that memory stays bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One per Python worker, so that tasks after the first find it filled.
HASHES = WordHashes()


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows, in order; empty if there are fewer than k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * MIX[0]
    for i in range(1, k):
        out = scramble(out) + h[i : i + n] * MIX[i]
    return scramble(out)


@dataclass
class Bitmap:
    """A fixed-size set of hashed values, for dropping rows early; it may let rows through that it should not, never the reverse."""

    packed: np.ndarray
    size: int

    def position(self, value: Column) -> Column:
        """The bit of a value, as a long."""
        return F.pmod(F.xxhash64(value), F.lit(self.size))

    def at(self, positions: np.ndarray) -> np.ndarray:
        """Whether the bits at ``positions`` are set; the bitmap stays packed."""
        p = positions.astype(np.int64)
        return (self.packed[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0


def bitmap_of(df: DataFrame, column: str | None = None, position: Column | None = None, size: int = 1 << 22) -> Bitmap:
    """The bits of ``column``'s hashed values (or of ``position``, 0 to size - 1). The driver gets size / 8 bytes at most, whatever the rows."""
    out = Bitmap(np.zeros(size // 8, np.uint8), size)
    at = position if position is not None else out.position(F.col(column))
    blocks = df.select(at.cast("long").alias("p")).groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    for row in blocks.collect():
        part = np.frombuffer(row["bits"], np.uint8)
        start = (row["block"] - 1) * len(part)
        out.packed[start : start + len(part)] |= part
    return out


#: Sizes of the filters of ``without``, in bits: 16 a key, within these bounds (512 KB to 16 MB).
FEWEST_BITS, MOST_BITS = 1 << 22, 1 << 27


def _filter_of(keys: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """A one-row table of bits (longs), to be broadcast, and the condition under which a row's key may be among ``keys``."""
    n = keys.count()
    size = min(max(FEWEST_BITS, 1 << max(16 * n - 1, 1).bit_length()), MOST_BITS)
    at = F.pmod(F.xxhash64(*columns), F.lit(size))
    words = bitmap_of(keys, position=at, size=size).packed.view(np.int64)
    table = keys.sparkSession.createDataFrame(pa.table({"_bits": pa.array([words], pa.list_(pa.int64()))}))
    return F.broadcast(table), F.getbit(F.get("_bits", F.floor(at / 64).cast("int")), at % 64) == 1


def by_filter(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``columns`` don't occur in ``keys`` for sure, and those that a bitmap lets through. No shuffle of ``rows``."""
    bits, hit = _filter_of(keys, columns)
    return rows.join(bits, hit, "left_anti"), rows.join(bits, hit, "left_semi")


#: So many keys may be broadcast (of one or two short columns: some 20 MB).
FEW_KEYS = 200_000


def without(rows: DataFrame, gone: DataFrame, columns: list[str], few_keys: int = FEW_KEYS) -> DataFrame:
    """The rows of ``rows`` whose ``columns`` don't occur in ``gone``; null keys stay. Wide rows stay where they are.

    Up to ``few_keys`` distinct keys, which are counted, are broadcast. More of them are looked up in bitmaps: rows that miss one pass. Of
    those that hit it only the keys are shuffled, to find the few that hit by chance; a second bitmap picks these, and only rows that hit
    both meet the exact keys. Where the keys are too many for the largest bitmap it lets more rows through to that join. Results are the
    same either way.
    """
    gone = materialize(gone.select(*columns).distinct(), "gone")
    if gone.count() <= few_keys:
        return rows.join(F.broadcast(gone), columns, "left_anti").select(*rows.columns)
    passing, maybe = by_filter(rows, gone, columns)
    chance = materialize(maybe.select(*columns).join(gone, columns, "left_anti").distinct(), "chance")
    return passing.unionByName(by_filter(maybe, chance, columns)[1].join(gone, columns, "left_anti").select(*rows.columns))


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", part: int = 1000) -> DataFrame:
    """The keys that have more than 1 / ``part`` of all rows, of which there are fewer than ``part``. ``counts``: keys and their rows ``n``."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias("_all")))).filter(F.col(n) * part > F.col("_all")).select(*keys)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 64, hot: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``, however many rows of ``big`` one key has.

    ``hot``: the ``hot_keys`` of ``big``, counted here if not given; a bounded number, so they are broadcast. A hot key's rows are dealt
    over ``salts`` tasks by the hash of ``spread``, and its rows of ``small`` (few to a key) are repeated for each.
    """
    if hot is None:
        hot = hot_keys(big.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    hot = hot.select(*keys).distinct().withColumn("_hot", F.lit(True))
    left = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
