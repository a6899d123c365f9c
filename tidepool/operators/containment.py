"""Which of many names occur inside which of many texts, as a join.

Every name has an anchor: of its windows of a fixed number of bytes, one that few names have (short names are their own anchor). A text
gives those of its windows that some name's anchor may be, by a bitmap of the anchors; they meet the names by hash, and what meets is
compared in full. Neither side is collected or broadcast, and a text costs the same for ten names and for ten million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepool.operators.skew import dealt_join
from tidepool.session import stored

#: Bytes of an anchor: the largest of these that a name has.
SIZES = (8, 4, 3, 2, 1)
#: Bits of the filter: 16 an anchor within these bounds (at most 16 MB).
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 27


def window_hashes(data: bytes, size: int) -> np.ndarray:
    """A 64-bit number for each run of ``size`` bytes, one to one with the run."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(b) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h << np.uint64(8)) | b[i : i + n]
    return h.view(np.int64)


def _place(h: np.ndarray, size: int, bits: int) -> np.ndarray:
    x = (h.view(np.uint64) + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(bits - 1)).astype(np.int64)


def anchors(names: DataFrame) -> DataFrame:
    """(name, size, h): each name's anchor, the window that fewest names have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sizes, hashes = [], [], []
            for i, name in enumerate(batch.column(0).to_pylist()):
                data = name.encode("utf-8", "replace")
                size = next(s for s in SIZES if s <= len(data))
                for h in np.unique(window_hashes(data, size)).tolist():
                    own.append(i)
                    sizes.append(size)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], names=["name", "size", "h"])

    windows = stored(names.select("name").filter(F.length("name") > 0).distinct().mapInArrow(run, "name string, size int, h bigint"), "windows")
    held = windows.groupBy("size", "h").agg(F.count("*").alias("n"))
    counted = dealt_join(windows, held, ["size", "h"], F.col("name"))
    return counted.groupBy("name").agg(F.min(F.struct("n", "size", "h")).alias("x")).select("name", "x.size", "x.h")


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): names that occur in the texts as they are written, each once a text. ``texts``: id, text; ``names``: name. Empty names and null texts are in nothing."""
    found = stored(anchors(names), "anchors")
    n = found.count()
    kind = dict(texts.dtypes)["id"]
    if not n:
        return texts.sparkSession.createDataFrame([], f"id {kind}, name string")
    bits = min(max(FEWEST_BITS, 1 << (16 * n - 1).bit_length()), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.concatenate([_place(h[size == s], s, bits) for s in SIZES])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at))], names=["p"])

    blocks = found.select("size", "h").mapInArrow(places, "p bigint").groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    packed = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in blocks.collect():  # at most 16 MB
        part = np.frombuffer(row["bits"], np.uint8)
        packed[(row["block"] - 1) * len(part) : row["block"] * len(part)] |= part
    used = [r[0] for r in found.select("size").distinct().collect()]  # five at most
    sent = texts.sparkSession.sparkContext.broadcast((packed, sorted(used)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, sizes = sent.value
        for batch in batches:
            own, size, hashes = [], [], []
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "replace")
                for s in sizes:
                    for at in range(0, len(data), 1 << 20):  # a piece at a time, with what windows reach over its end
                        h = window_hashes(data[at : at + (1 << 20) + s - 1], s)
                        p = _place(h, s, bits)
                        h = np.unique(h[(bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0])
                        own.append(np.full(len(h), i))
                        size.append(np.full(len(h), s, np.int32))
                        hashes.append(h)
            if own:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(own))), pa.array(np.concatenate(size)), pa.array(np.concatenate(hashes))], names=["id", "size", "h"])

    met = dealt_join(texts.select("id", "text").mapInArrow(run, f"id {kind}, size int, h bigint").distinct(), found, ["size", "h"], F.col("id"))
    candidates = met.select("id", "name").distinct()
    return candidates.join(texts.filter(F.col("text").isNotNull()), "id").filter(F.contains("text", F.col("name"))).select("id", "name").distinct()


def lookup(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, id): requests and entities of which one's lower-case text contains the other's. ``entities``: id, name; ``requests``: query_id, query."""
    names = stored(entities.select("id", F.lower("name").alias("text")), "names")
    asked = stored(requests.select(F.col("query_id").alias("id"), F.lower("query").alias("text")), "asked")
    inside = contained(asked, names.select(F.col("text").alias("name"))).join(names.withColumnsRenamed({"id": "entity", "text": "name"}), "name").select(F.col("id").alias("query_id"), F.col("entity").alias("id"))
    around = contained(names, asked.select(F.col("text").alias("name"))).join(asked.withColumnsRenamed({"id": "query_id", "text": "name"}), "name").select("query_id", "id")
    return inside.union(around).distinct()
