"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. How to pack depends only on how many pieces there are of each length, and
there are at most ``capacity`` lengths: that histogram is all the driver sees, whatever the corpus. On it, small sets that provably
dominate every other way to fill a bin are fixed first and taken out; the remainder is packed best-fit, longest first. The result is
a short table of bin patterns with multiplicities. Pieces then find their place by their rank within their length; ranks are counted
in hashed buckets and put end to end by bucket totals, so that no task holds all pieces of a common length.

Defined cases: a null text is the empty one, whose only token is the end mark; longer documents are cut from the back, so that only
the first piece may be short; ties are broken by id and piece; repeated rows are packed once each; null ids
are packed like others; extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepool.llm.common import alone, materialize

END = 2
#: Before a space that stands alone between two characters that no alphabet counts as white space.
_CUT = re.compile(r"(?<=\S)(?= \S)")


class Encoder(dict):
    """Text before which a token must begin -> its ids as little-endian bytes; emptied when it reaches ``limit`` entries.

    A run of white space may be one token or give its last space to the next word, but the vocabulary's pattern never joins a space that
    stands alone between two other characters to the first of them. Text cut there, and nowhere else, has the same ids.
    """

    def __init__(self, vocabulary: str, limit: int = 250_000):
        import public_tokenizers as tokenizers
        import tiktoken

        super().__init__()
        self.limit = limit
        with open(tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(vocabulary, pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self[part] = self.plain(part)
        return value

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, _CUT.split(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One per Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def pieces_of(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, piece, start, length, ids_crc32 of every piece of every document."""
    kind = dict(docs.select(F.col(id_col).alias("_id")).dtypes)["_id"]
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = alone(encoder(vocabulary))
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                k = -(-n // capacity)
                cuts = [0, *range(n - (k - 1) * capacity, n + 1, capacity)]
                for j in range(k):
                    row.append(i)
                    piece.append(j)
                    start.append(cuts[j])
                    length.append(cuts[j + 1] - cuts[j])
                    crc.append(zlib.crc32(ids[4 * cuts[j] : 4 * cuts[j + 1]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] += count

    def largest(self, most: int) -> int:
        """The largest length up to ``most``, or 0."""
        at = np.flatnonzero(self.n[1 : most + 1]) if most > 0 else []
        return int(at[-1]) + 1 if len(at) else 0

    def smallest(self, how_many: int) -> list[int]:
        out: list[int] = []
        for length in np.flatnonzero(self.n)[:how_many]:
            out += [int(length)] * min(int(self.n[length]), how_many - len(out))
        return out[:how_many]

    def best_pair(self, room: int) -> tuple[int, int]:
        """Lengths a >= b with the largest sum up to ``room``; (0, 0) if none."""
        best = (0, 0)
        for a in np.flatnonzero(self.n[: room + 1]):
            a = int(a)
            self.n[a] -= 1
            b = self.largest(min(a, room - a))
            self.n[a] += 1
            if b and a + b >= sum(best):
                best = (a, b)
        return best


def dominant_sets(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Martello-Toth reduction of the histogram: (fixed bins with multiplicities, what is left).

    For each length j, longest first, with ``fit`` = how many of the shortest others go beside it (counted up to 3):
    none fits: {j}; one fits, or the longest that fits fills the bin: {j, longest}; two fit: {j, longest} if no two together beat it,
    {j, a, b} if the best pair has that longest and no smaller pair can be better than it. Otherwise j stays for the heuristic.
    """
    left, fixed = _Stock(counts, capacity), []

    def fix(bin_: list[int]) -> None:
        need = {x: bin_.count(x) for x in bin_}
        times = min(int(left.n[x]) // k for x, k in need.items())
        for x, k in need.items():
            left.n[x] -= times * k
        fixed.append((times, need))

    for j in range(capacity, 0, -1):
        while left.n[j] > 0:
            left.n[j] -= 1
            room = capacity - j
            fit = int((np.cumsum(left.smallest(3)) <= room).sum())
            star = left.largest(room)
            a, b = left.best_pair(room) if fit == 2 and j + star < capacity else (0, 0)
            after = [int(x) for x in np.flatnonzero(left.n) if b and x > b for _ in range(min(int(left.n[x]) - (x == a), 2))][:2]
            left.n[j] += 1
            if fit == 0:
                fix([j])
            elif fit == 1 or j + star == capacity or (fit == 2 and star >= a + b):
                if star == j and left.n[j] < 2:
                    break
                fix([j, star])
            elif fit == 2 and star == a and left.n[b] == 1 and (len(after) < 2 or j + sum(after) > capacity) and len({j, a, b}) == 3:
                fix([j, a, b])
            else:
                break
    return fixed, {int(x): int(left.n[x]) for x in np.flatnonzero(left.n)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on the histogram: bins alike are kept as one pattern with a multiplicity."""
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for x in sorted(counts, reverse=True):
        k = counts[x]
        while k:
            room = min((r for r in by_room if r >= x), default=0)
            if room:
                times, bin_ = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
            else:
                room, times, bin_ = capacity, k, {}
            m = min(room // x, k)
            use = min(times, k // m)
            if times > use and bin_:
                by_room.setdefault(room, []).append((times - use, bin_))
            by_room.setdefault(room - m * x, []).append((use, bin_ | {x: m}))
            k -= use * m
    return [p for room in sorted(by_room) for p in by_room[room]]


def pack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    fixed, rest = dominant_sets(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The patterns as rows (length, first rank, first sequence, pieces of that length a bin, offset of the first), sorted by length and rank."""
    rows, next_rank, sequence = [], {}, 0
    for times, bin_ in patterns:
        offset = 0
        for length in sorted(bin_, reverse=True):
            rows.append((length, next_rank.get(length, 0), sequence, bin_[length], offset))
            next_rank[length] = next_rank.get(length, 0) + times * bin_[length]
            offset += length * bin_[length]
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "sequence", "per_bin", "offset"))}


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 50_000) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(pieces_of(docs, vocabulary, capacity, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = places(pack(histogram, capacity))
    step = 1 << 42
    keys = table["length"] * step + table["rank"]

    buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(buckets)))
    totals = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).select("_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            nth = rank - table["rank"][at]
            sequence = table["sequence"][at] + nth // table["per_bin"][at]
            offset = table["offset"][at] + nth % table["per_bin"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["_id"]
    return ranked.mapInArrow(place, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").withColumnRenamed("_id", id_col)
