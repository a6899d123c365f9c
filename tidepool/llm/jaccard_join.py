"""Exact self-join of documents by the Jaccard similarity of their word n-gram sets.

1. Each text becomes a sorted set of shingle hashes, a digest of the set, a bitmap signature and a prefix. Shingles are ordered from
   rare to common (common ones are found by local counts that are summed; only the order depends on them, never the result). Two sets
   with similarity of at least t share a shingle among the first n - ceil(t n) + 1 of each: the prefixes.
2. Texts with equal sets are one class; its smallest id stands for it.
3. Prefix shingles that two classes share are kept. First each class is compared with the smallest, then with the largest id that
   shares a shingle with it: a number of pairs linear in the prefixes, which joins most near copies to their groups.
4. What may still link are classes of different groups under one shingle. They are dealt into tiles by shingle and size band (sizes
   of linked sets differ by less than one band), tiles of many rows in blocks of chunk pairs, and compared there by signature.
5. A signature holds, per hashed bit, the parity of the shingles that fall on it. The bits in which two signatures differ number at
   most the shingles in which the sets differ, so they bound the overlap from above. Pairs that pass are decided by exact
   intersection of the sorted sets.
6. Components of the links, as joins and grouped minima.

No pair is dropped unless a bound rules it out, and pairs inside a group are not expanded once it is known to be connected.

Defined cases: null and empty texts have no shingles, link with nothing and are their own component; shorter texts than a shingle are
one shingle of all their words; very long texts are read whole; bytes that are no UTF-8 are part of words; rows with equal ids are one
document that links where any of its texts does; a null id gets a null component; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidepool.llm.common import HASHES, Bitmap, WordHashes, alone, bitmap_of, by_filter, hot_keys, materialize, salted_join, scramble, windows, without
from tidepool.llm.components import components

#: Numbers of 64 bits in a signature: two bits a shingle, at least LEAST and in tiles at most MOST of them; powers of two.
LEAST, MOST = 16, 64


def shingles(text: str | bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of a text (or its bytes, UTF-8 or not) whose letters A-Z are lowered."""
    data = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    h = hashes.of(data.lower().split())
    if not len(h):
        return h
    if len(h) < k:
        return scramble(windows(h, len(h)) + np.uint64(len(h)))
    return np.unique(windows(h, k))


def signature(s: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """Parity bitmap of a set: bit i is the parity of its shingles whose hash ends in i. Two halves XORed are the bitmap of half the size."""
    lanes = min(max(LEAST, 1 << max(len(s) // 32 - 1, 0).bit_length()), most)
    bits = (np.bincount((s & np.uint64(64 * lanes - 1)).astype(np.int64), minlength=64 * lanes) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def folded(sig: np.ndarray, lanes: int) -> np.ndarray:
    """Signatures (rows of equal length) as they would be with fewer lanes."""
    while sig.shape[1] > lanes:
        half = sig.shape[1] // 2
        sig = sig[:, :half] ^ sig[:, half:]
    return sig


def prefix(s: np.ndarray, percent: int, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order rare (by hash), then common (by rank)."""
    p = len(s) - -(-percent * len(s) // 100) + 1
    if not len(common):
        return s[:p]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    hit = common[at] == s
    rare = s[~hit]
    if len(rare) >= p:
        return rare[:p]
    often = s[hit][np.argsort(rank[at[hit]], kind="stable")]
    return np.concatenate([rare, often[: p - len(rare)]])


def common_shingles(docs: DataFrame, k: int, most: int = 1 << 17, block: int = 2_000_000, local: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` of the commonest shingles (sorted), their ranks from rarer to commoner, and their counts.

    Counts of shingles that ``local`` documents of one block of shingles share are summed. The driver gets at most ``most`` rows,
    whatever the corpus; they only order prefixes and tell which shingles are hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        alone(HASHES)

        def counted() -> pa.RecordBatch:
            s = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
            n = np.diff(np.append(edge, len(s)))
            keep = n >= local
            return pa.RecordBatch.from_arrays([pa.array(s[edge[keep]].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py(), k, HASHES)
                held.append(s)
                total += len(s)
                if total >= block:
                    yield counted()
                    held.clear()
                    total = 0
        yield counted()

    rows = docs.select("_text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toArrow()
    h = np.array(rows["h"], np.int64).view(np.uint64)
    by_hash = np.argsort(h)
    return h[by_hash], np.arange(len(h), 0, -1)[by_hash], np.array(rows["n"], np.int64)[by_hash]


def described(docs: DataFrame, k: int, percent: int, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """_id, n, d1, d2 (digest of the set), prefix, sig (for tiles), wide (whole signature where sig is cut); one row per row of ``docs``."""
    kind = dict(docs.dtypes)["_id"]

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        flat = np.concatenate([a.view(np.int64) for a in arrays]) if arrays else np.empty(0, np.int64)  # signed and unsigned together would become floats
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(HASHES)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                n, digests, prefixes, sigs, wide = [], [], [], [], []
                for text in batch.column(1).slice(at, 1000):
                    s = shingles(text.as_py(), k, HASHES)
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    prefixes.append(prefix(s, percent, common, rank) if len(s) else s)
                    sigs.append(signature(s, MOST))
                    wide.append(signature(s) if len(s) > 32 * MOST else s[:0])
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), lists(prefixes), lists(sigs), lists(wide)], names=["_id", "n", "d1", "d2", "prefix", "sig", "wide"])

    return docs.select("_id", "_text").mapInArrow(run, f"_id {kind}, n bigint, d1 bigint, d2 bigint, prefix array<bigint>, sig array<bigint>, wide array<bigint>")


#: Shingles of fewer documents are never hot.
HOT_ROWS = 1000
#: Bits of the fixed-size filter of shared prefix shingles.
POSTING_BITS = 1 << 24


def postings(table: DataFrame, wanted: Bitmap) -> DataFrame:
    """_id, n, d1, d2, h: one row per prefix shingle that the bitmap lets through."""
    kind = dict(table.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            h = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
            hit = wanted.at(h & (wanted.size - 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row[hit])) for i in range(4)), pa.array(h[hit])], names=["_id", "n", "d1", "d2", "h"])

    return table.select("_id", "n", "d1", "d2", "prefix").mapInArrow(run, f"_id {kind}, n bigint, d1 bigint, d2 bigint, h bigint")


def _sizes_allow(percent: int, na: Column, nb: Column) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _may_link(percent: int, na: Column, nb: Column, sa: Column, sb: Column) -> Column:
    """Sizes and signatures leave room for the similarity asked for. Signatures of sizes that do differ twofold at most."""
    half = lambda s: F.zip_with(F.slice(s, F.lit(1), F.floor(F.size(s) / 2).cast("int")), F.slice(s, F.floor(F.size(s) / 2).cast("int") + 1, F.floor(F.size(s) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    less = lambda s, other: F.when(F.size(s) > F.size(other), half(s)).otherwise(s)
    differ = F.aggregate(F.zip_with(less(sa, sb), less(sb, sa), lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)).cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return _sizes_allow(percent, na, nb) & ((100 - percent) * (na + nb) >= (100 + percent) * differ)


def verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Only texts whose id passes a fixed-size bitmap of the pairs' ids are made into sets again."""
    whole = F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("sig"))
    side = lambda x: sigs.select(F.col("_id").alias(x), F.col("n").alias(f"n{x}"), whole.alias(f"s{x}"))
    # Sizes alone rule most pairs out, before signatures are shuffled for the others.
    sizes = sigs.select("_id", "n").distinct()
    size = lambda x: sizes.select(F.col("_id").alias(x), F.col("n").alias(f"n{x}"))
    near = pairs.join(size("a"), "a").join(size("b"), "b").filter(_sizes_allow(percent, F.col("na"), F.col("nb"))).select("a", "b").distinct()
    left = near.join(side("a"), "a").join(side("b"), "b").filter(_may_link(percent, F.col("na"), F.col("nb"), F.col("sa"), F.col("sb")))
    left = materialize(left.select("a", "b").distinct(), "candidates")
    wanted = bitmap_of(left.select(F.explode(F.array("a", "b")).alias("_id")), "_id")
    kind = dict(docs.dtypes)["_id"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(HASHES)
        for batch in batches:
            there = np.flatnonzero(wanted.at(batch.column(1).to_numpy()))
            for at in range(0, len(there), 1000):
                own = there[at : at + 1000]
                found = [shingles(batch.column(2)[int(i)].as_py(), k, HASHES) for i in own]
                full = np.array([len(s) > 0 for s in found])  # an id of a pair may have an empty text, too
                if not full.any():
                    continue
                own, found = own[full], [s for s in found if len(s)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))], names=["_id", "s"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = docs.filter(F.col("_id").isNotNull()).select("_id", wanted.position(F.col("_id")).alias("at"), "_text").mapInArrow(sets, f"_id {kind}, s array<bigint>")
    whole = left.join(own.select(F.col("_id").alias("a"), F.col("s").alias("x")), "a").join(own.select(F.col("_id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
    return materialize(whole.mapInArrow(overlap, f"a {kind}, b {kind}").distinct(), "links")


def tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups within a tile that sizes and signatures leave possible.

    ``tiles``: h, tile, i, j (the tile's key), lower (from the band below), chunk, _id, n, label, sig. Each key has two chunks of rows
    at most; rows are sorted by key within partitions and streamed.
    """
    kind = dict(tiles.dtypes)["_id"]
    keys = ["tile", "h", "i", "j"]

    def pairs(t: pa.Table, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        band = t["tile"].to_numpy()
        cuts = [0, *(np.flatnonzero(band[1:] != band[:-1]) + 1).tolist(), len(band)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield in_band(t.slice(start, end - start), key[start:end])

    def in_band(t: pa.Table, key: np.ndarray) -> pa.RecordBatch:
        n, lower, chunk = (t[c].to_numpy() for c in ("n", "lower", "chunk"))
        i, j = t["i"].to_numpy(), t["j"].to_numpy()
        label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        sigs = t["sig"].combine_chunks()
        lanes = pa.compute.list_value_length(sigs).to_numpy()
        flat, ends, least = sigs.flatten().to_numpy().view(np.uint64), np.cumsum(lanes), int(lanes.min())
        sig = np.empty((len(key), least), np.uint64)
        for size in np.unique(lanes):
            own = np.flatnonzero(lanes == size)
            sig[own] = folded(flat[(ends[own] - size)[:, None] + np.arange(size)], least)
        a_out, b_out = [], []
        d = 1
        while d < len(key):
            a = np.flatnonzero(key[d:] == key[:-d])
            if not len(a):
                break
            b = a + d
            ok = (label[a] != label[b]) & ~(lower[a] & lower[b]) & ((i[a] == j[a]) | (chunk[a] != chunk[b])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            differ = np.bitwise_count(sig[a] ^ sig[b]).sum(1, dtype=np.int64)
            ok = (100 - percent) * (n[a] + n[b]) >= (100 + percent) * differ
            a_out.append(a[ok])
            b_out.append(b[ok])
            d += 1
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a_out, b_out))
        ids = t["_id"].combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t = pa.Table.from_batches(held)
            k = np.stack([t[c].to_numpy() for c in keys], 1)
            starts = np.concatenate([[True], (k[1:] != k[:-1]).any(1)])
            key = np.cumsum(starts)
            end = len(key) if last else int(np.flatnonzero(starts)[-1])
            if end:
                yield from pairs(t.slice(0, end), key[:end])
            held = t.slice(end).to_batches()
            rows = len(key) - end

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 32_768:
                yield from cut(False)
        if rows:
            yield from cut(True)

    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "lower", "chunk", "_id", "n", "label", "sig")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, chunk_rows: int = 1024) -> DataFrame:
    """Per row: id, n_shingles, component_id. ``percent``: documents link when 100 * intersection >= percent * union."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    common, rank, counts = common_shingles(docs, k)
    # Shingles that very many documents share: their rows are dealt over many tasks. Any choice gives the same result.
    often = common[counts >= max(HOT_ROWS, docs.count() // 1000)].view(np.int64)
    hot = docs.sparkSession.createDataFrame(pa.table({"h": pa.array(often)}))
    table = materialize(described(docs, k, percent, common, rank), "sets")

    usable = table.filter((F.col("n") > 0) & F.col("_id").isNotNull())
    classes = materialize(usable.groupBy("n", "d1", "d2").agg(F.min("_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = classes.select(F.col("rep").alias("_id"), "n", "d1", "d2")
    # Most prefix shingles are one class's own. The hashes that several ids have make a bitmap, by which the rest is dropped before
    # the rows of the others are shuffled to meet the classes' representatives.
    several = usable.select("_id", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("_id").alias("x"), F.max("_id").alias("y")).filter("x < y")
    # Shingles that pass by chance have one member and go with the filter on members below.
    rows = postings(usable, bitmap_of(several, position=F.col("h").bitwiseAND(F.lit(POSTING_BITS - 1)), size=POSTING_BITS))
    # Repeated rows count once (the join has dealt them by what tells them apart): two copies would cancel out of the XOR below.
    rows = materialize(rows.join(reps, ["_id", "n", "d1", "d2"], "left_semi").select("h", "_id", "n", "d1", "d2").distinct(), "postings")
    # A shared passage gives many shingles to the same documents: of shingles with the same members (by their number, ends and
    # two combined hashes) one is kept, since the others would compare the same pairs.
    mixes = [F.bit_xor(F.xxhash64(*c)).alias(x) for x, c in (("mix", ("_id", "n", "d1", "d2")), ("mix2", ("d2", "d1", "n", "_id")))]
    members = rows.groupBy("h").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.count("*").alias("c"), *mixes).filter("lo < hi")
    ends = materialize(members.groupBy("lo", "hi", "c", "mix", "mix2").agg(F.min("h").alias("h")).select("h", "lo", "hi"), "ends")
    # Most rows are of shingles that went: a bitmap drops them before the shuffle.
    shared = materialize(salted_join(by_filter(rows, ends, ["h"])[1], ends, ["h"], F.col("_id"), hot=hot), "shared")
    sigs = usable.select("_id", "n", "d1", "d2", "sig", "wide")

    none = shared.select(F.col("_id").alias("node"), F.col("_id").alias("label")).limit(0)
    # An id with several texts is in several classes, which it connects; one of them may be empty and take the label of the others.
    mixed_ids = table.groupBy("_id").agg(*(f("d1").alias(f"{f.__name__}1") for f in (F.min, F.max)), *(f("d2").alias(f"{f.__name__}2") for f in (F.min, F.max))).filter("min1 < max1 or min2 < max2").select("_id")
    links = materialize(usable.join(mixed_ids, "_id").join(classes, ["n", "d1", "d2"]).select(F.least("_id", "rep").alias("a"), F.greatest("_id", "rep").alias("b")).distinct(), "links")
    labels = none
    for end in ("lo", "hi"):
        pairs = shared.select(F.least("_id", end).alias("a"), F.greatest("_id", end).alias("b")).filter("a < b").distinct()
        pairs = _across(pairs, labels)
        new = verified(pairs, sigs, docs, k, percent)
        links = links.unionByName(new)
        labels = components(links)

    known = shared.join(labels, F.col("_id") == F.col("node"), "left").select("h", "_id", "n", "d1", "d2", F.coalesce("label", "_id").alias("label"))
    mixed = known.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("h")
    open_ = materialize(salted_join(known, mixed, ["h"], F.col("_id"), hot=hot), "open")
    if open_.limit(1).count():
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("long")
        rows = open_.withColumn("band", band).select("*", F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(False).alias("lower")), F.struct((F.col("band") + 1).alias("tile"), F.lit(True).alias("lower")))).alias("t"))
        rows = rows.select("h", "_id", "n", "d1", "d2", "label", "t.tile", "t.lower")
        sizes = rows.groupBy("h", "tile").agg(F.count("*").alias("rows"), F.min("label").alias("x"), F.max("label").alias("y"), F.bool_and("lower").alias("low")).filter("x < y and not low")
        sizes = materialize(sizes.select("h", "tile", F.col("rows").alias("n"), F.ceil(F.col("rows") / chunk_rows).cast("int").alias("q")), "sizes")
        rows = salted_join(rows, sizes.drop("n"), ["h", "tile"], F.col("_id"), hot=hot_keys(sizes, ["h", "tile"]))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("_id"), F.col("q")).cast("int")).join(sigs.select("_id", "n", "d1", "d2", "sig").dropDuplicates(["_id", "n", "d1", "d2"]), ["_id", "n", "d1", "d2"])
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("other"))
        rows = rows.select("h", "tile", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "lower", "chunk", "_id", "n", "label", "sig")
        new = verified(tile_pairs(rows, percent), sigs, docs, k, percent)
        labels = components(links.unionByName(new))

    copies = classes.filter("copies > 1").select("n", "d1", "d2", "rep", "copies")
    rows = salted_join(table.select("_id", "n", "d1", "d2"), copies.drop("copies"), ["n", "d1", "d2"], F.col("_id"), "left", hot=hot_keys(copies, ["n", "d1", "d2"], "copies"))
    rows = rows.select("_id", "n", F.when((F.col("n") > 0) & F.col("_id").isNotNull(), F.coalesce("rep", "_id")).otherwise(F.col("_id")).alias("node"))
    out = salted_join(rows, labels, ["node"], F.col("_id"), "left", hot=hot_keys(copies.withColumnRenamed("rep", "node"), ["node"], "copies"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends aren't known to be connected."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns kept, rows with a null id stay."""
    return without(docs, found.filter(F.col("component_id") != F.col(id_col)).select(id_col), [id_col])
