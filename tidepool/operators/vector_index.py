"""Exact nearest vectors by a stored index whose blocks are skipped where the triangle inequality allows.

Vectors are scaled to length 1 and dealt to the nearest of some centres (k-means of a bounded sample; any centres give the same results).
Within a list they lie in order of their distance from its centre, cut into blocks; a block knows its least and largest distance. A query
first reads the blocks of its nearest list, which gives a bound on its k-th best; then it reads those blocks of other lists that may
hold something within that bound: |d(query, centre) - d(vector, centre)| is at most d(query, vector). Queries are a relation that meets
the blocks by a join, so the plan is the same for ten requests and for ten million; in a task, blocks and queries meet as matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepool.session import scratch, stored

#: Distances are worked out to some 1e-15; bounds are wider by this.
SLACK = 1e-7


def units(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1 (or 0) in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-300)


def k_means(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample; starts are rows spread evenly over it."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)] if len(sample) else sample
    for _ in range(rounds if len(sample) else 0):
        own = nearest(sample, centres)
        n = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of every row from every centre."""
    square = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(square, 0))


@dataclass
class VectorIndex:
    """``blocks``: list, block, n, lo, hi, ids, vectors; ``centres`` and ``radius`` by list, at most ``lists`` of them."""

    blocks: DataFrame
    centres: np.ndarray
    radius: np.ndarray

    @property
    def id_type(self) -> str:
        return dict(self.blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")


def build(vectors: DataFrame, path: str | None = None, lists: int | None = None, block_rows: int = 1024, sample: int = 16_384, id_col: str = "doc_id") -> VectorIndex:
    """Write the index of ``vectors`` (id, embedding; null embeddings go) to ``path``, a shared folder. ``sample``: rows that the centres are made of."""
    spark = vectors.sparkSession
    path = path or scratch(spark, "vector-index")
    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), "embedding")
    kind, n = dict(rows.dtypes)["id"], rows.count()
    lists = max(1, min(lists or round(n**0.5 / 2), 1024, n))
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow() if n else None
    sent = spark.sparkContext.broadcast(k_means(units(few["embedding"].combine_chunks()), lists) if n else np.zeros((1, 1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            x = units(batch.column(1))
            own = nearest(x, centres) if len(x) else np.empty(0, np.int64)
            away = x - centres[own] if len(x) else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(np.sqrt((away * away).sum(1))), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "list", "d", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def block(t: pa.Table) -> pa.RecordBatch:
            d = t["d"].to_numpy()
            ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t["id"].combine_chunks())
            return pa.RecordBatch.from_arrays([t["list"].slice(0, 1).combine_chunks(), pa.array([t.num_rows], pa.int32()), pa.array([d.min()]), pa.array([d.max()]), ids, pa.array([b"".join(t["x"].to_pylist())], pa.binary())], names=["list", "n", "lo", "hi", "ids", "vectors"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            own = held["list"].to_numpy()
            ends = [*(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            at = 0
            for end in ends:
                while end - at >= block_rows or (end < len(own) and at < end):
                    size = min(block_rows, end - at)
                    yield block(held.slice(at, size))
                    at += size
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield block(held)

    placed = rows.mapInArrow(assign, f"id {kind}, list int, d double, x binary")
    parts = max(1, min(-(-n // (16 * block_rows)), 100_000))
    ordered = placed.repartitionByRange(parts, "list", "d", "id").sortWithinPartitions("list", "d", "id")
    blocks = ordered.mapInArrow(cut, f"list int, n int, lo double, hi double, ids array<{kind}>, vectors binary").withColumn("block", F.monotonically_increasing_id())
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    centres = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(sent.value)], "list int, centre array<double>")
    radius = spark.read.parquet(f"{path}/blocks").groupBy("list").agg(F.max("hi").alias("radius"))
    centres.join(radius, "list", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built at ``path``. The driver reads its centres alone."""
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["list"])
    return VectorIndex(spark.read.parquet(f"{path}/blocks"), np.array([r["centre"] for r in rows]), np.array([-1.0 if r["radius"] is None else r["radius"] for r in rows]))


def _first_lists(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """query_id, v, list: each query and its nearest list."""
    sent, kind = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius)), dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius = sent.value
        for batch in batches:
            q = units(batch.column(1))
            own = np.where(radius[None, :] < 0, np.inf, distances(q, centres)).argmin(1) if len(q) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(own.astype(np.int32))], names=["query_id", "v", "list"])

    return queries.filter(F.col("query").isNotNull()).select("query_id", "query").mapInArrow(run, f"query_id {kind}, v binary, list int")


def _other_lists(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """query_id, v, list, d, reach: other lists that may hold a vector within ``reach``. ``queries``: query_id, v, list (seen), reach."""
    sent, kind = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius)), dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                q = np.stack([np.frombuffer(v.as_py()) for v in part.column(1)])
                d, reach = distances(q, centres), part.column(3).to_numpy()
                near = (radius >= 0) & (d - radius <= reach[:, None])
                near[np.arange(len(q)), part.column(2).to_numpy()] = False
                row, own = np.nonzero(near)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(own.astype(np.int32)), pa.array(d[row, own]), part.column(3).take(take)], names=["query_id", "v", "list", "d", "reach"])

    return queries.select("query_id", "v", "list", "reach").mapInArrow(run, f"query_id {kind}, v binary, list int, d double, reach double")


def _best_in_blocks(index: VectorIndex, pairs: DataFrame, k: int, threshold: float | None, part_rows: int = 4096) -> DataFrame:
    """query_id, doc_id, score: each query's ``k`` best of every block it reads. ``pairs``: query_id, v, block; a block's queries are dealt into parts of some ``part_rows``."""
    pairs = stored(pairs, "pairs")
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    left = pairs.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    right = index.blocks.select("block", "ids", "vectors").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kind, id_type = dict(pairs.dtypes)["query_id"], index.id_type

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found_q, found_id, found_s = [], [], []
        if left.num_rows and right.num_rows:
            ids = right["ids"].combine_chunks().flatten()
            x = np.frombuffer(b"".join(right["vectors"].to_pylist())).reshape(len(ids), -1)
            keys = ids.to_pylist()
            for at in range(0, left.num_rows, 512):
                own = left.slice(at, 512)
                q = np.stack([np.frombuffer(v) for v in own["v"].to_pylist()])
                rough = q @ x.T
                least = np.partition(rough, -k, axis=1)[:, -k] - 1e-9 if len(ids) > k else np.full(len(q), -np.inf)
                for i, query in enumerate(own["query_id"].to_pylist()):
                    near = np.flatnonzero(rough[i] >= least[i])
                    exact = np.clip((x[near] * q[i]).sum(1), -1, 1)  # the same for equal vectors, wherever they lie
                    best = sorted((-s, keys[j]) for s, j in zip(exact.tolist(), near.tolist(), strict=True) if threshold is None or s >= threshold)[:k]
                    found_q += [query] * len(best)
                    found_id += [b for _, b in best]
                    found_s += [-s for s, _ in best]
        return pa.table([pa.array(found_q, left.schema.field("query_id").type), pa.array(found_id, right.schema.field("ids").type.value_type), pa.array(found_s, pa.float64())], names=["query_id", "doc_id", "score"])

    keys = ["block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id {kind}, doc_id {id_type}, score double")


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int = 10, threshold: float | None = None, read: list | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` best vectors of each query by cosine, as a full scan gives them. ``queries``: query_id, query.

    ``read``: a list that gets the two relations of (query_id, block) that were read, for reports and tests.
    """
    if (index.radius < 0).all():  # nothing was indexed
        kind = dict(queries.dtypes)["query_id"]
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, doc_id {index.id_type}, score double, rank int")
    first = stored(_first_lists(index, queries), "first")
    stats = index.blocks.select("list", "block", "lo", "hi")
    begun = first.join(stats, "list").select("query_id", "v", "block")
    found = stored(_top(_best_in_blocks(index, begun, k, threshold), k), "found")
    least = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    score = F.greatest(F.when(F.col("n") >= k, F.col("kth")).otherwise(-1.0), F.lit(-1.0 if threshold is None else threshold))
    reach = F.when(F.col("zero"), 3.0).otherwise(F.sqrt(F.greatest(2 - 2 * score, F.lit(0.0))) + SLACK)
    zero = F.hex("v").rlike("^0*$")
    open_ = first.join(least, "query_id", "left").withColumn("zero", zero).select("query_id", "v", "list", reach.alias("reach"))
    rest = stored(_other_lists(index, open_), "rest").join(stats, "list").filter((F.col("d") - F.col("hi") <= F.col("reach")) & (F.col("lo") - F.col("d") <= F.col("reach"))).select("query_id", "v", "block")
    if read is not None:
        read += [begun.select("query_id", "block"), rest.select("query_id", "block")]
    return _top(found.drop("rank").unionByName(_best_in_blocks(index, rest, k, threshold)), k)
