"""Tables that upserts and deletes commit to: Parquet files by key bucket, and a manifest that readers follow.

A commit reads and rewrites only the buckets that its keys fall into. Their new files are staged in a folder of the commit; then a new
manifest, which names for each bucket the commit that holds it, is created under the next number, and that creation fails if another
writer got there first. Readers follow the newest manifest, so they see a commit as a whole or not at all, and a job that dies leaves
files that nobody reads. A batch may carry the name of its source and a growing number: a batch that was committed before changes
nothing, so a replay is safe.

The driver handles the manifest (a line for each bucket) and bucket numbers; rows stay with the executors.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since this one read; nothing was changed."""


@dataclass
class Manifest:
    version: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class CommittedTable:
    """A table in a folder that all executors and the driver share. ``keys`` tell its rows apart; ``spread``: the columns that decide the bucket (a prefix of the keys, all of them by default)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64, spread: list[str] | None = None):
        self.spark, self.path, self.keys, self.buckets, self.spread = spark, path.rstrip("/"), keys, buckets, spread or keys
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    # --- manifests

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one if nothing was committed."""
        fs, where = self._fs(f"{self.path}/manifests")
        if not fs.exists(where):
            return Manifest()
        found = {int(s.getPath().getName()): s.getPath() for s in fs.listStatus(where) if s.getPath().getName().isdigit()}
        at = max(found, default=0) if version is None else version
        if at == 0:
            return Manifest()
        source = fs.open(found[at])
        try:
            text = bytes(source.readAllBytes()).decode()
        finally:
            source.close()
        return Manifest(at, **json.loads(text))

    def _commit(self, base: Manifest, changed: dict[str, str], batch: tuple[str, int] | None) -> int:
        new = Manifest(base.version + 1, base.buckets | changed, base.applied | (dict([batch]) if batch else {}))
        fs, where = self._fs(f"{self.path}/manifests/{new.version:012d}")
        _, draft = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"buckets": new.buckets, "applied": new.applied}).encode()))
        out.close()
        fs.mkdirs(where.getParent())
        try:
            taken = fs.exists(where) or not fs.rename(draft, where)
        except Py4JJavaError as e:
            raise Conflict(f"version {new.version}") from e
        if taken:
            raise Conflict(f"version {new.version} was committed by another writer")
        return new.version

    def _done(self, base: Manifest, batch: tuple[str, int] | None) -> bool:
        return batch is not None and base.applied.get(batch[0], -1) >= batch[1]

    # --- reading

    def bucket(self, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(*(columns or map(F.col, self.spread))), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of some buckets alone if they are named."""
        return self._read(self.manifest(version), buckets)

    def _read(self, base: Manifest, buckets: list[int] | None) -> DataFrame:
        paths = [f"{self.path}/data/{commit}/_bucket={b}" for b, commit in sorted(base.buckets.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` (with the columns of ``spread``) fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # --- writing

    def _write(self, base: Manifest, rows: DataFrame, touched: list[int], batch: tuple[str, int] | None, files: int) -> int:
        commit = uuid.uuid4().hex
        dealt = rows.select(*self.schema.names, self.bucket().alias("_bucket"))
        # The files of a bucket, a few each, so that a bucket isn't one task.
        dealt = dealt.repartition(min(files * max(len(touched), 1), 4096), "_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(files)))
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/data/{commit}")
        fs, _ = self._fs(self.path)
        there = lambda b: fs.exists(self._fs(f"{self.path}/data/{commit}/_bucket={b}")[1])
        kept = {b: c for b, c in base.buckets.items() if int(b) not in touched}
        return self._commit(Manifest(base.version, kept, base.applied), {str(b): commit for b in touched if there(b)}, batch)

    def _latest(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        """One row of each key: the first in ``order``, then in the order of all columns, so that replays agree."""
        w = Window.partitionBy(*self.keys).orderBy(*order, *(F.desc(F.xxhash64(c)) for c in self.schema.names if c not in self.keys), F.lit(0))
        return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None, newest: list[Column] | None = None, replace: bool = True, keep: list[str] | None = None, files: int = 1, across: bool = False) -> int:
        """Put ``rows`` in place of those with their keys and return the version. Of rows with one key the first by ``newest`` counts;
        with ``across`` that also decides between them and what is there, so that the order of the batches doesn't matter.

        ``replace=False``: rows whose key is there already are left out (insert). ``keep``: columns that stay as they were where a key was
        there (created_at). ``batch``: a source's name and the number of the batch.
        """
        base = self.manifest()
        if self._done(base, batch):
            return base.version
        new = self._latest(rows.select(*self.schema.names), newest or [])
        touched = self.touched(rows)
        old = self._read(base, touched)
        if across:
            merged = self._latest(old.unionByName(new), newest or [])
        elif replace:
            if keep:
                before = old.select(*self.keys, *(F.col(c).alias(f"_{c}") for c in keep), F.lit(True).alias("_there"))
                new = new.join(before, self.keys, "left").select(*(F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in self.schema.names))
            merged = old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)
        else:
            merged = old.unionByName(new.join(old.select(*self.keys), self.keys, "left_anti"))
        return self._write(base, merged, touched, batch, files)

    def replace(self, rows: DataFrame, gone: DataFrame, by: list[str], batch: tuple[str, int] | None = None, files: int = 1) -> int:
        """Put ``rows`` in place of all rows whose ``by`` (columns of the bucket, among others) are in ``gone``, and return the version."""
        base = self.manifest()
        if self._done(base, batch):
            return base.version
        touched = self.touched(gone)
        return self._write(base, self._read(base, touched).join(gone.select(*by).distinct(), by, "left_anti").unionByName(rows.select(*self.schema.names)), touched, batch, files)

    def add(self, rows: DataFrame, sums: dict[str, Column], batch: tuple[str, int], files: int = 1) -> int:
        """Combine ``rows`` with those of their keys by the aggregates in ``sums`` (column -> aggregate over the rows of a key) and return the version. A batch adds once."""
        base = self.manifest()
        if self._done(base, batch):
            return base.version
        touched = self.touched(rows)
        both = self._read(base, touched).unionByName(rows.select(*self.schema.names))
        return self._write(base, both.groupBy(*self.keys).agg(*(c.alias(n) for n, c in sums.items())), touched, batch, files)

    def delete(self, gone: DataFrame, by: list[str] | None = None, batch: tuple[str, int] | None = None, files: int = 1) -> int:
        """Remove rows whose ``by`` (the keys by default) are in ``gone`` and return the version. By other columns than those of the bucket, all buckets that hold such rows are rewritten."""
        base = self.manifest()
        if self._done(base, batch):
            return base.version
        by = by or self.keys
        rows = gone.select(*by).distinct()
        touched = self.touched(rows) if set(self.spread) <= set(by) else self.touched(self._read(base, None).join(rows, by, "left_semi"))
        return self._write(base, self._read(base, touched).join(rows, by, "left_anti"), touched, batch, files)

    def clear(self, batch: tuple[str, int] | None = None) -> int:
        """Remove all rows; earlier versions can still be read."""
        base = self.manifest()
        return base.version if self._done(base, batch) else self._commit(Manifest(base.version, {}, base.applied), {}, batch)


def delete_document(tables: dict[str, CommittedTable], gone: DataFrame, batch: tuple[str, int] | None = None, key: str = "document_id") -> dict[str, int]:
    """Delete from each table what belongs to the documents in ``gone``: children first, so that a reader between two commits sees no child without its parent."""
    return {name: t.delete(gone, [key], batch) for name, t in tables.items()}
