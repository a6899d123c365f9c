"""A stored keyword index: postings in blocks that know their best possible score, by committed buckets of terms.

Postings of a term are cut into blocks in order of how much they can add to a score, and a block keeps those of its postings that may be
its best: BM25 falls with 1 / frequency and with length / frequency, so a posting that another one beats in both never is. With the corpus
numbers of the day the best of them is the most any posting of the block can add. A search reads only the buckets its terms fall into. It first works out the blocks that promise most, which
bounds the k-th best score from below; a block whose best, together with the best of the request's other terms, stays under that bound
can't hold a result, and is not opened. Results are those of a full evaluation.

Documents can be replaced or removed at any time: the terms a document had are stored with it, so only their buckets change.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepool.operators import keyword_scan
from tidepool.operators.committed import CommittedTable
from tidepool.session import stored

#: Terms of requests, each counted for each request, that meet what is opened at once.
WANTED = 1_000_000
POSTING = "struct<doc_id:{0},tf:double,len:int>"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _front() -> Column:
    """Of the postings of a group, (tf, len) of those that no other beats in both 1 / tf and len / tf: from the most frequent on, each with a smaller len / tf than all before."""
    points = F.sort_array(F.collect_set(F.struct((-F.col("tf")).alias("minus"), F.col("len").alias("len"))))
    start = F.struct(F.lit(float("inf")).alias("least"), F.array().cast("array<struct<tf:double,len:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        y = p["len"] / -p["minus"]
        more = F.struct(y.alias("least"), F.array_append(acc["out"], F.struct((-p["minus"]).alias("tf"), p["len"].alias("len"))).alias("out"))
        return F.when(y < acc["least"], more).otherwise(acc)

    return F.aggregate(points, start, step)["out"]


@dataclass
class KeywordIndex:
    """``documents``: doc_id, len, terms, tags; ``blocks``: term, block, n, best, postings."""

    documents: CommittedTable
    blocks: CommittedTable
    title_weight: float
    block_rows: int

    @classmethod
    def at(cls, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = 64, title_weight: float = 0.5, block_rows: int = 256) -> KeywordIndex:
        """The index in a shared folder, empty if there is none. ``title_weight``: what an occurrence in the title counts; in the text it counts 1."""
        documents = CommittedTable(spark, f"{path}/documents", f"doc_id {id_type}, len int, terms array<string>, tags array<string>", ["doc_id"], buckets)
        blocks = CommittedTable(spark, f"{path}/blocks", f"term string, block bigint, n int, best array<struct<tf:double,len:int>>, postings array<{POSTING.format(id_type)}>", ["term", "block"], buckets, spread=["term"])
        return cls(documents, blocks, title_weight, block_rows)

    # --- writing

    def _counted(self, docs: DataFrame) -> DataFrame:
        """doc_id, len, terms, tfs, tags of new documents. ``docs``: doc_id, text, title, tags."""
        none = F.array().cast("array<string>")
        text = docs.select("doc_id", F.coalesce(terms(F.col("text")), none).alias("t"), F.coalesce(terms(F.col("title")), none).alias("title"))
        return keyword_scan.counted(text, self.title_weight)

    def _cut(self, postings: DataFrame) -> DataFrame:
        """Blocks of postings: a term's postings are dealt into shards of a bounded size first, so that a term of all documents is not one task."""
        counts = postings.groupBy("term").agg(F.ceil(F.count("*") / (64 * self.block_rows)).alias("shards"))
        dealt = postings.join(counts, "term").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.col("shards")))
        # What a posting adds, but for its term's weight, with the usual settings and the lengths of today; the order decides how much is skipped, never results.
        usual = postings.agg(F.avg("len")).first()[0] or 1.0
        order = Window.partitionBy("term", "shard").orderBy(F.desc(F.col("tf") / (F.col("tf") + 0.3 + 0.9 * F.col("len") / usual)), "doc_id")
        placed = dealt.withColumn("block", F.col("shard") * (1 << 20) + F.floor((F.row_number().over(order) - 1) / self.block_rows))
        return placed.groupBy("term", "block").agg(F.count("*").cast("int").alias("n"), _front().alias("best"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "len"))).alias("postings"))

    def _rewrite(self, new: DataFrame, gone: DataFrame, batch: tuple[str, int] | None) -> None:
        """Blocks of the terms of ``new`` postings and of ``gone`` (doc_id, terms) are cut anew."""
        changed = stored(new.select("term").union(gone.select(F.explode("terms"))).distinct(), "changed")
        if not self.blocks.manifest().buckets:  # the first documents: what was counted is all there is
            self.blocks.replace(self._cut(new.select("term", "doc_id", "len", "tf")), changed, ["term"], batch)
            return
        touched = self.blocks.touched(changed)
        old = self.blocks.read(touched).join(changed, "term", "left_semi").select("term", F.inline("postings"))
        rows = old.join(gone.select("doc_id"), "doc_id", "left_anti").select("term", "doc_id", "len", "tf").unionByName(new.select("term", "doc_id", "len", "tf"))
        self.blocks.replace(self._cut(stored(rows, "postings")), changed, ["term"], batch)

    def put(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Index ``docs`` (doc_id, text, title, tags; the last row of an id by its hash counts), in place of what their ids had.

        Postings are committed before documents, each under the batch's number: a replay after a crash between the two does the rest.
        """
        docs = docs.filter(F.col("doc_id").isNotNull())
        n = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
        if n["rows"] > n["ids"]:  # else texts needn't be shuffled to find one row of each id
            docs = docs.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.xxhash64("text", "title"))))).filter("_n = 1").drop("_n")
        new = stored(self._counted(docs), "counted")
        ids = new.select("doc_id")
        gone = stored(self.documents.read(self.documents.touched(ids)).join(ids, "doc_id", "left_semi").select("doc_id", "terms"), "gone")
        self._rewrite(new.select("doc_id", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), "doc_id", "len", F.col("x.tfs").alias("tf")), gone, batch)
        rows = new.select("doc_id", "len", F.sort_array("terms").alias("terms")).join(docs.select("doc_id", "tags"), "doc_id")
        self.documents.upsert(rows, batch)

    def remove(self, gone: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Take documents (doc_id) out."""
        had = stored(self.documents.read(self.documents.touched(gone)).join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "terms"), "gone")
        self._rewrite(had.limit(0).select(F.lit("").alias("term"), "doc_id", F.lit(0).alias("len"), F.lit(0.0).alias("tf")), had, batch)
        self.documents.delete(had.select("doc_id"), batch=batch)

    # --- searching

    def search(self, queries: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, boosts: dict[str, float] | None = None, tags: list[str] | None = None, read: list | None = None) -> DataFrame:
        """query_id, doc_id, score, rank: BM25 over the distinct terms of each request. ``boosts``: terms that count more; ``tags``: documents must have them all.

        ``read``: a list that gets the relation of (query_id, term, block) opened beyond the first, for reports and tests.
        """
        asked = stored(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")), "asked")
        blocks = self.blocks.read(self.blocks.touched(asked))
        docs = self.documents.read()
        corpus = docs.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len")).first()
        n_docs, mean_len = corpus["n_docs"], corpus["mean_len"] or 1.0
        idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        boost = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair)), F.col("term")), F.lit(1.0)) if boosts else F.lit(1.0)
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        wanted = asked.join(df, "term").select("query_id", "term", (idf * boost).alias("weight"))
        gain = lambda tf, size: F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / F.lit(float(mean_len))))
        bounds = stored(blocks.select("term", "block", "n", "best").join(wanted, "term").withColumn("most", F.array_max(F.transform("best", lambda p: gain(p["tf"], p["len"])))).drop("best"), "bounds")
        if tags:
            has = F.forall(F.array(*map(F.lit, tags)), lambda t: F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), t))
            allowed = docs.filter(has).select("doc_id")

        def opened(own: DataFrame) -> DataFrame:
            """Sums over the postings of the blocks in ``own`` (query_id, term, block, weight)."""
            rows = blocks.select("term", "block", "postings").join(own.select("query_id", "term", "block", "weight"), ["term", "block"]).select("query_id", "weight", F.inline("postings"))
            if tags:
                rows = rows.join(allowed, "doc_id", "left_semi")
            return rows.groupBy("query_id", "doc_id").agg(F.sum(gain(F.col("tf"), F.col("len"))).alias("score"))

        # Blocks in order of their promise, until they hold k documents several times over.
        by_promise = Window.partitionBy("query_id").orderBy(F.desc("most"), "term", "block").rowsBetween(Window.unboundedPreceding, -1)
        first = bounds.withColumn("before", F.coalesce(F.sum("n").over(by_promise), F.lit(0))).filter(F.col("before") < 4 * k)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        kth = opened(first).withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
        best = bounds.groupBy("query_id", "term").agg(F.max("most").alias("best"))
        total = best.withColumn("all", F.sum("best").over(Window.partitionBy("query_id")))
        # Sums in another order may differ in the last digits: bounds are a little generous.
        left = bounds.join(total, ["query_id", "term"]).join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("all") - F.col("best") + F.col("most") >= F.col("kth") * (1 - 1e-9)))
        if read is not None:
            read.append(left.select("query_id", "term", "block"))
        texts_wanted = wanted.select("query_id", "term").limit(WANTED + 1).toArrow()
        if texts_wanted.num_rows > WANTED:
            return opened(left).withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        # What is opened for any request meets all of them as matrices: a text that is not among a request's best gets part of its score at most, and stays under the bound.
        own = keyword_scan.Asked(texts_wanted)
        numbers = {t: i for i, t in enumerate(own.words.to_pylist())}
        weights = np.zeros(max(len(numbers), 1))
        for r in wanted.select("term", "weight").distinct().toLocalIterator():
            weights[numbers[r["term"]]] = r["weight"]
        named = self.documents.spark.createDataFrame(list(numbers.items()), "term string, no int")
        rows = blocks.select("term", "block", "postings").join(left.select("term", "block").distinct(), ["term", "block"], "left_semi").join(named, "term").select("no", F.inline("postings"))
        if tags:
            rows = rows.join(allowed, "doc_id", "left_semi")
        one = rows.groupBy("doc_id").agg(F.first("len").alias("doc_len"), F.sort_array(F.collect_list(F.struct("no", "tf"))).alias("x"))
        texts = one.select("doc_id", "doc_len", F.col("x.no").alias("terms"), F.col("x.tf").alias("tfs"))
        found = keyword_scan.best_texts(texts, own, weights, float(mean_len), dict(queries.dtypes)["query_id"], k, k1, b, 9)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
