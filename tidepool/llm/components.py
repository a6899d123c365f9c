"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepool.llm.common import hot_keys, materialize, salted_join


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it reaches.

    Each round takes the smallest label among neighbours and then the label's own label, so that long chains halve. A round's table
    is written to shared storage; the driver learns only whether anything changed. Hubs and labels that many nodes have are dealt over
    many tasks.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    both = both.withColumnRenamed("b", "node")
    hubs = materialize(hot_keys(both.groupBy("node").agg(F.count("*").alias("n")), ["node"]), "hubs")
    while True:
        near = salted_join(both, labels, ["node"], F.col("a"), hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        many = hot_keys(labels.groupBy("label").agg(F.count("*").alias("n")), ["label"])  # those of the round before: any choice gives the same result
        step = materialize(salted_join(step, jump, ["label"], F.col("node"), "left", hot=many).select("node", "old", F.coalesce("further", "label").alias("label")), "labels")
        changed = step.filter("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
