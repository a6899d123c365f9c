"""From raw documents to packed training sequences, in five stages that each keep what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

What a stage has written on its way is removed when the next one begins, unless that one's ``docs`` still read it; so disk holds one
stage's tables at a time, and what a stage returns is meant to be written before the next.

Defined cases: rows with a null id pass all filters, uncut, and are packed; null and empty texts are no copies of each other or of
anything, and are packed as one end mark if the quality classifier keeps them; repeated rows share one verdict and one cut, and stay
repeated; very long texts are read whole; extra columns pass through; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepool.llm import decontamination, jaccard_join, packing, quality_bayes, substring_dedup
from tidepool.llm.common import keep_stage_tables, materialize, stage_tables, table
from tidepool.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    with stage_tables(docs):
        labels = table(ship(spark), sf_dir, "labels")
        scored = quality_bayes.quality_bayes(docs, labels, quality_bayes.fit(docs, labels), F.col("source"), F.col("lang"))
        return quality_bayes.keep_quality(docs, scored)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    ship(spark)
    with stage_tables(docs):
        return jaccard_join.keep_first(docs, jaccard_join.jaccard_components(docs, k=5, percent=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of later ones."""
    ship(spark)
    with stage_tables(docs):
        return substring_dedup.remove_repeats(docs, length_col="n_chars")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which benchmark items leak go."""
    ship(spark)
    with stage_tables(docs):
        return decontamination.drop_leaks(docs, decontamination.leaks(docs, table(spark, sf_dir, "benchmark")))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 1024 tokens."""
    ship(spark)
    with stage_tables(docs):
        return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packed_sequences", packed_sequences),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    out = STAGES[-1][1](spark, docs, sf_dir)
    keep_stage_tables()
    return out
