"""Quality rules: hard limits, then gradient-boosted trees over document statistics.

The trees are trained in numpy on a bounded sample of labelled documents, with monotone constraints on the features named in
doc_stats.MONOTONE, and flattened into node arrays; executors score whole Arrow batches with them.

Defined cases: a null or empty text has all counts 0 and fails the hard limits; very long texts are counted whole; equal texts have
equal verdicts; repeated rows stay repeated; extra columns are ignored, whatever their names. Without labels, or with labels of one class, the model is constant and documents
that pass the hard limits are kept unless every label is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidepool.llm import boosting
from tidepool.llm.doc_stats import COUNTS, FEATURES, MONOTONE, document_stats, labelled_features


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 20_000) -> boosting.Forest:
    """A forest from at most ``limit`` labelled documents."""
    x, y = labelled_features(docs, labels, label, limit)
    return boosting.train(x, y, [MONOTONE.get(f, 0) for f in FEATURES])


def quality_rules(docs: DataFrame, forest: boosting.Forest, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, threshold: float = 0.5) -> DataFrame:
    """Per document: id, COUNTS, base_failed, kept, p_quality. ``kept``: not base_failed and p_quality at least ``threshold``."""
    rows = document_stats(docs, id_col, text_col, score=lambda x: np.asarray(forest.probability(x), np.float64))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return rows.select(id_col, *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), F.col("score").alias("p_quality"))
