"""Quality classifier: a document's own evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic regression over document statistics (numpy, on a bounded labelled sample) gives each document a probability. The
probabilities of all documents, and the labels where they are known, are summed by host and by path in grouped aggregations. Sites
shrink toward their parent (path to host, host to the global rate) by a strength that the method of moments estimates from the spread
between sites, so sparse sites say little. A document's posterior odds are its own odds times the odds ratio of its path to the
global rate, with the document's own contribution taken out of path, host and global rates alike.

Defined cases: a null or empty text is scored by its (zero) statistics; null hosts and paths are read as the empty string; repeated rows
count as often as they occur and share one verdict by id; rows with a null id are scored, and filters keep them; without usable labels
every posterior is 0.5, which is kept. Very long texts are read whole; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidepool.llm.common import hot_keys, materialize, salted_join, without
from tidepool.llm.doc_stats import document_stats, labelled_features


@dataclass
class Logistic:
    """A ridge logistic regression on clipped, standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.ones((len(z), 1)), z, z * z - 1], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(x))
        return np.clip(self.expand(x) @ self.weights, -8, 8)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 20_000, ridge: float = 1.0) -> Logistic:
    """Newton's method on at most ``limit`` labelled documents; no weights if only one class is there."""
    x, y = labelled_features(docs, labels, label, limit)
    if len(set(y.tolist())) < 2:
        return Logistic(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.empty(0))
    model = Logistic(x.mean(0), np.maximum(x.std(0), 1e-6), np.empty(0))
    z = model.expand(x)
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def _strength(groups: DataFrame, parent: Column) -> float:
    """Pseudo-count of a beta prior around ``parent``, from the spread of group rates (n, s) around it: the method of moments."""
    p = F.col("s") / F.col("n")
    got = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (p - parent) ** 2).alias("spread"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.avg(parent * (1 - parent)).alias("m")).first()
    if not got["n"] or got["k"] < 2 or not got["m"]:
        return 100.0
    between = (got["spread"] - (got["k"] - 1) * got["m"]) / max(got["n"] - got["sq"] / got["n"], 1e-9)
    return float(np.clip(got["m"] / max(between, 1e-12) - 1, 1.0, 1e6))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(q / (1 - q))


def quality_bayes(docs: DataFrame, labels: DataFrame, model: Logistic, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """Per document: id, host, path, p_doc, site_rate (of its path, without itself), posterior, kept.

    Only narrow rows (id, site, one number) are shuffled. Site tables are joined by host and path after pre-aggregation, a
    hot site's documents over many tasks; the number of sites may grow with the data, so they are neither collected nor forcibly broadcast. The driver gets two scalars.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("_text"))
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("double").alias("_y"))
    scored = document_stats(base, "_id", "_text", keep=("host", "path"), score=model.logit).select("_id", "host", "path", F.col("score").alias("logit"))
    p_doc = 1 / (1 + F.exp(-F.col("logit")))
    rows = materialize(scored.join(known, "_id", "left").select("_id", "host", "path", p_doc.alias("p_doc"), F.coalesce("_y", p_doc).alias("e")), "quality")

    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = float(whole["s"] / whole["n"]) if whole["n"] else 0.5
    k_host = _strength(hosts, F.lit(rate))
    host_rates = hosts.select("host", ((F.col("s") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    sites = paths.join(host_rates.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host"), "host")
    k_path = _strength(sites, F.col("host_rate"))

    own = salted_join(rows, sites, ["host", "path"], F.col("_id"), hot=hot_keys(paths, ["host", "path"]))
    # A document's own evidence is no evidence of its site: it is taken out of every level.
    others = F.when(F.lit(whole["n"] or 0) > 1, (F.lit(float(whole["s"] or 0)) - F.col("e")) / F.lit(max((whole["n"] or 0) - 1, 1))).otherwise(0.5)
    own = own.withColumn("others", others)
    near = (F.col("host_s") - F.col("e") + k_host * F.col("others")) / (F.col("host_n") - 1 + k_host)
    site = (F.col("s") - F.col("e") + k_path * near) / (F.col("n") - 1 + k_path)
    own = own.select("_id", "host", "path", "p_doc", site.alias("site_rate"), "others")
    odds = _logit(F.col("p_doc")) + _logit(F.col("site_rate")) - _logit(F.col("others"))
    posterior = (1 / (1 + F.exp(-odds))) if len(model.weights) else F.lit(0.5)
    out = own.withColumn("posterior", posterior)
    return out.select(F.col("_id").alias(id_col), "host", "path", "p_doc", "site_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def keep_quality(docs: DataFrame, scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that ``scored`` rejects, all columns kept; rows with a null id stay."""
    return without(docs, scored.filter(~F.col("kept")).select(id_col), [id_col])
