"""Document statistics against brute force, boosting's constraints, quality operators on labelled data and odd rows."""

import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidepool.llm import boosting, quality_bayes, quality_rules
from tidepool.llm.common import HASHES
from tidepool.llm.doc_stats import stats_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    spans = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, s in enumerate(spans) if spans.count(s) > 1 for j in range(3)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\r#$é|  ", max_size=60))
def test_counts(text):
    assert stats_of(text, HASHES)[0] == brute(text)


def test_counts_of_null():
    assert stats_of(None, HASHES)[0] == [0] * 5


def test_monotone_constraints_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(0, 0.5, 800)) > 0).astype(float)
    forest = boosting.train(x, y, [1, -1, 0], trees=30)
    grid = np.linspace(-3, 3, 80)
    for row in x[:40]:
        for feature, sign in ((0, 1), (1, -1)):
            z = np.repeat(row[None, :], len(grid), 0)
            z[:, feature] = grid
            assert (np.diff(forest.margin(z)) * sign >= -1e-12).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.8


def test_forest_without_rows_or_with_one_class():
    assert boosting.train(np.empty((0, 2)), np.empty(0), [0, 0]).probability(np.zeros((3, 2))).tolist() == [0.5] * 3
    assert (boosting.train(np.zeros((4, 2)), np.ones(4), [0, 0]).probability(np.zeros((2, 2))) > 0.5).all()


def odd(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b c " * 5000, "x"), (4, "good words here", None), (4, "good words here", None), (None, "no id", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_text": F.lit(1), "score": F.lit("clash"), "lang": F.lit("en"), "host": F.lit(0), "features": F.lit(2)})


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_rules_on_odd_rows(spark):
    forest = quality_rules.fit(odd(spark), no_labels(spark))
    rows = quality_rules.quality_rules(odd(spark), forest).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == 0 and by[1].base_failed and by[3].n_repeat_words == 15000 and by[3].base_failed
    assert quality_rules.quality_rules(odd(spark).limit(0), forest).count() == 0


def test_bayes_on_odd_rows(spark):
    docs = odd(spark)
    model = quality_bayes.fit(docs, no_labels(spark))
    rows = quality_bayes.quality_bayes(docs, no_labels(spark), model, F.col("source"), F.col("lang"))
    got = rows.collect()
    assert len(got) == 6 and all(r.posterior == 0.5 and r.kept for r in got)
    assert quality_bayes.keep_quality(docs, rows).count() == 6
    assert quality_bayes.quality_bayes(docs.limit(0), no_labels(spark), model, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink_to_their_parents(spark):
    """Brute force of the two-level shrinkage, and its direction."""
    rng = np.random.default_rng(1)
    sites = [("good", "p", 60, 0.95), ("bad", "p", 60, 0.1), ("bad", "q", 2, 0.1), ("new", "p", 1, 0.5)]
    rows, labels = [], []
    for host, path, n, rate in sites:
        for _ in range(n):
            good = rng.random() < rate
            rows.append((len(rows), ("plain words in a row and more " * 10) if good else "### $$$ %%% " * 30, host, path))
            labels.append((len(rows) - 1, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_bayes.fit(docs, known)
    got = {r.doc_id: r for r in quality_bayes.quality_bayes(docs, known.limit(0), model, F.col("host"), F.col("path")).collect()}
    rate = {}
    for (i, _, host, path), _ in zip(rows, labels, strict=True):
        rate.setdefault((host, path), []).append(got[i].site_rate)
    mean = {k: np.mean(v) for k, v in rate.items()}
    assert mean["good", "p"] > 0.8 > mean["new", "p"] > mean["bad", "p"] and mean["bad", "q"] < 0.6
    assert np.mean([got[i].kept == bool(y) for i, y in labels]) > 0.95


@pytest.mark.parametrize("name", ["rules", "bayes"])
def test_accuracy_where_labels_are_held_out(spark, sf, name):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.filter("doc_id % 3 != 0"), labels.filter("doc_id % 3 = 0")
    if name == "rules":
        out = quality_rules.quality_rules(docs, quality_rules.fit(docs, train)).filter("not base_failed")
    else:
        out = quality_bayes.quality_bayes(docs, train, quality_bayes.fit(docs, train), F.col("source"), F.col("lang"))
    got = out.join(held, "doc_id").select((F.col("kept") == (F.col("quality") == 1)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.95
