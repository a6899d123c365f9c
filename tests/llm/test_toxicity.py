"""Toxicity: misspellings, joint training, held-out accuracy, and the distributed scores against plain averages."""

import zlib

import numpy as np
import pytest

from tidepool.llm import toxicity


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeioutrnsl"), 5)) for _ in range(300)]

    def texts(n):
        out, y = [], []
        for i in range(n):
            words = list(rng.choice(plain, 80))
            if i % 3 == 0:
                for bad in ("wretched", "wretchedly"):
                    words[rng.integers(80)] = bad
            out.append(" ".join(words))
            y.append(float(i % 3 == 0))
        return out, np.array(y)

    train, held = texts(900), texts(90)
    return rng, plain, train, held, toxicity.train(*train)


def _p(model, text):
    folded = model.folded()
    return float(folded.probability(np.array([toxicity.WordScores(folded).logit(text)]))[0])


def _average(model, text):
    """The same without folding: vectors of n-grams, words and windows, then the softmax."""
    row = {int(b): i for i, b in enumerate(model.buckets)}
    best = -np.inf
    words = toxicity.words_of(text)
    for a, b in toxicity.windows_of(len(words)):
        total = np.zeros(model.vectors.shape[1])
        for w in words[a:b]:
            own = [model.vectors[row[int(g)]] for g in toxicity.grams_of(w) if int(g) in row]
            if own:
                total += model.frequent.get(w, 1.0) * np.mean(own, 0)
        z = model.softmax @ (total / max(b - a, toxicity.FLOOR)) + model.bias
        best = max(best, z[1] - z[0])
    return 1 / (1 + np.exp(-(model.scale * best + model.shift)))


def test_unseen_misspellings_share_ngrams(small):
    rng, plain, _, _, model = small
    clean = " ".join(rng.choice(plain, 80))
    assert _p(model, clean) < 0.3 < _p(model, clean + " wretched wretchedly")
    assert _p(model, clean + " wretchd wretchedd wrretched") > 0.3
    long = " ".join(rng.choice(plain, 4000))
    assert _p(model, long + " wretched" * 12 + " " + long) > 0.3, "a long text doesn't dilute its windows"


def test_vectors_and_softmax_are_learned_together(small):
    _, _, train, (texts, y), model = small
    start = toxicity.train(*train, epochs=0)
    loss = lambda m: -np.mean([np.log(_p(m, t) if v else 1 - _p(m, t)) for t, v in zip(texts, y, strict=True)])
    assert loss(model) < 0.5 * loss(start)
    sizes = np.linalg.svd(model.vectors, compute_uv=False)
    assert len(sizes) == 4 and sizes[1] > 1e-3 * sizes[0]
    assert not np.allclose(model.softmax, start.softmax) and not np.allclose(model.vectors, start.vectors)


def test_scores_equal_plain_averages(spark, small):
    rng, plain, (texts, _), _, model = small
    texts = [*texts[:20], "", None, " ".join(rng.choice(plain, 1500)) + " wretched" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(abs(got[i] - _average(model, t)) < 1e-4 for i, t in enumerate(texts))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    wrong = [r.predicted for r in rows if r.toxic == 0]
    assert len(caught) > 100 and np.mean(caught) > 0.75 and np.mean(wrong) < 0.03


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50000), (3, "x " * 50000), (None, "a")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as _id", "3 as held_out")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_empty_training_texts_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(12)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, "toxic", 10, 10, "doc_id", "text")
    assert len(texts) == len(y) == len([i for i in range(12) if zlib.crc32(str(i).encode()) % 4 != 2])
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect())


def test_held_out_labels_never_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a.vectors, b.vectors) and (a.scale, a.shift) == (b.scale, b.shift)


def test_another_model_is_not_scored_with_old_words(spark, small):
    _, _, (texts, y), _, model = small
    docs = spark.createDataFrame(list(enumerate(texts[:8])), "doc_id long, text string").coalesce(1)
    toxicity.score_toxicity(docs, model).collect()
    other = toxicity.train(texts, 1 - y)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, other).collect()}
    assert all(abs(got[i] - _average(other, t)) < 1e-4 for i, t in enumerate(texts[:8]))
