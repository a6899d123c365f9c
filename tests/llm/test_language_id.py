"""Language identification: n-grams, frequencies, learner and calibration against plain Python; held-out accuracy; odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidepool.llm import language_id as li
from tidepool.llm.common import table

M32 = (1 << 32) - 1


def bucket_by_definition(gram: str) -> int:
    c = [ord(x) for x in gram]
    mix = [int(x) for x in li._MIX]
    if len(c) == 1:
        h = (c[0] + mix[3]) & M32
    else:
        h = c[0] * mix[2] & M32
        for n in range(2, len(c) + 1):
            h = ((h ^ (h >> 16)) * mix[n % 4] + c[n - 1] * mix[2] + n) & M32
    h = (h ^ (h >> 15)) * mix[0] & M32
    return ((h ^ (h >> 13)) * mix[1] & M32) >> (32 - li.BITS)


def counts_by_definition(text: str | None) -> Counter:
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return Counter()
    s = " " + " ".join(words) + " "
    return Counter(bucket_by_definition(s[i : i + n]) for n in range(1, 5) for i in range(len(s) - n + 1) if s[i : i + n] != " ")


TEXTS = ["Abc, déf!", "x", "  ", "", "1 2 3", "日本語 テキスト", "a" * 50, "Straße und  Ärger\n\n42 Tage", "the quick brown fox " * 30, "-a-b-c-", "…é…"]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_ngrams_equal_their_definition_however_a_text_is_cut(piece):
    for text in TEXTS:
        got = Counter(int(b) for part in li.gram_buckets(text, piece) for b in part)
        assert got == counts_by_definition(text), (text, piece)


def test_counts_of_short_and_long_texts():
    for text in [None, *TEXTS, "lorem ipsum dolor sit amet " * 3000]:
        ids, n = li.gram_counts(text)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == dict(counts_by_definition(text))


def test_learner_equals_its_definition():
    """Per coordinate in plain loops: closed-form weights under both penalties, then the gradient of the softmax."""
    rng = np.random.default_rng(1)
    leader = li.Leader(3, rate=0.4, beta=1.0, l1=0.01, l2=0.05)
    z, n = {}, {}

    def w(i, k):
        l1, l2 = (0.0, 0.0) if i == li.BUCKETS else (0.01, 0.05)
        zi = z.get((i, k), 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((1.0 + math.sqrt(n.get((i, k), 0.0))) / 0.4 + l2)

    for _ in range(60):
        ids = np.sort(rng.choice(20, 6, replace=False))
        x, y = rng.random(6), int(rng.integers(3))
        leader.learn(ids, x, y)
        full = [*zip(ids.tolist(), x.tolist(), strict=True), (li.BUCKETS, 1.0)]
        weights = {(i, k): w(i, k) for i, _ in full for k in range(3)}
        e = [math.exp(sum(v * weights[i, k] for i, v in full)) for k in range(3)]
        for i, v in full:
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == y))
                old = n.get((i, k), 0.0)
                z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.4 * weights[i, k]
                n[i, k] = old + g * g
    got = leader.weights()
    assert np.allclose([got[i, k] for i, k in z], [w(i, k) for i, k in z])
    assert (got[20 : li.BUCKETS] == 0).all()


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(2)
    truth = rng.normal(size=(400, 4))
    labels = np.array([rng.choice(4, p=li.softmax(t)) for t in truth])
    t = li.temperature(truth * 7, labels)
    loss = lambda x: -np.log(1e-300 + li.softmax(truth * 7, x)[np.arange(400), labels]).mean()
    assert 5 < t < 10 and all(loss(t) <= loss(x) + 1e-9 for x in np.geomspace(0.01, 20, 300))
    assert li.temperature(np.empty((0, 4)), np.empty(0, int)) == 1.0


@pytest.fixture(scope="module")
def learned(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return docs, li.fit(docs, limit=600)


def test_held_out_accuracy_and_sparsity(learned):
    docs, model = learned
    rows = li.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 100
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    wrong = sum(1 - r.score for r in held)
    assert abs(wrong - sum(r.lang != r.lang_pred for r in held)) < 0.02 * len(held), "scores are probabilities"
    assert len(model.rows) < li.BUCKETS / 4 and (model.weights == 0).any()


def test_predictions_equal_plain_sums(learned):
    docs, model = learned
    weight = {int(b): model.weights[i] for i, b in enumerate(model.rows)}
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    for r in li.predict(docs, model).filter(f"doc_id in ({','.join(map(str, texts))})").collect():
        x = {b: (1 + math.log(n)) * model.idf[b] for b, n in counts_by_definition(texts[r.doc_id]).items()}
        if not x:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [sum(v * weight[b][k] for b, v in x.items() if b in weight) / norm + model.bias[k] for k in range(len(model.languages))]
        e = [math.exp((v - max(logits)) / model.temperature) for v in logits]
        assert r.lang_pred == model.languages[int(np.argmax(e))] and abs(r.score - max(e) / sum(e)) < 1e-9


def test_held_out_rows_and_other_columns_change_nothing(spark, learned):
    docs, model = learned
    held = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 'xx' else lang end lang", "'clash' score", "1 ids", "'s' _order")
    again = li.fit(held, limit=600)
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_odd_rows(spark, learned):
    _, model = learned
    odd = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "12 !?", "b"), (None, "the of and", "en"), (7, "the of and", "en"), (7, "the of and", "en"), (8, "die " * 300_000, None)], "doc_id long, text string, lang string")
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 6)) for r in li.predict(odd, model).collect())
    assert [g[2] for g in got] == ["und", "und", "und", "en", "en", "de", "en"] and [g[3] == 0 for g in got] == [True] * 3 + [False] * 4
    assert got[3] == got[4] and got[-1][1] is False and li.predict(odd.limit(0), model).count() == 0
    none = li.fit(odd.filter("lang is null"))
    assert none.languages == [] and {r.lang_pred for r in li.predict(odd, none).collect()} == {"und"}
    one = li.fit(odd.filter("doc_id = 7"))
    assert one.languages == ["en"] and {r.lang_pred for r in li.predict(odd, one).collect()} == {"und", "en"}


def test_frequencies_count_each_text_once(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "_text string").repartition(5)
    want = Counter(b for t in TEXTS for b in counts_by_definition(t))
    got = li.document_frequencies(texts)
    assert got[-1] == len(TEXTS) and {int(i): int(got[i]) for i in np.flatnonzero(got[:-1])} == dict(want)
