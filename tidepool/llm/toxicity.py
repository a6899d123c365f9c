"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (and of itself), weighted down if the word is frequent (smooth
inverse frequency); a window's vector is the average of its words; a softmax with one row per class reads it. Vectors start at random
and are learned together with the softmax by gradient descent on the windows of a bounded number of labelled documents, each window
with its document's label and an equal share of its document's weight. N-grams that few training documents have are not learned, since
they would only memorise. A part of the sample, not trained on, fits the scale of the final score. For scoring, the two rows of the
softmax are folded into the vectors, which is the same linear function: one number per n-gram bucket is broadcast (a fixed size), with
the weights of frequent words (at most 1 / LEAST_SHARE, as their shares of the sample sum to 1). A document's score is that of its most
toxic window. Misspellings that were never seen share n-grams with words that were.

Defined cases: null and empty texts are scored as one empty window (the bias alone); very long texts are read whole, in training and in
scoring; equal texts have equal scores; repeated rows stay repeated, and count once in the sample; a null id is not held out; extra
columns are ignored. Without labels of both classes every score is the share of label 1 (0 without labels). An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 18
WINDOW = 512
#: A window of fewer words is averaged as if it had so many.
FLOOR = 24
#: Words of at least this share of the sample are weighted down.
LEAST_SHARE = 1e-5
_MARKS = b".,;:!?\"'()[]{}|<>/\\~`=+#%&$*_-"
_BLANK = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of the whole text, without punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_BLANK).split()


def grams_of(word: bytes, low: int = 3, high: int = 5) -> np.ndarray:
    """Bucket numbers of a word's n-grams, with marks for its ends, and of the word itself."""
    w = f"<{word.decode('utf-8', 'replace')}>"
    grams = {w, *(w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1))}
    return np.array(sorted(xxhash.xxh32_intdigest(g) & (BUCKETS - 1) for g in grams), np.int64)


def windows_of(n: int) -> list[tuple[int, int]]:
    """Windows of words that overlap by half and cover n words."""
    half = WINDOW // 2
    return [(a, min(a + WINDOW, n)) for a in range(0, max(n - half, 1), half)]


@dataclass
class Toxicity:
    """``vectors``: a row for each of ``buckets`` (learned n-grams); ``softmax``: a row and a ``bias`` per class. The score is sigmoid(scale * logit + shift)."""

    buckets: np.ndarray
    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    frequent: dict[bytes, float]
    scale: float = 1.0
    shift: float = 0.0

    def folded(self) -> Folded:
        """What the softmax makes of each vector: its preference for label 1."""
        weights = np.zeros(BUCKETS, np.float32)
        weights[self.buckets] = self.vectors @ (self.softmax[1] - self.softmax[0])
        learned = np.zeros(BUCKETS, bool)
        learned[self.buckets] = True
        bias = float(self.bias[1] - self.bias[0])
        key = xxhash.xxh64_hexdigest(weights.tobytes() + learned.tobytes() + np.array([bias, self.scale, self.shift]).tobytes() + repr(sorted(self.frequent.items())).encode())
        return Folded(weights, learned, bias, self.frequent, self.scale, self.shift, key)


@dataclass
class Folded:
    weights: np.ndarray
    learned: np.ndarray
    bias: float
    frequent: dict[bytes, float]
    scale: float
    shift: float
    key: str

    def word(self, word: bytes) -> float:
        """A word's part of the logit."""
        grams = grams_of(word)
        grams = grams[self.learned[grams]]
        return float(self.weights[grams].mean()) * self.frequent.get(word, 1.0) if len(grams) else 0.0

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -500, 500)))


class WordScores(dict):
    """word -> its part of the logit; emptied when it reaches ``limit`` words."""

    limit = 600_000

    def __init__(self, model: Folded):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.model.word(word)
        return value

    def logit(self, text: str | None) -> float:
        """The logit of the text's most toxic window."""
        words = words_of(text)
        total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.__getitem__, words), np.float64, len(words)))])
        return self.model.bias + float(max((total[b] - total[a]) / max(b - a, FLOOR) for a, b in windows_of(len(words))))


_CACHES: dict[str, WordScores] = {}


def _cache(model: Folded) -> WordScores:
    """The scores of words under this model, kept between the tasks of a Python worker; those of an earlier model are dropped."""
    if model.key not in _CACHES:
        _CACHES.clear()
        _CACHES[model.key] = WordScores(model)
    return _CACHES[model.key]


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, positives: int, negatives: int, id_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """Texts of at most so many documents of either label, never held out, picked by the hash of their id; an id with several texts gives its least."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    pick = lambda y, most: usable.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
    picked = pick(1, positives).unionByName(pick(0, negatives))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).toArrow()
    got = sorted(zip(rows["_id"].to_pylist(), rows["_text"].to_pylist(), rows["_y"].to_pylist(), strict=True))
    return [x[1] for x in got], np.array([x[2] for x in got], np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = 1500, negatives: int = 3000, id_col: str = "doc_id", text_col: str = "text", **options) -> Toxicity:
    """Train on at most ``positives`` + ``negatives`` labelled documents, whole."""
    texts, y = sample(docs, labels, label, positives, negatives, id_col, text_col)
    return train(texts, y, **options)


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(sorted_keys)) + 1])


def train(texts: list[str], y: np.ndarray, dim: int = 4, epochs: int = 48, rate: float = 2.0, least: int = 5, rare: float = 1e-3, seed: int = 7) -> Toxicity:
    """Gradient descent with momentum on all windows at once.

    Every fifth document is kept back: it fits the score's scale and tells which epoch was best. ``rate``: the step of the n-gram that
    counts most (others move in proportion); ``least``: documents that must have an n-gram; ``rare``: the share of the sample at which
    a word's weight is a half.
    """
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return Toxicity(np.empty(0, np.int64), np.empty((0, dim), np.float32), np.zeros((2, dim)), np.log(np.array([1 - p, p])), {})
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    kept_back = np.arange(len(ids)) % 5 == 4
    fit_on = [(x, v) for x, v, k in zip(ids, y, kept_back, strict=True) if not k and len(x)]
    in_docs = np.bincount(np.concatenate([np.unique(x) for x, _ in fit_on]), minlength=len(vocabulary)) if fit_on else np.zeros(len(vocabulary), np.int64)
    grams = [grams_of(w) for w in vocabulary] or [np.empty(0, np.int64)]

    # The learned n-grams: a row each, sorted by word and by n-gram, as both directions of the mean need them.
    flat, word_of = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    n_docs = np.bincount(flat, in_docs[word_of] if len(vocabulary) else None, BUCKETS)
    there = n_docs[flat] >= least
    buckets, flat = np.unique(flat[there], return_inverse=True)
    word_of = word_of[there]
    bias = np.log(np.array([1 - y.mean(), y.mean()]))
    vectors, softmax = rng.normal(0, 0.1, (len(buckets), dim)).astype(np.float32), rng.normal(0, 1 / np.sqrt(dim), (2, dim))
    if not len(buckets):
        return Toxicity(buckets, vectors, softmax, bias, {})
    n_grams = np.bincount(word_of, minlength=len(grams))
    words_with = np.unique(word_of)
    by_word, by_gram = _starts(word_of), np.argsort(flat, kind="stable")
    gram_starts, word_by_gram = _starts(flat[by_gram]), word_of[by_gram]

    # Windows as rows (window, word, how often by its length).
    spans = [(x[a:b], v, 1 / len(all_)) for x, v in fit_on for all_ in (windows_of(len(x)),) for a, b in all_]
    size = np.array([len(x) for x, _, _ in spans])
    words = np.concatenate([x for x, _, _ in spans])
    share = np.bincount(words, minlength=len(grams)) / len(words)
    weight = (rare / (rare + share)).astype(np.float32)
    per_word = (weight / np.maximum(n_grams, 1)).astype(np.float32)[:, None]
    cells, times = np.unique(np.repeat(np.arange(len(spans)), size) * len(grams) + words, return_counts=True)
    window, word = cells // len(grams), cells % len(grams)
    part = (times / np.maximum(size, FLOOR)[window]).astype(np.float32)[:, None]
    by_window, by_used = _starts(window), np.argsort(word, kind="stable")
    used_starts = _starts(word[by_used])
    used = word[by_used][used_starts]
    target = np.array([[1 - v, v] for _, v, _ in spans])
    each = np.array([w for _, _, w in spans])[:, None]
    each = each / each.sum()

    held = [(x, v) for x, v, k in zip(ids, y, kept_back, strict=True) if k]
    held_y = np.array([v for _, v in held])

    def held_logits(word_scores: np.ndarray) -> np.ndarray:
        total = [np.concatenate([[0.0], np.cumsum(word_scores[x])]) for x, _ in held]
        return np.array([max((t[b] - t[a]) / max(b - a, FLOOR) for a, b in windows_of(len(t) - 1)) for t in total]) + bias[1] - bias[0]

    best = (np.inf, vectors, softmax, bias, 1.0, 0.0)
    speed = np.zeros_like(vectors)
    first, second = [[np.zeros_like(softmax), np.zeros_like(bias)] for _ in range(2)]
    damp = (1 / np.sqrt(n_docs[buckets])).astype(np.float32)[:, None]
    for epoch in range(1, epochs + 2):
        of_words = np.zeros((len(grams), dim), np.float32)
        of_words[words_with] = np.add.reduceat(vectors[flat], by_word, axis=0)
        of_words *= per_word
        if epoch > epochs or epoch % 4 == 1:
            z = held_logits(of_words @ (softmax[1] - softmax[0]))
            scale, shift = _scale(z, held_y)
            loss = float(np.logaddexp(0, np.where(held_y == 1, -1, 1) * (scale * z + shift)).mean()) if len(z) else -float(epoch)
            if loss < best[0]:
                best = (loss, vectors, softmax.copy(), bias.copy(), scale, shift)
        if epoch > epochs:
            break
        of_windows = np.add.reduceat(of_words[word] * part, by_window, axis=0)
        z = of_windows @ softmax.T + bias
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target) * each
        back = (error @ softmax).astype(np.float32)
        to_words = np.zeros((len(grams), dim), np.float32)
        to_words[used] = np.add.reduceat(back[window[by_used]] * part[by_used], used_starts, axis=0)
        to_words *= per_word
        slope = np.add.reduceat(to_words[word_by_gram], gram_starts, axis=0) * damp
        speed = 0.8 * speed - rate * slope / (np.abs(slope).max() + 1e-12)
        vectors = vectors + speed
        for i, (x, g) in enumerate(((softmax, error.T @ of_windows), (bias, error.sum(0)))):  # Adam
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            x -= 0.05 * (first[i] / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-8)
    frequent = {w: float(weight[i]) for w, i in vocabulary.items() if share[i] >= LEAST_SHARE}
    return Toxicity(buckets, best[1], best[2], best[3], frequent, best[4], best[5])


def _scale(z: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Logistic regression of y on z with a slight pull toward scale 1, shift 0."""
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - y) + ridge * (w - [1, 0]))
        w = w - np.clip(step, -1, 1)
    return float(max(w[0], 0.05)), float(w[1])


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. No shuffle."""
    folded = model.folded()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _cache(folded)
        for batch in batches:
            z = np.array([scores.logit(x.as_py()) for x in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(folded.probability(z))], names=["_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    scored = rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double")
    return scored.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
