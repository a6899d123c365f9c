"""Language identification: a sparse multinomial logistic regression on TF-IDF character n-grams, with calibrated scores.

A text becomes the runs of 1 to 4 characters of its lower-cased letters, with one space for everything between letters, hashed into a
fixed number of buckets. Document frequencies are counted over all rows that may be learned from (one vector a partition, merged in a
tree). The regression is trained by follow-the-regularised-leader with per-coordinate rates and an elastic net, one document at a time,
on at most ``limit`` documents, whole, dealt evenly over the languages; their sparse features are written to shared storage and
streamed through the driver, which holds one partition of them and the model. The first penalty leaves most weights at exactly zero;
only buckets with a weight are sent to the executors. Every fifth document of the sample is kept back: a temperature is fitted to it, so
that scores are probabilities.

Defined cases: a text that is null or without a letter is ``und`` with score 0; very long texts are read whole, a piece at a time; equal
texts have equal predictions; ties go to the language that sorts first; repeated rows stay repeated; a null id is neither held out nor
learned from; extra columns are ignored, whatever their names. Without rows to learn from everything is ``und``. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepool.llm.common import materialize, merged_vector

BITS = 16
BUCKETS = 1 << BITS
LONGEST = 4
#: Characters read at a time.
PIECE = 1 << 20
SPACE = 32
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter; once a worker."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _hash(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _MIX[0]
    return ((h ^ (h >> np.uint32(13))) * _MIX[1]) >> np.uint32(32 - BITS)


def gram_buckets(text: str, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, piece by piece; nothing if it has no letter."""
    tail, any_letter = np.array([SPACE], np.uint32), False
    for at in range(0, len(text), piece):
        codes = np.frombuffer(text[at : at + piece].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = letters()[codes]
        any_letter |= bool(letter.any())
        part = np.where(letter, codes, np.uint32(SPACE))[letter | np.concatenate([[tail[-1] != SPACE], letter[:-1]])]
        yield from _grams(tail, part)
        tail = np.concatenate([tail, part])[1 - LONGEST :]
    if any_letter and tail[-1] != SPACE:
        yield from _grams(tail, np.array([SPACE], np.uint32))


def _grams(tail: np.ndarray, part: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the runs that end in ``part``, of which ``tail`` is what came before."""
    if len(part):
        yield _hash(part[part != SPACE] + _MIX[3])
        stream = np.concatenate([tail, part])
        h = stream * _MIX[2]
        for n in range(2, LONGEST + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(16))) * _MIX[n % 4] + stream[n - 1 :] * _MIX[2] + np.uint32(n)
            yield _hash(h[max(0, len(tail) - n + 1) :])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text (sorted) and how often each occurs; empty if the text has no letter."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts, total = list(gram_buckets(text)) if len(text) <= PIECE else [], None
    if parts and sum(map(len, parts)) * 16 < BUCKETS:
        return np.unique(np.concatenate(parts).astype(np.int64), return_counts=True)
    for buckets in parts or gram_buckets(text):
        n = np.bincount(buckets, minlength=BUCKETS)
        total = n if total is None else total + n
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic term frequencies times the buckets' idf, of length 1."""
    x = (1 + np.log(counts)) * idf
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def is_held_out(id_col: str, fold: int = 0, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Of ``_text``: the number of texts with each bucket, and last the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[gram_counts(text.as_py())[0]] += 1
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return merged_vector(texts.select("_text").mapInArrow(run, "counts binary"), BUCKETS + 1)


def sample(usable: DataFrame, limit: int) -> DataFrame:
    """_lang, _order, ids, counts of at most ``limit`` rows of ``usable`` (_id, _lang, _text), evenly from its languages, picked by the hash of their id."""
    languages = usable.select("_lang").distinct().count()
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(*by_hash))
    picked = usable.select("_id", "_lang").distinct().withColumn("_rank", rank).filter(F.col("_rank") <= max(1, limit // max(languages, 1)))
    picked = picked.orderBy(*by_hash, "_lang").limit(limit).select("_id", "_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_counts(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i].astype("<i4").tobytes() for f in found], pa.binary()) for i in (0, 1))], names=["_lang", "_order", "ids", "counts"])

    texts = usable.join(F.broadcast(picked), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))
    return materialize(texts.select("_lang", F.xxhash64("_id").alias("_order"), "_text").mapInArrow(run, "_lang string, _order bigint, ids binary, counts binary"), "language-sample")


class Leader:
    """Follow the regularised leader: weights are a closed form of the summed gradients ``z`` and their squares ``n``."""

    def __init__(self, classes: int, rate: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 0.01):
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
        self.rate, self.beta = rate, beta
        #: The bias, last, isn't penalised.
        self.l1, self.l2 = (np.append(np.full(BUCKETS, x), 0.0)[:, None] for x in (l1, l2))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > self.l1[at], -(z - np.sign(z) * self.l1[at]) / ((self.beta + np.sqrt(self.n[at])) / self.rate + self.l2[at]), 0.0)

    def learn(self, ids: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(ids, BUCKETS), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    e = np.exp((logits - logits.max(-1, keepdims=True)) / temperature)
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray, low: float = 0.01, high: float = 20.0, steps: int = 60) -> float:
    """The temperature with the least loss: golden section on its logarithm, in which the loss has one minimum."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits, np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    a, b, r = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class LanguageModel:
    """``languages`` in order; ``weights``: a row for each bucket of ``rows`` (those with a weight); ``idf`` of all buckets."""

    languages: list[str]
    rows: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def place(self) -> np.ndarray:
        """bucket -> its row of the weights; those without one have the last, which is zero."""
        place = np.full(BUCKETS, len(self.rows), np.int32)
        place[self.rows] = np.arange(len(self.rows))
        return place

    def logits(self, ids: np.ndarray, counts: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = place[ids]
        own = at < len(self.rows)
        return tf_idf(counts, self.idf[ids])[own] @ self.weights[at[own]] + self.bias


def train(rows: Iterable[Iterable[tuple[str, int, bytes, bytes]]], languages: list[str], frequencies: np.ndarray, epochs: int = 4, **options) -> LanguageModel:
    """One pass over ``rows`` (each time anew: _lang, _order, ids, counts) for each of ``epochs``; every fifth row calibrates."""
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1
    leader, label = Leader(len(languages), **options), {x: i for i, x in enumerate(languages)}
    read = lambda r: (np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<i4"))
    for _ in range(epochs):
        for r in next(rows):
            ids, counts = read(r)
            if r[1] % 5 and len(ids):
                leader.learn(ids, tf_idf(counts, idf[ids]), label[r[0]])
    w = leader.weights()
    kept = np.flatnonzero((w[:-1] != 0).any(axis=1))
    model = LanguageModel(languages, kept, w[kept], w[-1], idf)
    place = model.place()
    back = [(model.logits(*read(r), place), label[r[0]]) for r in next(rows) if r[1] % 5 == 0 and len(r[2])]
    if back:
        model.temperature = temperature(np.stack([x for x, _ in back]), np.array([y for _, y in back]))
    return model


def fit(docs: DataFrame, limit: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> LanguageModel:
    """Learn from the rows that are not held out: frequencies from all of them, the regression from at most ``limit``."""
    usable = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    usable = usable.filter(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~is_held_out("_id"))
    rows = sample(usable, limit)
    languages = sorted(r[0] for r in rows.select("_lang").distinct().collect())  # at most ``limit``
    if not languages:
        return LanguageModel([], np.empty(0, np.int64), np.empty((0, 0)), np.empty(0), np.ones(BUCKETS))
    ordered = materialize(rows.repartitionByRange(max(1, limit // 500), "_order").sortWithinPartitions("_order", "_lang"), "language-order")

    def passes() -> Iterator[Iterable]:
        while True:
            yield ordered.toLocalIterator()

    return train(passes(), languages, document_frequencies(usable), **options)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, lang_pred, score."""
    kind = dict(docs.select(F.col(id_col).alias("_id")).dtypes)["_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place = m.place()
        for batch in batches:
            names, scores = [], np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(2)):
                ids, counts = gram_counts(text.as_py()) if m.languages else ((), ())
                if len(ids):
                    p = softmax(m.logits(ids, counts, place), m.temperature)
                    best = int(p.argmax())
                    scores[i] = p[best]
                names.append(m.languages[best] if len(ids) else "und")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", id_col)
