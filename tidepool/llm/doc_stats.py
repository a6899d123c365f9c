"""Statistics of whole texts, computed in Arrow batches: the contract's counts and the features of the quality models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepool.llm.common import HASHES, WordHashes, alone, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share", "distinct_word_share", "upper_share", "digit_share", "pipe_per_word", "bang_per_word",
    "punct_share", "non_ascii_share", "words_per_line", "same_as_last_share", "longest_word",
]
#: Direction in which quality may move with a feature: -1 never up, 0 free.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "upper_share": -1, "pipe_per_word": -1, "bang_per_word": -1, "same_as_last_share": -1}

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.array([9, 10, 11, 12, 13, 32])
_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def repeated_words(h: np.ndarray, k: int = 3) -> int:
    """How many words lie in a k-word window that the text has twice or more."""
    g = windows(h, k)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for i in range(k):
        covered[i : i + len(g)] |= twice
    return int(covered.sum())


def stats_of(text: str | None, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """(COUNTS, FEATURES) of one text; a null text counts as the empty one."""
    b = (text or "").encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    points = len(b) - int(hist[0x80:0xC0].sum())
    words = b.split()
    n = len(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    h = hashes.of(words)
    chars, symbols, dups, rep = points - int(hist[_SPACES].sum()), int(hist[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(h)
    m, c = max(n, 1), max(chars, 1)
    letters = max(int(hist[65:91].sum() + hist[97:123].sum()), 1)
    features = [
        np.log1p(n), chars / m, symbols / m, dups / max(len(lines), 1), rep / m, len(set(words)) / m, hist[65:91].sum() / letters, hist[48:58].sum() / c, hist[124] / m, hist[33] / m,
        hist[_PUNCT].sum() / c, hist[0x80:].sum() / max(len(b), 1), n / max(len(lines), 1), float((h[1:] == h[:-1]).sum()) / m if n else 0.0, max(map(len, words), default=0),
    ]
    return [n, chars, symbols, dups, rep], [float(x) for x in features]


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """id, ``keep`` columns, COUNTS (long) and features (array<double>), or score (double) if a model's function is given.

    One row per row of ``docs``, no shuffle.
    """
    kinds = dict(docs.select(id_col, *keep).dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + [f"{c} bigint" for c in COUNTS] + ["score double" if score else "features array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(HASHES)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            got = [stats_of(x.as_py(), HASHES) for x in texts]
            counts = np.array([x[0] for x in got], np.int64).reshape(-1, len(COUNTS))
            x = np.array([x[1] for x in got], np.float64).reshape(-1, len(FEATURES))
            last = pa.array(score(x)) if score else pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(counts[:, i]) for i in range(len(COUNTS))), last],
                names=[id_col, *keep, *COUNTS, "score" if score else "features"],
            )

    return docs.select(id_col, *keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most ``limit`` labelled documents, picked by the hash of their id.

    Only the picked ids are broadcast (``limit`` rows of two numbers); only features reach the driver, never texts.
    """
    picked = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(limit)
    )
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    rows = document_stats(joined, "_id", "_text", keep=("_y",)).select("_id", "_y", "features").toArrow()
    x = np.array(rows["features"].combine_chunks().flatten() if rows.num_rows else [], np.float64).reshape(-1, len(FEATURES))
    y = np.array(rows["_y"], np.float64)
    order = np.lexsort((*x.T, np.array(rows["_id"])))
    return x[order], y[order]
