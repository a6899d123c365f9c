"""BM25 of many requests over all texts: texts are cut down to the terms asked for, once, and meet the requests as matrices.

A pair of a request and a text never becomes a row: a task works out the scores of its texts for all requests at once and keeps each
request's best. Scores of what comes near the best are summed again in the order of the terms, so that equal texts score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidepool.operators.best import CELLS, Best, one_array
from tidepool.session import stored


class Asked:
    """Requests by term: ``at`` and ``req`` list the requests of a term, ``times`` how often each asks for it; terms of many requests have a row of ``dense`` (``hot``: which, or -1)."""

    def __init__(self, wanted: pa.Table):
        ids = pc.dictionary_encode(one_array(wanted["query_id"]), null_encoding="encode")
        words = one_array(wanted["term"]).dictionary_encode()
        self.ids, self.words, self.n = ids.dictionary, words.dictionary, len(ids.dictionary)
        keys, times = np.unique(words.indices.to_numpy().astype(np.int64) * max(self.n, 1) + ids.indices.to_numpy(), return_counts=True)
        self.keys, self.req, self.times = keys, keys % max(self.n, 1), times.astype(float)
        self.at = np.searchsorted(keys, np.arange(len(self.words) + 1) * max(self.n, 1))
        many = np.diff(self.at)
        order = np.argsort(-many, kind="stable")[: min(512, max(16, 2 * CELLS // max(self.n, 1)))]
        order = order[many[order] >= max(4, self.n // 64)]
        self.hot = np.full(len(many), -1)
        self.hot[order] = np.arange(len(order))
        self.n_hot = len(order)

    def dense(self) -> np.ndarray:
        out, term = np.zeros((self.n, self.n_hot)), self.keys // max(self.n, 1)
        own = self.hot[term] >= 0
        out[self.req[own], self.hot[term[own]]] = self.times[own]
        return out


def forward(docs: DataFrame, asked: Asked) -> DataFrame:
    """doc_id, doc_len, terms, tfs: of each text its terms that are asked for, by number. ``docs``: doc_id, t (its tokens)."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(asked.words), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            tokens, n = batch.column(1), max(len(words), 1)
            lens = pc.list_value_length(tokens)
            flat = tokens.flatten()
            found = pc.index_in(flat, value_set=words.cast(flat.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), lens.fill_null(0).to_numpy(zero_copy_only=False))
            keys, tf = np.unique(doc[found >= 0] * n + found[found >= 0], return_counts=True)
            at = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * n), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (keys % n, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lens.cast(pa.int32()), *lists], names=["doc_id", "doc_len", "terms", "tfs"])

    return stored(docs.mapInArrow(run, f"doc_id {kind}, doc_len int, terms array<int>, tfs array<int>"), "forward")


def counted(docs: DataFrame, title_weight: float) -> DataFrame:
    """doc_id, len, terms, tfs: the distinct terms of each text and title with their weighted counts, without a shuffle. ``docs``: doc_id, t, title (arrays of tokens)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, doc, weight, lens = [], [], [], []
            for column, w in ((batch.column(1), 1.0), (batch.column(2), title_weight)):
                many = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
                lens.append(many)
                if w > 0:
                    words.append(column.flatten())
                    doc.append(np.repeat(np.arange(batch.num_rows), many))
                    weight.append(np.full(len(doc[-1]), w))
            coded = pa.concat_arrays(words).dictionary_encode()
            n = max(len(coded.dictionary), 1)
            keys, own = np.unique(np.concatenate(doc) * n + coded.indices.to_numpy(), return_inverse=True)
            at = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * n), pa.int32())
            terms = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(keys % n)) if len(keys) else coded.dictionary)
            tfs = pa.ListArray.from_arrays(at, pa.array(np.bincount(own, weights=np.concatenate(weight), minlength=len(keys))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lens[0].astype(np.int32)), terms, tfs], names=["doc_id", "len", "terms", "tfs"])

    return docs.mapInArrow(run, f"doc_id {kind}, len int, terms array<string>, tfs array<double>")


def best_texts(texts: DataFrame, asked: Asked, idf: np.ndarray, mean_len: float, query_type: str, k: int, k1: float, b: float, digits: int | None = None) -> DataFrame:
    """query_id, doc_id, score: the ``k`` best of each task for each request. ``texts``: rows of ``forward``; ``idf``: by term; ``digits``: scores are rounded before they are ranked."""
    sent, kind = texts.sparkSession.sparkContext.broadcast((asked, idf)), dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = sent.value
        dense, n = own.dense(), own.n
        best, id_type, step = Best(n, k), None, max(1, CELLS // max(n, 1))
        for batch in batches:
            id_type = batch.column(0).type
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists, size = part.column(2), part.num_rows
                many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                term, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                first, doc = np.r_[0, np.cumsum(many)], np.repeat(np.arange(size), many)
                lens = part.column(1).fill_null(0).to_numpy(zero_copy_only=False)[doc]
                adds = weight[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / mean_len))
                hot = own.hot[term]
                table = np.zeros((own.n_hot, size))
                table[hot[hot >= 0], doc[hot >= 0]] = adds[hot >= 0]
                rough = dense @ table
                rest = np.flatnonzero(hot < 0)
                width = own.at[term[rest] + 1] - own.at[term[rest]]
                entry = np.repeat(rest, width)
                place = np.arange(len(entry)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(own.at[term[rest]], width)
                rough += np.bincount(own.req[place] * size + doc[entry], weights=adds[entry] * own.times[place], minlength=n * size).reshape(n, size)

                def exact(i: np.ndarray, j: np.ndarray, many=many, first=first, term=term, adds=adds) -> np.ndarray:
                    out = np.empty(len(i))
                    for at in range(0, len(i), 20_000):
                        q, d = i[at : at + 20_000], j[at : at + 20_000]
                        pair = np.repeat(np.arange(len(q)), many[d])
                        entry = np.arange(len(pair)) - np.repeat(np.cumsum(many[d]) - many[d], many[d]) + np.repeat(first[d], many[d])
                        key = term[entry].astype(np.int64) * n + q[pair]
                        found = np.minimum(np.searchsorted(own.keys, key), len(own.keys) - 1)
                        out[at : at + 20_000] = np.bincount(pair, weights=np.where(own.keys[found] == key, adds[entry] * own.times[found], 0.0), minlength=len(q))
                    return out if digits is None else np.round(out, digits)

                best.offer(rough, exact, part.column(0).to_numpy(zero_copy_only=False), 0.0)
        if id_type is not None:
            yield from best.rows(own.ids, id_type, ["query_id", "doc_id", "score"])

    return texts.mapInArrow(run, f"query_id {query_type}, doc_id {kind}, score double")
