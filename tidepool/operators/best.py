"""The best of each request among rows that come in batches: what a task keeps of the rows it has read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Cells of a matrix of requests and rows that a task has at once.
CELLS = 1 << 21


class Best:
    """The ``k`` best rows of each of ``n`` requests, ties to the smaller id; ``least``: the score of the k-th, once there are so many."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.least = n, k, np.full(n, -np.inf)
        self.q, self.score, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, object)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
        ids = np.concatenate([self.ids, ids]) if len(self.ids) else ids
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -score, q))
        own = q[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        nth = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        self.least[own[nth == self.k - 1]] = score[order][nth == self.k - 1]
        kept = order[nth < self.k]
        self.q, self.score, self.ids = q[kept], score[kept], ids[kept]

    def offer(self, rough: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray, floor: float | None = None) -> None:
        """Rows by their ``rough`` scores (requests x rows, right to some 1e-12 of their size); ``exact``: scores of pairs (request, row) that come near enough, the same for equal rows wherever they lie; ``floor``: rough scores must be over it."""
        if rough.shape[1] > self.k and not np.isfinite(self.least).all():
            place = rough.shape[1] - self.k
            kth = np.maximum(self.least, np.partition(rough, place, axis=1)[:, place])
        else:
            kth = self.least
        near = np.where(np.isfinite(kth), kth - 1e-9 * np.maximum(1, np.abs(kth)), -np.inf)
        wanted = rough >= near[:, None]
        q, row = np.nonzero(wanted if floor is None else wanted & (rough > floor))
        for at in range(0, len(q), CELLS):
            i, j = q[at : at + CELLS], row[at : at + CELLS]
            self.add(i, exact(i, j), ids[j])

    def rows(self, query_ids: pa.Array, id_type: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
        """(request, id, score); a score of minus infinity is null."""
        for at in range(0, len(self.q), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.q[cut])), pa.array(self.ids[cut], id_type), pa.array(self.score[cut], pa.float64(), mask=np.isneginf(self.score[cut]))], names=names)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
