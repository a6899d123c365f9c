"""Gradient-boosted trees in numpy: histogram training with monotone constraints, flattened node arrays, vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as flat node arrays. A leaf has feature -1 and points at itself, so every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row of ``x``."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            at = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Logistic boosting. ``monotone[j]``: +1, -1 or 0. With one class or no rows the forest is a constant (0 without rows)."""
    n = len(y)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    mean = y.mean() if n else 0.5
    base = float(np.log((mean * n + 0.5) / (n - mean * n + 0.5))) if n else 0.0
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n else np.empty((0, x.shape[1]), int)

    def add(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", -1), ("threshold", 0.0), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        node = add(rate * float(np.clip(-total_g / (total_h + l2), low, high)))
        if level == depth or len(rows) < 2:
            return node
        best = (1e-9, -1, 0, 0.0, 0.0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            lg = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            lh = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            rg, rh = total_g - lg, total_h - lh
            lw, rw = np.clip(-lg / (lh + l2), low, high), np.clip(-rg / (rh + l2), low, high)
            gain = -(lg * lw + 0.5 * (lh + l2) * lw**2) - (rg * rw + 0.5 * (rh + l2) * rw**2) - 0.5 * total_g**2 / (total_h + l2)
            ok = (lh >= least) & (rh >= least)
            if monotone[j]:
                ok &= (rw - lw) * monotone[j] >= 0
            if ok.any():
                k = int(np.argmax(np.where(ok, gain, -np.inf)))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(lw[k]), float(rw[k]))
        _, j, k, lw, rw = best
        if j < 0:
            return node
        goes = binned[rows, j] <= k
        mid = (lw + rw) / 2
        # Leaves below either side may not cross the middle, so that the order holds in the whole tree.
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone[j]]
        a = grow(rows[goes], g, h, level + 1, *bounds[0])
        b = grow(rows[~goes], g, h, level + 1, *bounds[1])
        nodes["feature"][node], nodes["threshold"][node], nodes["left"][node], nodes["right"][node] = j, float(cuts[j][k]), a, b
        return node

    margin = np.full(n, base)
    if n and 0 < mean < 1:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            root = grow(np.arange(n), g, h, 0, -np.inf, np.inf)
            roots.append(root)
            at = np.full(n, root)
            for _ in range(depth):
                f = np.array(nodes["feature"])[at]
                at = np.where(x[np.arange(n), np.maximum(f, 0)] <= np.array(nodes["threshold"])[at], np.array(nodes["left"])[at], np.array(nodes["right"])[at])
            margin += np.array(nodes["value"])[at]
    kinds = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "value": np.float64}
    return Forest(**{k: np.array(v, kinds[k]) for k, v in nodes.items()}, roots=np.array(roots, np.int32), depth=depth, base=base)
