"""Gradient-boosted trees for two classes, on binned features; small and self-contained."""

from __future__ import annotations

import numpy as np


def _quantiles(x: np.ndarray, times: np.ndarray, q: np.ndarray) -> np.ndarray:
    """np.quantile of ``x`` with each value repeated ``times``."""
    order = np.argsort(x, kind="stable")
    x, ends = x[order], np.cumsum(times[order])
    at = q * (ends[-1] - 1)
    low, high = (x[np.searchsorted(ends, k, "right")] for k in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


class Boosted:
    """Logistic boosting of depth-limited trees; the threshold is set on held-out rows."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 24, least: int = 4):
        self.trees_n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.trees, self.threshold = 0.0, [], 0.5

    def fit(self, X: np.ndarray, y: np.ndarray, seed: int = 3, times: np.ndarray | None = None) -> Boosted:
        """``times``: how often each row stands; a fifth of them are held out, of rows met several times a fifth of each."""
        n = len(y)
        if n == 0 or y.min() == y.max():
            self.base = 4.0 if n and y[0] else -4.0
            return self
        times = np.ones(n, np.int64) if times is None else times
        held = times // 5 + (np.random.default_rng(seed).random(n) < times % 5 / 5)
        train = times - held
        if not 0 < y @ train < train.sum():
            train = times
        cuts = [np.unique(_quantiles(X[:, j], train, np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(X.shape[1])]
        B = np.stack([np.searchsorted(c, X[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        p = y @ train / train.sum()
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        for _ in range(self.trees_n):
            q = 1 / (1 + np.exp(-f))
            g, h = train * (y - q), train * (q * (1 - q))
            tree: list = []
            f = f + self.rate * self._grow(tree, B, X, cuts, g, h, np.arange(n), train, self.depth)
            self.trees.append(tree)
        if held.any():
            q, t, w = 1 / (1 + np.exp(-f)), y * held, held
            best = -1.0
            for c in np.linspace(0.2, 0.8, 25):
                hit = t[q >= c].sum()
                f1 = 2 * hit / max(w[q >= c].sum() + t.sum(), 1)
                if f1 > best + 1e-9 or (abs(f1 - best) < 1e-9 and abs(c - 0.5) < abs(self.threshold - 0.5)):
                    best, self.threshold = f1, float(c)
        return self

    def _grow(self, tree, B, X, cuts, g, h, rows, train, depth) -> np.ndarray:
        out = np.zeros(len(g))
        me = len(tree)
        G, H = g[rows].sum(), h[rows].sum()
        tree.append((-1, 0.0, -1, -1, G / (H + 1.0)))
        out[rows] = G / (H + 1.0)
        if depth == 0 or train[rows].sum() < 2 * self.least:
            return out
        best, at = 1e-6, None
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gb = np.bincount(B[rows, j], g[rows], len(c) + 1).cumsum()[:-1]
            hb = np.bincount(B[rows, j], h[rows], len(c) + 1).cumsum()[:-1]
            nb = np.bincount(B[rows, j], train[rows], len(c) + 1).cumsum()
            ok = (nb[:-1] >= self.least) & (nb[-1] - nb[:-1] >= self.least)
            gain = np.where(ok, gb**2 / (hb + 1) + (G - gb) ** 2 / (H - hb + 1) - G**2 / (H + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], (j, k)
        if at is None:
            return out
        j, k = at
        left = B[rows, j] <= k
        lo = self._grow_child(tree, B, X, cuts, g, h, rows[left], train, depth - 1)
        hi = self._grow_child(tree, B, X, cuts, g, h, rows[~left], train, depth - 1)
        tree[me] = (j, float(cuts[j][k]), lo[0], hi[0], 0.0)
        out[rows[left]], out[rows[~left]] = lo[1][rows[left]], hi[1][rows[~left]]
        return out

    def _grow_child(self, tree, *args):
        at = len(tree)
        return at, self._grow(tree, *args)

    def predict(self, X: np.ndarray) -> np.ndarray:
        f = np.full(len(X), self.base)
        for tree in self.trees:
            at = np.zeros(len(X), np.int64)
            j, cut, lo, hi, leaf = (np.array(v) for v in zip(*tree))
            for _ in range(self.depth):
                inner = j[at] >= 0
                go = X[np.arange(len(X)), np.maximum(j[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, lo[at], hi[at]), at)
            f += self.rate * leaf[at]
        return 1 / (1 + np.exp(-f))
