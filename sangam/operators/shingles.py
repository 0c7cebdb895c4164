"""Vectorised character n-grams, MinHash bands and winnowed fingerprints.

All hashing is plain integer arithmetic with fixed constants, so keys agree between
executors, runs and machines.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_set(text: str, k: int = 4) -> set[str]:
    """Distinct k-character substrings; a text shorter than k has none."""
    return {text[i : i + k] for i in range(len(text) - k + 1)}


def likeness(a: str, b: str, k: int = 4) -> float:
    """Shared distinct k-grams over all distinct k-grams; 0 when neither text has any."""
    x, y = gram_set(a, k), gram_set(b, k)
    both = len(x & y)
    either = len(x) + len(y) - both
    return both / either if either else 0.0


class Checker:
    """Likeness of many pairs, given up early where it can't reach the threshold.

    The second text's n-grams are kept while it stays the same.  Every third n-gram of
    the first is looked up before all are: at likeness t, of nx and ny n-grams at most
    (nx - t ny) / (1 + t) of the first text's are missing from the second, so more
    misses than that decide the pair.
    """

    def __init__(self, threshold: float, k: int = 4):
        self.t, self.k, self.last, self.grams = threshold, k, None, set()

    def __call__(self, x: str, y: str) -> float:
        """The likeness, or 0.0 if below the threshold."""
        if y != self.last:
            self.last, self.grams = y, gram_set(y, self.k)
        k, n = self.k, len(x) - self.k + 1
        most = (n - self.t * len(self.grams)) / (1 + self.t) + 1e-6
        if len({x[i : i + k] for i in range(0, n, 3)} - self.grams) > most:
            return 0.0
        g = gram_set(x, k)
        both = len(g & self.grams)
        either = len(g) + len(self.grams) - both
        v = both / either if either else 0.0
        return v if v >= self.t - 1e-9 else 0.0


def screen(xs: list[str], ys: list[str], threshold: float, k: int = 4, bits: int = 2048, chunk: int = 128) -> np.ndarray:
    """Which pairs may reach the threshold, by bitmaps of their hashed n-grams.  None that does is left out.

    Two texts share at most the bits they share and the n-grams of one that fall on a bit
    together; the n-grams either has are at least its bits.
    """
    out = np.empty(len(xs), bool)
    for s in range(0, len(xs), chunk):
        texts = xs[s : s + chunk] + ys[s : s + chunk]
        starts, h = gram_hashes(texts, k)
        n, m = np.diff(starts), len(texts) // 2
        flat = np.zeros(len(texts) * bits, np.uint8)
        flat[np.repeat(np.arange(len(texts)) * bits, n) + (h & np.uint32(bits - 1))] = 1
        words = np.packbits(flat).reshape(len(texts), -1).view(np.uint64)
        own = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        both = np.bitwise_count(words[:m] & words[m:]).sum(axis=1, dtype=np.int64) + np.minimum((n - own)[:m], (n - own)[m:])
        out[s : s + chunk] = both >= threshold / (1 + threshold) * (own[:m] + own[m:]) - 1e-6
    return out


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands that find a pair exactly at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class MinHasher:
    """Band keys of a text's set of k-grams.

    ``rows`` is the number of minima per band; the number of bands follows from the
    recall wanted for a pair exactly at the threshold.
    """

    def __init__(self, threshold: float = 0.7, rows: int = 6, recall: float = 0.9995, k: int = 4, seed: int = 7):
        self.k, self.rows, self.bands = k, rows, bands_for(threshold, rows, recall)
        rng = np.random.default_rng(seed)
        m = self.rows * self.bands
        self.a = (rng.integers(0, 2**32, m, dtype=np.uint64) | _U(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 2**32, m, dtype=np.uint64).astype(np.uint32)[:, None]
        self.salt = mix64(np.arange(1, self.bands + 1, dtype=np.uint64))

    def _low(self, g: np.ndarray) -> np.ndarray:
        """The least value of each hash over one text's grams."""
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for s in range(0, len(g), 256):  # the product stays in the cache, and is small for a very long text too
            h = self.a * g[None, s : s + 256]
            h ^= self.b
            np.minimum(low, h.min(axis=1), out=low)
        return low

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, number of distinct k-grams, band keys by row) of the texts that have k-grams."""
        starts, h = gram_hashes(texts, self.k)
        kept, sizes, lows = [], [], []
        for i in range(len(texts)):
            g = np.unique(h[starts[i] : starts[i + 1]])
            if len(g):
                kept.append(i)
                sizes.append(len(g))
                lows.append(self._low(g))
        if not kept:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, self.bands), np.int64)
        low = np.stack(lows).reshape(len(kept), self.bands, self.rows).astype(np.uint64)
        v = np.repeat(self.salt[None], len(kept), axis=0)
        for r in range(self.rows):
            v = mix64(v ^ low[:, :, r]) + _U(0x9E3779B97F4A7C15)
        return np.array(kept), np.array(sizes), v.view(np.int64)

    def keys(self, text: str) -> tuple[np.ndarray, int]:
        """(band keys, number of distinct k-grams); no keys for a text without k-grams."""
        at, n, v = self.batch([text])
        return (v[0], int(n[0])) if len(at) else (np.empty(0, np.int64), 0)


def gram_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): 32-bit hashes of the k-grams of many texts, text i's from starts[i] to starts[i + 1]."""
    lens = np.array([len(t) for t in texts], np.int64)
    grams = np.maximum(lens - k + 1, 0)
    starts = np.concatenate(([0], np.cumsum(grams)))
    if not starts[-1]:
        return starts, np.empty(0, np.uint32)
    x = code_points("".join(texts)).astype(np.uint64)
    h = np.zeros(len(x) - k + 1, np.uint64)
    for i in range(k):
        h = h * _U(0x100000001B3) + x[i : i + len(h)]
    h = (mix64(h) >> _U(32)).astype(np.uint32)
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    return starts, h[np.repeat(first - starts[:-1], grams) + np.arange(starts[-1])]


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every window of w values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(texts: list[str], k: int = 20, w: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed fingerprints of many texts at once: (text index, hash, position).

    In every window of ``w`` successive k-gram hashes of one text the least is kept, so
    two texts sharing ``w + k - 1`` successive characters share a fingerprint.  A text
    shorter than that gives its least hash; one shorter than k gives none.
    """
    if not texts:
        e = np.empty(0, np.int64)
        return e, e, e
    pad = "\0" * (w + k)
    x = code_points(pad.join(texts) + pad).astype(np.uint64)
    lens = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(lens + len(pad))[:-1]))
    h, have, base = x + _U(1), 1, _U(0x100000001B3)
    power = {1: np.array([base])}  # arrays wrap around silently
    while have < k:  # the hash of 2n characters from two hashes of n
        step = min(have, k - have)
        if step == have:
            h = h[:-step] * power[have] + h[step:]
            power[2 * have] = power[have] * power[have]
            have *= 2
        else:
            h = h[:-1] * base + x[have : have + len(h) - 1] + _U(1)
            have += 1
    h = mix64(h)
    owner = np.full(len(h), -1, np.int64)
    grams = np.maximum(lens - k + 1, 0)
    at = np.repeat(starts, grams) + (np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams))
    owner[at] = np.repeat(np.arange(len(texts)), grams)
    h[owner < 0] = _U(0xFFFFFFFFFFFFFFFF)
    low = _sliding(h, w, np.minimum)
    whole = np.zeros(len(low), bool)  # windows that lie inside one text, or hold the whole of a short one
    full = np.maximum(grams - w + 1, 0)
    whole[np.repeat(starts, full) + (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full))] = True
    short = starts[(grams > 0) & (grams < w)]
    whole[short] = True
    low = np.where(whole, low, _U(0))
    high = _sliding(np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64))), w, np.maximum)
    pick = np.flatnonzero((owner >= 0) & (h == high[: len(h)]))
    return owner[pick], h[pick].view(np.int64), pick - starts[owner[pick]]
