"""Pairs of ids that share a key, without a hot key ever landing in one task.

Rows (key, id, n, side) are hash-partitioned by key and streamed in key order; a group
of up to ``cap`` rows gives its pairs.  Larger groups are never paired here: their
members come back as *hot* rows, for the caller to treat in another, exact way.

Map-side combine: a key seen more than ``cap`` times in one block of the producing task
is replaced by a single marker row and its members leave as hot rows at once, so what
one reducer gets of a key is bounded by blocks times ``cap``, however hot the key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.operators.shingles import mix64

KEYED = "key long, id long, m long"  # m packs n, side and what the row is: 0 a hot member, 1 a member, 2 a marker
OUT = "a long, b long, c int"
_SCHEMA = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("m", pa.int64())])
_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32())])
HOT = -1


def keyed_batch(key, id_, n, side, cap: int) -> pa.RecordBatch:
    """One block of keyed rows, with keys above ``cap`` collapsed to a marker."""
    order = np.argsort(key, kind="stable")
    key, id_, n, side = key[order], id_[order], n[order], side[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    hot = np.repeat(size > cap, size)
    mark = first[size > cap]
    # Hot members travel under a key of their own id.
    away = mix64(id_[hot].astype(np.uint64)).view(np.int64)
    m = (n.astype(np.int64) << 4) | (side.astype(np.int64) << 2)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((key[~hot], key[mark], away))),
            pa.array(np.concatenate((id_[~hot], np.zeros(len(mark), np.int64), id_[hot]))),
            pa.array(np.concatenate((m[~hot] | 1, np.full(len(mark), 2, np.int64), m[hot]))),
        ],
        schema=_SCHEMA,
    )


def _out(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> pa.RecordBatch:
    c = np.ones(len(a), np.int32) if c is None else c.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c)], schema=_OUT)


def _emit(key, id_, n, side, w, cap: int, ratio: float, cross: bool, small: int) -> Iterator[pa.RecordBatch]:
    """Pairs and hot members of whole groups, given in key order."""
    if not len(key):
        return
    away = w == 0
    if away.any():
        yield _out(id_[away], np.full(away.sum(), HOT))
        key, id_, n, side, w = (v[~away] for v in (key, id_, n, side, w))
        if not len(key):
            return
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    total = np.add.reduceat(w.astype(np.int64), first)
    hot = np.repeat(total > cap, size) & (w == 1)
    if hot.any():
        yield _out(id_[hot], np.full(hot.sum(), HOT))
    use = (size > 1) & (total <= cap)
    keep = np.repeat(use, size)
    if not keep.any():
        return
    id_, n, side = id_[keep], n[keep], side[keep]
    size = size[use]
    left = np.repeat(np.cumsum(size), size) - np.arange(len(id_)) - 1  # rows after this one in its group
    at, d = np.arange(len(id_)), 1
    while True:
        at = at[left[at] >= d]
        if not len(at):
            return
        i, j = at, at + d
        ok = np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j])
        ok &= id_[i] != id_[j]
        if cross:  # one of them in train (1), another in evaluation (2)
            ok &= ((side[i] & 1) & (side[j] >> 1)) | ((side[j] & 1) & (side[i] >> 1)) == 1
        i, j = i[ok], j[ok]
        if len(i):
            yield _out(np.minimum(id_[i], id_[j]), np.maximum(id_[i], id_[j]), 1 + (np.minimum(n[i], n[j]) <= small))
        d += 1


def _reducer(cap: int, ratio: float, cross: bool, small: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        hot_key: int | None = None
        for batch in batches:
            key, id_, m = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cols = [key, id_, m >> 4, (m >> 2) & 3, np.where(m & 3 == 2, cap + 1, m & 3)]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last group may go on
            yield from _emit(*[c[:cut] for c in cols], cap, ratio, cross, small)
            rest = [c[cut:] for c in cols]
            if rest[4].sum() > cap or hot_key == rest[0][0]:  # hot for sure: let its members go, keep a marker
                members = (rest[4] == 1) | (rest[4] == 0)
                if members.any():
                    yield _out(rest[1][members], np.full(members.sum(), HOT))
                hot_key = int(rest[0][0])
                rest = [rest[0][:1], *(np.zeros(1, np.int64) for _ in range(3)), np.full(1, cap + 1)]
        if rest is not None:
            yield from _emit(*rest, cap, ratio, cross, small)

    return run


def bucket_pairs(keyed: DataFrame, cap: int, ratio: float, cross: bool = False, small: int = 0) -> DataFrame:
    """(a, b, c) with a < b for each shared key; (id, -1, c) for each membership of a hot key.

    ``ratio``: least quotient of the two ``n`` a pair may have.  ``cross``: only pairs of
    which one is in train and the other in evaluation (bits 1 and 2 of ``side``).  ``c``
    is 1, and 2 where the smaller ``n`` is at most ``small``.
    """
    return keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_reducer(cap, ratio, cross, small), OUT)
