"""Occurrences and record counts of n-grams by suffix arrays with common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.functions.text import folded

BLOCK_TOKENS = 1_000_000
_COUNTS = pa.schema([("n", pa.int32()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def suffix_array(ids: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a token sequence and its common-prefix array, both to full length.

    ``ids``: token numbers from 1; ``rec``: the record of each token.  A suffix ends with
    its record.  ``lcp[i]`` is the common prefix of suffixes i-1 and i.  Prefix doubling:
    the ranks of every length 2^k are kept, and the common prefix is put together from them.
    """
    n = len(ids)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.append(np.flatnonzero(rec[1:] != rec[:-1]), n - 1)
    end = np.repeat(last + 1, np.diff(last, prepend=-1))
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    ranks, step = [rank], 1
    while step < (end - np.arange(n)).max():
        nxt = np.zeros(n, np.int64)  # rank 0 stands for the end of the record
        nxt[:-step] = np.where(rec[step:] == rec[:-step], rank[step:], 0)
        new = np.unique(rank * (rank.max() + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1
        settled = new.max() == rank.max()
        rank = new
        if settled:  # suffixes of one rank are the same to their end
            break
        ranks.append(rank)
        step *= 2
    sa = np.argsort(rank, kind="stable")
    a, b = sa[:-1], sa[1:]
    same = rank[a] == rank[b]
    l = np.where(same, end[a] - a, 0)  # noqa: E741
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + l, b + l
        inside = ~same & (x < end[a]) & (y < end[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        eq = inside & (ranks[k][x] == ranks[k][y])
        l = l + np.where(eq, np.minimum(1 << k, end[a] - x), 0)  # noqa: E741
    return sa, np.concatenate((np.zeros(1, np.int64), l))


def interval_counts(sa: np.ndarray, lcp: np.ndarray, rec: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a suffix start, occurrences, records) of every n-gram, one per common-prefix interval.

    Records are occurrences less the within-record adjacencies: for each suffix the last
    one before it from the same record, if that lies in the same interval, is a duplicate.
    """
    r = rec[sa]
    long = np.zeros(len(sa), bool)  # suffixes of at least n tokens
    ok = sa + n - 1 < len(rec)
    long[ok] = rec[sa[ok] + n - 1] == r[ok]
    head = lcp < n
    start = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))
    order = np.argsort(r, kind="stable")
    prev = np.full(len(sa), -1)
    same = r[order[1:]] == r[order[:-1]]
    prev[order[1:]] = np.where(same, order[:-1], -1)
    heads = np.flatnonzero(head)
    if not len(heads):
        e = np.empty(0, np.int64)
        return e, e, e
    occ = np.add.reduceat(long.astype(np.int64), heads)
    dup = np.add.reduceat((long & (prev >= start)).astype(np.int64), heads)
    use = occ > 0
    return sa[heads[use]], occ[use], (occ - dup)[use]


def _batch(out: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[f.name].tolist(), f.type) for f in _COUNTS], schema=_COUNTS)


def block_counts(texts: list[str], max_n: int) -> Iterator[pd.DataFrame]:
    """Counts of the n-grams of one block of whole records; records never span blocks.

    All lengths are read from one suffix array: an n-gram is a run of suffixes whose
    neighbours have n tokens or more in common.
    """
    words = [t.split(" ") for t in texts if t]
    if not words:
        return
    rec = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.array([x for w in words for x in w], dtype=object)
    ids, vocab = pd.factorize(flat)
    sa, lcp = suffix_array(ids + 1, rec)
    for n in range(1, max_n + 1):
        at, occ, recs = interval_counts(sa, lcp, rec, n)
        if n == 1:
            terms = flat[at]
        else:
            terms = [" ".join(flat[i : i + n]) for i in at]
        yield pd.DataFrame({"n": np.full(len(at), n, np.int32), "term": terms, "occurrences": occ, "records": recs})


def ngram_counts(df: DataFrame, text: str, record: str, max_n: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(n, term, occurrences, records) of all word n-grams up to ``max_n``.

    Terms are words of the folded text.  Rows sharing a record id count once (the least
    folded text, if they differ); rows with a null id are records of their own; null and
    empty texts are records without terms.  Each task builds suffix arrays over blocks of
    whole records, so counts add up across blocks, and one sum per n-gram merges them;
    the common terms of a block are one row each, whatever their count.
    """
    rows = df.select(F.col(record).alias("rid"), folded(text).alias("t"))
    once = rows.where("rid is not null").groupBy("rid").agg(F.min("t").alias("t")).select("t")
    once = once.unionAll(rows.where("rid is null").select("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            block += texts
            size += sum(map(len, texts)) // 5
            if size >= block_tokens:
                for out in block_counts(block, max_n):
                    yield _batch(out)
                block, size = [], 0
        for out in block_counts(block, max_n):
            yield _batch(out)

    parts = once.mapInArrow(run, "n int, term string, occurrences long, records long")
    return parts.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, text: str, record: str, max_n: int = 1, rare: int = 2, common: float = 0.15) -> DataFrame:
    """Counts with ``mark``: 'rare' in at most ``rare`` records, 'common' in more than the
    share ``common`` of all records, else null."""
    ids = df.select(F.col(record).alias("rid"))
    total = ids.agg((F.countDistinct("rid") + F.count(F.when(F.col("rid").isNull(), 1))).alias("total"))
    counts = ngram_counts(df, text, record, max_n).crossJoin(F.broadcast(total))  # one row
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.col("total") * common, "common")
    return counts.select("n", "term", "occurrences", "records", mark.alias("mark"))
