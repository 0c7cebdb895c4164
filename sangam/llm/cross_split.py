"""Records of evaluation splits that also stand in train: winnowed fingerprints across splits.

Selected minima of rolling hashes are joined across splits, pairs sharing enough of them are
checked on all their n-grams, and the seeds of the accepted ones are chained and extended by
alignment to the share of each text that the other covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sangam.functions.text import folded
from sangam.operators.buckets import HOT
from sangam.operators.shingles import Checker, MinHasher, mix64, screen, winnow
from sangam.operators.similar import candidates
from sangam.session import materialise

GRAM, WINDOW = 16, 20
CAP = 512  # cross-split pairs one fingerprint may give; hotter ones are not paired
BAND_ROWS, BAND_RECALL = 5, 0.998  # of texts compared by MinHash bands
FEW = 8  # a text with fewer cold fingerprints, or less than half of its own, is compared by MinHash bands too
SHORT = 160  # texts up to so many characters have too few windows: their MinHash bands are keys instead
LONG_FROM = 110  # at likeness 0.7 no text above SHORT meets one under this
BLOCK_TEXTS = 256  # texts fingerprinted at a time: the arrays stay in the processor's cache
BLOCK_ROWS = 1_000_000
BLOCK_HOT = 1024  # texts of one block a fingerprint may stand in before its members go the other way
ROWS_A_TASK = 1_500_000
_MARK, _BOTH, _EVAL, _TRAIN, _COUNT = range(5)  # what a keyed row is, in the order of a group
_ZERO = _COUNT + (1 << 24)  # a count of nothing; what a text has too few of is below it
_CLASS = np.array([_COUNT, _TRAIN, _EVAL, _BOTH])  # by side
_KEYED = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("m", pa.int32())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32())])


def _block(key: np.ndarray, id_: np.ndarray, m: np.ndarray, short: np.ndarray, few: int) -> pa.RecordBatch:
    """Keyed rows of many texts; a key of very many becomes a marker, each text's others are counted.

    A count is of cold keys beyond those a text must keep: ``few``, or half of them, or all of
    them if it is short and its keys are bands.
    """
    order = np.argsort(key, kind="stable")
    key, id_, m, short = key[order], id_[order], m[order], short[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    hot = np.repeat(size > BLOCK_HOT, size)
    mark = key[first[size > BLOCK_HOT]]
    ids, head, at = np.unique(id_, return_index=True, return_inverse=True)
    every, lost = np.bincount(at, minlength=len(ids)), np.bincount(at[hot], minlength=len(ids))
    spare = np.where(short[head], 0, np.minimum(every - few, every // 2)) - lost
    count = np.maximum(_ZERO + spare, _COUNT).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((mark, key[~hot], mix64(ids.astype(np.uint64)).view(np.int64)))),
            pa.array(np.concatenate((np.zeros(len(mark), np.int64), id_[~hot], ids))),
            pa.array(np.concatenate((np.full(len(mark), _MARK, np.int32), m[~hot], count))),
        ],
        schema=_KEYED,
    )


def _fingerprints(texts: DataFrame, threshold: float, fields: int, k: int, w: int, few: int) -> DataFrame:
    hasher = MinHasher(threshold, BAND_ROWS, BAND_RECALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(s, BLOCK_TEXTS)
                ids, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
                m = _CLASS[part.column(2).to_numpy()].astype(np.int32)
                salt = mix64((ids % fields + 1).astype(np.uint64)).view(np.int64)  # texts of one field only meet
                lengths = np.array([len(t) for t in texts], np.int64)
                owner, key, _ = winnow(texts, k, w)
                use = lengths[owner] >= LONG_FROM
                owner, key = owner[use], key[use]
                if len(owner):
                    order = np.lexsort((key, owner))
                    owner, key = owner[order], key[order]
                    new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
                    owner, key = owner[new], key[new]
                    parts.append((key ^ salt[owner], ids[owner], m[owner], lengths[owner] <= SHORT))
                    rows += len(owner)
                for i in np.flatnonzero(lengths <= SHORT):
                    keys, n = hasher.keys(texts[i])
                    if n:
                        # twice, under two keys: one band in common is enough, as two fingerprints are
                        keys = np.concatenate((keys, keys ^ 1)) ^ salt[i]
                        parts.append((keys, np.full(len(keys), ids[i]), np.full(len(keys), m[i], np.int32), np.ones(len(keys), bool)))
                        rows += len(keys)
            if rows >= BLOCK_ROWS:
                yield _block(*[np.concatenate(x) for x in zip(*parts)], few)
                parts, rows = [], 0
        if rows:
            yield _block(*[np.concatenate(x) for x in zip(*parts)], few)

    return texts.select("id", "text", F.col("side").cast("int").alias("side")).mapInArrow(run, "key long, id long, m int")


def _out(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.astype(np.int32))], schema=_PAIRS)


def _cross(key: np.ndarray, id_: np.ndarray, m: np.ndarray, cap: int) -> Iterator[pa.RecordBatch]:
    """Cross-split pairs of whole groups in key order, members of hot groups, and counts."""
    count = m >= _COUNT
    if count.any():
        yield _out(id_[count], np.full(count.sum(), HOT), m[count] - _ZERO)
        key, id_, m = key[~count], id_[~count], m[~count]
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    marked, both, ev, tr = (np.add.reduceat((m == v).astype(np.int64), first) for v in (_MARK, _BOTH, _EVAL, _TRAIN))
    e, t = both + ev, both + tr
    over = (marked > 0) | (e * t > cap)
    hot = np.repeat(over, size) & (m > _MARK)
    if hot.any():
        yield _out(id_[hot], np.full(hot.sum(), HOT), np.full(hot.sum(), -1))
    use = np.flatnonzero(~over & (e * t > 0))
    reps = (e * t)[use]
    g = np.repeat(use, reps)
    at = np.arange(len(g)) - np.repeat(np.cumsum(reps) - reps, reps)
    x, y = at // t[g], at % t[g]
    i = first[g] + x  # texts of both splits stand first, those of evaluation next, those of train last
    j = first[g] + y + np.where(y >= both[g], ev[g], 0)
    ok = (id_[i] != id_[j]) & ~((m[i] == _BOTH) & (m[j] == _BOTH) & (i > j))
    i, j = i[ok], j[ok]
    if len(i):
        yield _out(np.minimum(id_[i], id_[j]), np.maximum(id_[i], id_[j]), np.ones(len(i)))


def _reducer(cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last group may go on
            yield from _cross(*[c[:cut] for c in cols], cap)
            rest = [c[cut:] for c in cols]
            m = rest[2]
            e, t = (m <= _EVAL).sum(), ((m == _BOTH) | (m == _TRAIN)).sum()
            if (m == _MARK).any() or e * t > cap or e > cap:  # hot: its members leave, a marker stays for those to come
                yield from _cross(*[np.append(r[m > _MARK], v) for r, v in zip(rest, (rest[0][0], 0, _MARK))], cap)
                rest = [rest[0][:1], np.zeros(1, np.int64), np.full(1, _MARK, np.int32)]
            elif not e:  # rows are in the order of their class: only train rows follow
                rest = [r[:1] for r in rest]
        if rest is not None:
            yield from _cross(*rest, cap)

    return run


def _common(x: str, y: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    at: dict[str, int] = {}
    for i, ch in enumerate(x):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for ch in y:
        u = v & at.get(ch, 0)
        v = (v + u | v - u) & full
    return len(x) - v.bit_count()


def seeds_of(texts: list[str], k: int = GRAM, w: int = WINDOW) -> list[dict[int, list[int]]]:
    """Winnowed fingerprints of each text with all their places."""
    out: list[dict[int, list[int]]] = [{} for _ in texts]
    for o, h, p in zip(*(v.tolist() for v in winnow(texts, k, w))):
        out[o].setdefault(h, []).append(p)
    return out


def chained(x: str, y: str, sx: dict[int, list[int]], sy: dict[int, list[int]], k: int = GRAM) -> int:
    """Characters of ``x`` that a chain of seeds shared with ``y`` covers once extended by alignment.

    Each shared fingerprint is a seed at every place it has; it grows both ways as far as the
    texts agree.  Of the blocks in the same order in both texts the chain covering most is kept
    (of blocks that overlap, the later counts from where the earlier ends).  Between blocks and
    at the ends the texts are aligned: where at least 6 of 10 characters of the longer
    side align, those count too.
    """
    at = sorted((i, j) for h in sx.keys() & sy.keys() for i in sx[h] for j in sy[h])
    blocks, done = [], {}  # done: where the last block on a diagonal ends
    for i, j in at:
        if i < done.get(j - i, 0):
            continue
        e, f = i + k, j + k
        while e < len(x) and f < len(y) and x[e] == y[f]:
            e, f = e + 1, f + 1
        while i > 0 and j > 0 and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
        done[j - i] = e
        blocks.append((i, j, e - i))
    if not blocks:
        return 0
    blocks.sort()
    s, t, m = (np.array(v) for v in zip(*blocks))
    best, back = m.copy(), np.full(len(m), -1)
    for n in range(1, len(m)):
        cut = np.maximum(0, np.maximum(s[:n] + m[:n] - s[n], t[:n] + m[:n] - t[n]))  # what a block loses at its front behind an earlier one
        v = np.where((t[:n] <= t[n]) & (cut < m[n]), best[:n] + m[n] - cut, 0)
        p = int(v.argmax())
        if v[p] > best[n]:
            best[n], back[n] = v[p], p
    n = int(best.argmax())
    total, right, down = int(best[n]), len(x), len(y)
    while True:
        total += _gap(x[int(s[n] + m[n]) : right], y[int(t[n] + m[n]) : down])
        right, down = int(s[n]), int(t[n])
        if back[n] < 0:
            return total + _gap(x[:right], y[:down])
        n = back[n]


def _gap(x: str, y: str) -> int:
    if not x or not y:
        return 0
    c = _common(x, y)
    return c if c >= 0.6 * max(len(x), len(y)) else 0


def coverage(evaluated: str, train: str, k: int = GRAM, w: int = WINDOW) -> float:
    """Share of ``evaluated`` that a chain of winnowed seeds common with ``train`` covers."""
    if not evaluated:
        return 0.0
    if evaluated == train:
        return 1.0
    k = min(k, len(evaluated), len(train)) or 1
    sx, sy = seeds_of([evaluated, train], k, w)
    return chained(evaluated, train, sx, sy, k) / len(evaluated)


def text_pairs(texts: DataFrame, threshold: float = 0.7, fields: int = 1, k: int = GRAM, w: int = WINDOW, cap: int = CAP, few: int = FEW, size: int = 0) -> DataFrame:
    """(a, b, sa, sb, ca, cb): ids and sides of alike texts (id, text, side), one in train (bit 1), one in evaluation (bit 2).

    Pairs sharing two winnowed fingerprints are candidates, checked by likeness; ``ca`` and
    ``cb`` are the shares of the two texts that their chained seeds cover.  A fingerprint
    that would give more than ``cap`` cross-split pairs is hot and gives none; a text left with
    fewer than ``few`` others, or less than half of its own, is compared with the like by MinHash
    bands (:func:`candidates`, which drops no hot bucket): where most of what two like texts
    share is hot, most of each is.  So is any pair of texts up to SHORT characters, by bands
    in place of fingerprints.  Only texts of one field, the remainder of the id by
    ``fields``, are compared.  ``size``: characters of all texts, if known, for the number of tasks.
    """
    texts = texts.where(F.length("text") >= 4)
    default = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(default, size * 2 // (w + 1) // ROWS_A_TASK)
    keyed = _fingerprints(texts, threshold, fields, k, w, few).repartition(tasks, "key").sortWithinPartitions("key", "m")
    out = keyed.mapInArrow(_reducer(cap), "a long, b long, c int").groupBy("a", "b").agg(F.sum("c").alias("c"))
    wanted = ((F.col("b") != HOT) & (F.col("c") >= 2)) | ((F.col("b") == HOT) & (F.col("c") < 0))
    out = materialise(out.where(wanted).select("a", "b"), "seeds")
    hot = out.where(F.col("b") == HOT).select(F.col("a").alias("id"))  # one row per id after the sum
    cand = out.where(F.col("b") != HOT)
    if not hot.isEmpty():
        dull = materialise(texts.join(hot, "id", "left_semi").select("id", "text", "side"), "boilerplate")
        more = candidates(dull, threshold, BAND_ROWS, BAND_RECALL, cap // 4, side="side")
        cand = cand.unionByName(more.where(F.col("a") % fields == F.col("b") % fields)).distinct()
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("side").alias("sa"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("side").alias("sb"))
    across = (F.col("sa").bitwiseAND(1) * F.col("sb").bitwiseAND(2) + F.col("sa").bitwiseAND(2) * F.col("sb").bitwiseAND(1)) > 0  # prefixes pair within a side too
    both = cand.join(left, "a").join(right, "b").where(across)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = Checker(threshold)
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            at = [int(i) for i in np.flatnonzero(screen(x, y, threshold)) if check(x[i], y[i]) > 0]
            seeds = seeds_of([t for i in at for t in (x[i], y[i])], k, w)
            ca = [chained(x[i], y[i], seeds[2 * n], seeds[2 * n + 1], k) / len(x[i]) for n, i in enumerate(at)]
            cb = [chained(y[i], x[i], seeds[2 * n + 1], seeds[2 * n], k) / len(y[i]) for n, i in enumerate(at)]
            take = pa.array(at, pa.int64())
            cols = [batch.column(n).take(take) for n in (0, 1, 4, 5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ca, pa.float64()), pa.array(cb, pa.float64())], names=["a", "b", "sa", "sb", "ca", "cb"])

    near = both.select("a", "b", "ta", "tb", "sa", "sb").mapInArrow(run, "a long, b long, sa int, sb int, ca double, cb double")
    one = F.lit(1.0)
    exact = texts.where(F.col("side") == 3).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(3).alias("sa"), F.lit(3).alias("sb"), one.alias("ca"), one.alias("cb"))
    return near.unionAll(exact)


def _hash(f: Column, text: str) -> list[Column]:
    """128 bits of a field and its text, to join by."""
    return [F.xxhash64(f.cast("int"), F.col(text)).alias("h1"), F.xxhash64(F.lit(97), F.col(text), f.cast("int")).alias("h2")]


def _rows(df: DataFrame, id_col: str, split: Column, fields: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Rows (seq, side, f, text), written distinct texts (id, text, side), and their characters in all."""
    s = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    side = F.when(s == "train", 1).when(s.isin("dev", "test"), 2)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), folded(c).alias("text")) for i, c in enumerate(fields)]))
    rows = df.select(F.col(id_col).cast("long").alias("seq"), side.alias("side"), each.alias("x")).where("side is not null")
    rows = rows.select("seq", "side", F.col("x.f").alias("f"), F.col("x.text").alias("text")).where(F.length("text") >= 4)
    bit = lambda v: F.max(F.when(F.col("side") == v, v).otherwise(0))
    texts = rows.groupBy("f", "text").agg((F.min("seq") * len(fields) + F.first("f")).alias("id"), (bit(1) + bit(2)).alias("side"))
    seen = Observation()
    texts = materialise(texts.select("id", "text", "side").observe(seen, F.sum(F.length("text")).alias("n")), "texts")
    return rows, texts, seen.get["n"] or 0


def overlaps(df: DataFrame, id_col: str, split: str, fields: list[str], threshold: float = 0.7) -> DataFrame:
    """(train, evaluated): ids of records of which some field is alike across splits.

    Each field is compared with itself.  Splits other than train, dev and test, and null
    ones, take no part; empty fields and ones under four characters are like nothing.
    Texts are compared once each and records expanded at the end, in joins AQE splits
    where one text stands in very many records.  Extra columns are not read.
    """
    rows, texts, size = _rows(df, id_col, F.col(split), fields)
    pairs = materialise(text_pairs(texts, threshold, len(fields), size=size).select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = texts.join(ids, "id", "left_semi").select(*_hash(F.col("id") % len(fields), "text"), "id")
    member = materialise(rows.select(*_hash(F.col("f"), "text"), "seq", "side").join(wanted, ["h1", "h2"]).select("id", "seq", "side"), "members")
    x = member.select(F.col("id").alias("a"), F.col("seq").alias("x"), F.col("side").alias("sx"))
    y = member.select(F.col("id").alias("b"), F.col("seq").alias("y"), F.col("side").alias("sy"))
    m = pairs.join(x, "a").join(y, "b").where("sx <> sy")
    return m.select(F.when(F.col("sx") == 1, F.col("x")).otherwise(F.col("y")).alias("train"), F.when(F.col("sx") == 2, F.col("x")).otherwise(F.col("y")).alias("evaluated")).distinct()


def record_coverage(df: DataFrame, id_col: str, split: str, fields: list[str], runs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(evaluated, split, source, found, exact, coverage): one row per evaluation record.

    ``found``: alike a train record; ``exact``: a field is equal but for case and
    punctuation; ``coverage``: the largest share of a field that a chain of seeds common
    with a train text alike in that field covers, null where none is.  Each field is
    measured on the text pairs that matched in it.  ``runs``: (run_id, source), a row per
    run; a null source stays null.
    """
    rows, texts, size = _rows(df, id_col, F.col(split), fields)
    pairs = materialise(text_pairs(texts, threshold, len(fields), size=size), "pairs")
    same = (F.col("a") == F.col("b")).alias("exact")
    one = pairs.where(F.col("sa").bitwiseAND(2) * F.col("sb").bitwiseAND(1) > 0).select(F.col("a").alias("id"), F.col("ca").alias("coverage"), same)
    two = pairs.where(F.col("sb").bitwiseAND(2) * F.col("sa").bitwiseAND(1) > 0).select(F.col("b").alias("id"), F.col("cb").alias("coverage"), same)
    best = one.unionAll(two).groupBy("id").agg(F.max("coverage").alias("coverage"), F.max("exact").alias("exact"))
    best = texts.join(best, "id").select(*_hash(F.col("id") % len(fields), "text"), "coverage", "exact")
    per = rows.where("side = 2").select(*_hash(F.col("f"), "text"), "seq").join(best, ["h1", "h2"]).groupBy("seq").agg(F.max("coverage").alias("coverage"), F.max("exact").alias("exact"))
    name = F.lower(F.regexp_replace(F.col(split), r"^\s+|\s+$", ""))
    recs = df.select(F.col(id_col).cast("long").alias("seq"), name.alias("split"), "run_id").where(F.col("split").isin("dev", "test"))
    sources = F.broadcast(runs.select("run_id", "source"))  # a row per run
    out = recs.join(sources, "run_id", "left").join(per, "seq", "left")
    return out.select(F.col("seq").alias("evaluated"), "split", "source", F.col("coverage").isNotNull().alias("found"), F.coalesce("exact", F.lit(False)).alias("exact"), "coverage")


def report(df: DataFrame, id_col: str, split: str, fields: list[str], runs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(split, source, records, found, exact, coverage): :func:`record_coverage` counted and averaged over the found."""
    r = record_coverage(df, id_col, split, fields, runs, threshold)
    return r.groupBy("split", "source").agg(F.count("*").alias("records"), F.count(F.when(F.col("found"), 1)).alias("found"), F.count(F.when(F.col("exact"), 1)).alias("exact"), F.avg("coverage").alias("coverage"))
