"""Similarity join of texts: MinHash banding, shuffle on band keys, exact check on full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.operators.buckets import HOT, KEYED, bucket_pairs, keyed_batch
from sangam.operators.shingles import Checker, MinHasher, gram_set, screen
from sangam.session import materialise

BUCKET_CAP = 256
MOST_ROWS = 14
BLOCK_ROWS = 1_000_000
BLOCK_TEXTS = 256


def band_keys(texts: DataFrame, hasher: MinHasher, cap: int, side: str | None = None) -> DataFrame:
    """Explode texts (id, text) into their band keys, combined per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(s, BLOCK_TEXTS)
                at, n, keys = hasher.batch(part.column(1).to_pylist())
                ids, sides = part.column(0).to_numpy()[at], part.column(2).to_numpy()[at]
                reps = keys.shape[1]
                parts.append((keys.ravel(), np.repeat(ids, reps), np.repeat(n, reps), np.repeat(sides, reps)))
                rows += keys.size
            if rows >= BLOCK_ROWS:
                yield keyed_batch(*[np.concatenate(x) for x in zip(*parts)], cap)
                parts, rows = [], 0
        if rows:
            yield keyed_batch(*[np.concatenate(x) for x in zip(*parts)], cap)

    cols = [F.col("id"), F.col("text"), (F.col(side) if side else F.lit(3)).cast("int").alias("side")]
    return texts.select(*cols).mapInArrow(run, KEYED)


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: exact candidates among sets (id, g) of distinct n-grams, by prefix filtering.

    A pair at or above the threshold shares one of the rarest ``n - ceil(t n) + 1``
    n-grams of each side, rarity counted over these sets; common boilerplate falls out
    of every prefix.  The join runs on the n-gram and is split by AQE where skewed.
    """
    flat = sets.withColumn("n", F.size("g")).select("id", "n", F.explode("g").alias("gram"))
    df = flat.groupBy("gram").agg(F.count("*").alias("df"))
    per = flat.join(df, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("s"))
    keep = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int")
    pre = per.select("id", "n", F.explode(F.slice("s", F.lit(1), keep)).alias("x")).select("id", "n", F.col("x.gram").alias("gram"))
    o = pre.select(F.col("id").alias("b"), F.col("n").alias("nb"), "gram")
    fits = F.least("n", "nb") >= F.greatest("n", "nb") * F.lit(threshold) - 1e-9
    return pre.join(o, "gram").where((F.col("id") < F.col("b")) & fits).select(F.col("id").alias("a"), "b").distinct()


def gram_sets(texts: DataFrame, k: int = 4) -> DataFrame:
    """(id, g): the distinct n-grams of each text, written, so that they are made once and of these texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(s, BLOCK_TEXTS)
                g = pa.array([sorted(gram_set(t, k)) for t in part.column(1).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), g], names=["id", "g"])

    return materialise(texts.select("id", "text").mapInArrow(run, "id long, g array<string>"), "grams")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, k: int = 4) -> DataFrame:
    """(a, b, likeness) of the candidate pairs (a, b) whose full n-gram sets have the likeness asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = Checker(threshold, k)
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            s = np.zeros(len(x))
            for i in np.flatnonzero(screen(x, y, threshold, k)):
                s[i] = check(x[i], y[i])
            ok = s > 0
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(s[ok])], names=["a", "b", "likeness"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, likeness double")


def candidates(texts: DataFrame, threshold: float, rows: int, recall: float, cap: int, k: int = 4, side: str | None = None) -> DataFrame:
    """(a, b), a < b: distinct pairs of texts (id, text) that share a band, as :func:`similar_pairs` checks them.

    Texts of a bucket above ``cap`` are banded anew by themselves with half as many rows again,
    which only likes share, up to MOST_ROWS; what is hot even then is paired by prefix
    filtering, exactly.  So no bucket is ever paired whole in one task, and none is dropped.
    """
    texts = texts.where(F.length("text") >= k)
    out = bucket_pairs(band_keys(texts, MinHasher(threshold, rows, recall, k), cap, side), cap, threshold, cross=side is not None)
    out = materialise(out.select("a", "b").distinct(), "bands")
    pairs = out.where(F.col("b") != HOT)
    hot = out.where(F.col("b") == HOT).select(F.col("a").alias("id"))
    if hot.isEmpty():
        return pairs
    few = materialise(texts.join(hot, "id", "left_semi"), "hot")
    if rows + rows // 2 <= MOST_ROWS:
        return pairs.unionByName(candidates(few, threshold, rows + rows // 2, recall, cap, k, side)).distinct()
    more = prefix_pairs(gram_sets(few, k), threshold)
    if side:
        s = few.select("id", side)
        bits = F.col("sa").bitwiseAND(1) * F.col("sb").bitwiseAND(2) + F.col("sa").bitwiseAND(2) * F.col("sb").bitwiseAND(1)
        more = more.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").where(bits > 0).select("a", "b")
    return pairs.unionByName(more).distinct()


def similar_pairs(texts: DataFrame, threshold: float = 0.7, rows: int = 6, recall: float = 0.9995, cap: int = BUCKET_CAP, k: int = 4, side: str | None = None) -> DataFrame:
    """(a, b, likeness), a < b: texts (id, text; unique ids) whose likeness reaches the threshold.

    Null and empty texts, and texts shorter than ``k``, have no n-grams and join nothing.
    Equal texts under two ids are a pair of likeness 1.  The number of bands follows from
    ``recall``, that of a pair exactly at the threshold.  See :func:`candidates` for band
    buckets above ``cap``.  ``side``: a column of bits 1 and 2; only texts of which one has
    bit 1 and the other bit 2 are compared.
    """
    return verify(candidates(texts, threshold, rows, recall, cap, k, side), texts, threshold, k)
