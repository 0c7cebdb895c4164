"""Near-duplicate keys: MinHash candidates, exact Jaccard, components, greedy splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.functions import text as T
from sangam.operators.components import components
from sangam.operators.similar import similar_pairs
from sangam.session import materialise


def near_pairs(keys: DataFrame, threshold: float = 0.7, across: bool = False) -> DataFrame:
    """(a, b, jaccard), a < b, of distinct keys (id, key) at or above the threshold.

    Keys under four characters have one shingle, themselves, and are like no other key.
    ``across``: only pairs that differ in ``side``, 1 or 2.  See :func:`similar_pairs`.
    """
    texts = keys.select(F.col("id").cast("long").alias("id"), F.col("key").alias("text"), *([F.col("side")] if across else []))
    p = similar_pairs(texts, threshold, side="side" if across else None)
    return p.withColumnRenamed("likeness", "jaccard")


def contamination(candidates: DataFrame, splits: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, kind, split): splits a candidate row (id, english, other) meets, by key, other side or nearness.

    ``splits``: (id, split, english, other).  Kinds are ``exact`` (equal English key),
    ``other_exact`` (equal key of a non-blank other side) and, only for rows that met no
    split in either way, ``near`` (English keys at or above the threshold).
    """
    h = lambda c: F.md5(T.dedup_key(c))
    c = candidates.select("id", h("english").alias("e"), F.when(F.col("other").rlike(r"\S"), h("other")).alias("o"))
    e = splits.select(h("english").alias("e"), "split").distinct()  # a key has a row per split at most
    o = splits.where(F.col("other").rlike(r"\S")).select(h("other").alias("o"), "split").distinct()
    hits = c.join(e, "e").select("id", F.lit("exact").alias("kind"), "split").unionAll(c.join(o, "o").select("id", F.lit("other_exact").alias("kind"), "split"))
    hits = materialise(hits, "hits")
    rest = candidates.join(hits.select("id").distinct(), "id", "left_anti")
    key = lambda df, side: df.select("id", T.dedup_key("english").alias("key")).groupBy("key").agg((F.min("id") * 2 + side - 1).alias("id")).select("id", "key", F.lit(side).alias("side"))
    keys = materialise(key(rest, 1).unionAll(key(splits, 2)), "keys")
    p = near_pairs(keys, threshold, across=True)
    odd = F.col("a") % 2 != 0
    p = p.select(F.when(odd, F.col("b")).otherwise(F.col("a")).alias("c"), F.when(odd, F.col("a")).otherwise(F.col("b")).alias("s"))
    md = keys.select("id", F.md5("key").alias("e"))
    near = p.join(md.select(F.col("id").alias("s"), "e"), "s").join(e, "e").select("c", "split").distinct()
    near = near.join(md.select(F.col("id").alias("c"), "e"), "c").select("e", "split")
    near = rest.select("id", h("english").alias("e")).join(near, "e").select("id", F.lit("near").alias("kind"), "split")
    return hits.unionAll(near)


def group_labels(edges: DataFrame) -> DataFrame:
    """(id, label): smallest id reachable over edges (a, b); raises if it does not settle."""
    return components(edges)


def check_degenerate(largest: int, total: int) -> None:
    """Halt on a cluster above 5 % of the records (and above two)."""
    if largest > max(0.05 * total, 2):
        raise ValueError(f"degenerate cluster: {largest} of {total} records")
