"""Splits and their gates: greedy assignment, degenerate clusters, leakage, manifests, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions import text as T
from sangam.operators.neardup import near_pairs
from sangam.session import materialise

BINS = 4096  # small groups are assigned by this many bins, so the fold's length does not grow with the data


def greedy_assignment(groups: DataFrame, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """(gid, split) for groups (gid, n): whole groups, each to the split furthest below its target.

    Groups are taken in the order of a seeded digest.  Those above 1 / BINS of all records
    stand alone; the others go by bins of three hex digits of their digest, so the driver folds over at most
    2 * BINS items whatever the number of groups.  The shortfall is relative to the target; ties go to the first split.
    Null ids are left out; no groups give no rows.
    """
    g = groups.where("gid is not null").select("gid", "n", F.md5(F.concat(F.lit(f"{seed}|"), F.col("gid"))).alias("h"))
    total = g.agg(F.sum("n")).first()[0] or 0
    g = materialise(g.withColumn("item", F.when(F.col("n") * BINS > total, F.concat(F.lit("g"), "h")).otherwise(F.concat(F.lit("b"), F.substring("h", 1, 3)))), "groups")
    items = sorted((r.o, r.item, r.n) for r in g.groupBy("item").agg(F.sum("n").alias("n")).select(F.md5(F.concat(F.lit(f"{seed}|"), F.col("item"))).alias("o"), "item", "n").collect())
    left = {s: r * total for s, r in ratios.items()}
    picked = []
    for _, item, n in items:
        s = max(ratios, key=lambda k: left[k] / max(ratios[k] * total, 1e-9))
        left[s] -= n
        picked.append((item, s))
    return g.join(F.broadcast(g.sparkSession.createDataFrame(picked, "item string, split string")), "item").select("gid", "split")


def degenerate(groups: DataFrame) -> DataFrame:
    """(records, largest, degenerate): whether the largest of groups (gid, n) has over 5 % of all records, and over two."""
    a = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return a.withColumn("degenerate", F.col("largest") > F.greatest(F.col("records") * 0.05, F.lit(2.0)))


def split_sets(df: DataFrame, text: str, split: str) -> DataFrame:
    """(key, id, splits): each key with the sorted splits it stands in, joined by commas."""
    k = df.select(T.dedup_key(text).alias("key"), F.col(split).alias("s"), F.col("seq").cast("long").alias("seq"))
    return k.groupBy("key").agg(F.min("seq").alias("id"), F.array_join(F.sort_array(F.collect_set("s")), ",").alias("splits"))


def near_overlaps(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, jaccard, splits_a, splits_b): near keys of :func:`split_sets` whose sets of splits differ."""
    p = near_pairs(sets.where("key <> ''").select("id", "key"), threshold)
    x, y = sets.select(F.col("id").alias("a"), F.col("splits").alias("splits_a")), sets.select(F.col("id").alias("b"), F.col("splits").alias("splits_b"))
    return p.join(x, "a").join(y, "b").where("splits_a <> splits_b").select("a", "b", "jaccard", "splits_a", "splits_b")


def leakage(df: DataFrame, source: str, target: str, split: str, threshold: float = 0.7) -> DataFrame:
    """(exact, near, shared_targets, passed), one row: source keys in two splits, near ones, target keys in two splits.

    Shared targets are reported and do not fail the gate.
    """
    sets = materialise(split_sets(df, source, split), "sets")
    more = F.count(F.when(F.col("splits").contains(","), 1))
    exact = sets.agg(more.alias("exact"))
    near = near_overlaps(sets, threshold).agg(F.count("*").alias("near"))
    shared = split_sets(df, target, split).agg(more.alias("shared_targets"))
    one = exact.crossJoin(near).crossJoin(shared)  # one row each
    return one.withColumn("passed", (F.col("exact") == 0) & (F.col("near") == 0))


def halt(report: DataFrame, passed: str = "passed") -> DataFrame:
    """The rows of a gate's report, or an error as soon as one has not passed: to run before any write."""
    bad = report.where(~F.coalesce(F.col(passed), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"gate failed: {bad[0].asDict()}")
    return report


def manifest_diff(committed: DataFrame, fresh: DataFrame) -> DataFrame:
    """(split, status, records_committed, records_fresh) of manifests (split, records, ids_sha256).

    ``status``: ok, CHANGED, MISSING (only committed) or NEW (only fresh).
    """
    a = committed.select("split", F.col("records").alias("records_committed"), F.col("ids_sha256").alias("x"))
    b = fresh.select("split", F.col("records").alias("records_fresh"), F.col("ids_sha256").alias("y"))
    status = F.when(F.col("y").isNull(), "MISSING").when(F.col("x").isNull(), "NEW").when(F.col("x") == F.col("y"), "ok").otherwise("CHANGED")
    return a.join(b, "split", "full_outer").select("split", status.alias("status"), "records_committed", "records_fresh")


# Names, order and bounds of the parallel-corpus filters.
PARALLEL = ["missing_field", "english_not_latin", "hindi_not_devanagari", "length_bounds", "length_ratio", "duplicate_source"]


def parallel_reason(english: str, hindi: str, low: int = 4, high: int = 25, ratio: float = 2.0, least: float = 0.8) -> Column:
    """The first row-wise filter a parallel pair fails, or null; the sixth, a repeated English key, takes :func:`parallel_route`."""
    e, h = F.size(T.word_tokens(english)), F.size(T.word_tokens(hindi))
    return (
        F.when((T.normalise(english) == "") | (T.normalise(hindi) == ""), PARALLEL[0])
        .when(T.script_fraction(english) > 0.0, PARALLEL[1])
        .when(T.script_fraction(hindi) < least, PARALLEL[2])
        .when((F.least(e, h) < low) | (F.greatest(e, h) > high), PARALLEL[3])
        .when((h / e > ratio) | (h / e < 1 / ratio), PARALLEL[4])
    )


def parallel_route(df: DataFrame, english: str, hindi: str, order: str) -> DataFrame:
    """(order, reason): null for kept pairs; the first survivor of an English key stays."""
    d = materialise(df.select(order, parallel_reason(english, hindi).alias("reason"), F.unhex(F.md5(T.dedup_key(english))).alias("_k")), "parallel")
    firsts = d.where("reason is null").groupBy("_k").agg(F.min(order).alias("_first"))
    kept = d.where("reason is null").join(firsts, "_k").withColumn("reason", F.when(F.col(order) != F.col("_first"), PARALLEL[5]))
    return d.where("reason is not null").drop("_k").unionByName(kept.drop("_k", "_first"))


def problems(*rules: tuple[Column, str]) -> Column:
    """The messages of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())
