"""Mixing sources to target weights: subset-sum budget fitting over token lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sangam.session import materialise


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many texts of each length to take so that their total comes nearest below ``budget``.

    Takes the same part of every length first, largest texts next until the rest is within
    two of the longest, then fits that rest by bounded-knapsack dynamic programming over
    the lengths still available (sets of reachable sums as bits of one integer).
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return counts
    take = {n: int(c * budget // total) for n, c in counts.items()}
    rest = budget - sum(n * c for n, c in take.items())
    sizes = sorted(counts, reverse=True)
    window = 2 * sizes[0] if sizes else 0
    for n in sizes:
        if rest > window:
            k = min(counts[n] - take[n], (rest - window + n - 1) // n, rest // n)
            take[n] += k
            rest -= k * n
    if rest <= 0:
        return take
    mask = (1 << (rest + 1)) - 1
    reach, steps = 1, []
    for n in sizes:
        free = min(counts[n] - take[n], rest // n)
        k = 1
        while free > 0:
            k = min(k, free)
            steps.append((n, k, reach))
            reach = (reach | (reach << (n * k))) & mask
            free -= k
            k *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            take[n] += k
            at -= n * k
    return take


def clean_source(x: Column | str) -> Column:
    """A source name without regard to case and outer blanks."""
    c = F.col(x) if isinstance(x, str) else x
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


FITTED = 4096  # shortest lengths of a source that the dynamic programme may choose from


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17, total: int | None = None, fitted: int = FITTED) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of every document used at least once.

    ``sizes``: (id, n, source); ``targets``: (source, target_share, max_repeats), a row per
    source.  ``total`` is the wanted size in tokens; by default, and at most, it is the largest at which no source
    must exceed ``max_repeats`` uses of a document, so the scarcest source sets it.  Each source gives whole passes over its documents and copies
    fitted to its remaining budget, no document more often than allowed: of every length the
    same part, then of lengths beyond the ``fitted`` shortest the longest first, and the rest
    by dynamic programming over the ``fitted`` shortest.  Which documents of a length are taken is decided by a
    seeded hash.  Documents without tokens, or of a null or untargeted source, are not used;
    no usable documents give no rows.  Counts by length stay distributed: the driver sees
    sums by source and ``fitted`` lengths of each.
    """
    t = {r.source.strip().lower(): (float(r.target_share), int(r.max_repeats)) for r in targets.collect() if r.source and r.target_share and r.max_repeats and r.target_share > 0}
    rows = sizes.select("id", F.col("n").cast("long").alias("n"), clean_source("source").alias("source")).where((F.col("n") > 0) & F.col("source").isin(list(t) or [""]))
    rows = materialise(rows, "sizes")
    spark = rows.sparkSession
    counts = materialise(rows.groupBy("source", "n").agg(F.count("*").alias("c")), "lengths")
    size = {r.source: r.s for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("c")).alias("s")).collect()}
    weight = sum(t[s][0] for s in size) or 1.0
    most = min((size[s] * t[s][1] / (t[s][0] / weight) for s in size), default=0.0)
    most = most if total is None else min(most, total)
    budget = {s: min(round(most * t[s][0] / weight), size[s] * t[s][1]) for s in size}
    passes = {s: budget[s] // size[s] for s in size}
    extra = {s: budget[s] - passes[s] * size[s] for s in size}
    per = [(s, int(passes[s]), int(t[s][1] - passes[s]), extra[s] / (size[s] * max(t[s][1] - passes[s], 1))) for s in size]
    known = F.broadcast(spark.createDataFrame(per, "source string, passes int, again int, part double"))  # a row per target
    x = counts.join(known, "source").withColumn("free", F.col("c") * F.col("again"))
    x = x.withColumn("base", F.least("free", F.floor(F.col("free") * F.col("part") * (1 - 1e-12)).cast("long")))
    x = materialise(x.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("n"))), "parts")  # a row per length
    rest = {r.source: extra[r.source] - r.s for r in x.groupBy("source").agg(F.sum(F.col("n") * F.col("base")).alias("s")).collect()}
    small: dict[str, dict[int, int]] = {}
    for r in x.where((F.col("rank") <= fitted) & (F.col("free") > F.col("base"))).select("source", "n", (F.col("free") - F.col("base")).alias("k")).collect():
        small.setdefault(r.source, {})[r.n] = r.k
    room = [(s, int(max(0, rest[s] - 2 * max(small.get(s, {0: 0}))))) for s in rest]
    room = F.broadcast(spark.createDataFrame(room, "source string, room long"))
    long = x.where(F.col("rank") > fitted).join(room, "source")
    spare = F.col("free") - F.col("base")
    before = F.sum(F.col("n") * spare).over(W.partitionBy("source").orderBy(F.desc("n"))) - F.col("n") * spare
    more = F.greatest(F.lit(0).cast("long"), F.least(spare, F.floor((F.col("room") - before) / F.col("n")).cast("long")))
    long = materialise(long.select("source", "n", more.alias("more")).where("more > 0"), "longest")
    for r in long.groupBy("source").agg(F.sum(F.col("n") * F.col("more")).alias("s")).collect():
        rest[r.source] -= r.s
    picked = [(s, n, int(k)) for s, v in small.items() if rest[s] > 0 for n, k in fit_budget(v, rest[s]).items() if k]
    more = long.unionByName(spark.createDataFrame(picked, "source string, n long, more long"))
    take = F.col("base") + F.coalesce("more", F.lit(0))
    chosen = x.join(more, ["source", "n"], "left").select("source", "n", (F.col("passes") + F.floor(take / F.col("c"))).cast("int").alias("passes"), (take % F.col("c")).alias("extra"))
    chosen = materialise(chosen, "plan")
    h = F.xxhash64("id", F.lit(seed))
    x = rows.join(chosen, ["source", "n"]).withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 56))
    # rank within (source, length) by hash bucket, so one length never sorts in one task
    per = x.groupBy("source", "n", "bucket").agg(F.count("*").alias("c"))
    before = per.select("source", "n", "bucket", (F.sum("c").over(W.partitionBy("source", "n").orderBy("bucket")) - F.col("c")).alias("before"))
    place = F.row_number().over(W.partitionBy("source", "n", "bucket").orderBy("h", "id"))
    ranked = x.withColumn("place", place).join(before, ["source", "n", "bucket"])
    uses = F.col("passes") + F.when(F.col("place") + F.col("before") <= F.col("extra"), 1).otherwise(0)
    return ranked.select(F.col("id").alias("doc_id"), "source", F.col("n").alias("n_tokens"), uses.cast("int").alias("uses")).where("uses > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, actual_share, most_repeats) for each target."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_repeats"))
    t = targets.select(clean_source("source").alias("source"), "target_share")
    all_ = F.sum(F.coalesce("tokens", F.lit(0))).over(W.partitionBy())  # one row per target
    out = t.join(F.broadcast(got), "source", "left").withColumn("all", all_)
    return out.select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.when(F.col("all") > 0, F.coalesce("tokens", F.lit(0)) / F.col("all")).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
