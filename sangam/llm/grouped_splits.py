"""Splits that keep related records together.

Records and entities form a bipartite graph; bundles are its components.  Whole bundles
are then dealt to the splits, stratified by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sangam.functions.text import folded
from sangam.operators.components import components
from sangam.session import materialise


def clean_key(x: Column | str) -> Column:
    """An entity id without regard to case and outer blanks; null stays null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def bundles(df: DataFrame, id_col: str, group: Column, sentence: str) -> DataFrame:
    """(id, lead) for every row: lead is the smallest id of the row's bundle.

    Rows belong together when they share a group (null joins nothing) or the folded
    sentence (null counts as empty), also through other rows.  An entity is named by its
    smallest row id, so the bipartite graph shrinks to one edge per distinct
    (group, sentence) and both aggregates combine on the map side; a group with a third
    of all rows is one node.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), group.alias("g"), F.unhex(F.md5(folded(sentence))).alias("e"))
    pairs = materialise(base.groupBy("g", "e").agg(F.min("id").alias("s")), "entities")
    by_g = pairs.where("g is not null").groupBy("g").agg(F.min("s").alias("a"))
    by_e = pairs.groupBy("e").agg(F.min("s").alias("b"))
    edges = pairs.join(by_g, "g").join(by_e, "e").select("a", "b").where("a <> b")
    labels = components(edges)
    lead = by_e.join(labels.withColumnRenamed("id", "b"), "b", "left").select("e", F.coalesce("label", "b").alias("lead"))
    return base.select("id", "e").join(lead, "e").select("id", "lead")


def _fitted(wish: dict[tuple[str, str], float], rows: dict[str, float], columns: dict[str, float], rounds: int = 50) -> dict[tuple[str, str], float]:
    """The table nearest to ``wish`` (by label and split) with the given sums, by proportional fitting."""
    x = {k: max(v, 1e-9) for k, v in wish.items()}
    for _ in range(rounds):
        for axis, sums in ((0, rows), (1, columns)):
            have: dict[str, float] = {}
            for k, v in x.items():
                have[k[axis]] = have.get(k[axis], 0.0) + v
            x = {k: v * sums[k[axis]] / (have[k[axis]] or 1.0) for k, v in x.items()}
    return x


def _steered(want: dict, inside: dict[tuple[str, str], int], have: dict[str, int], columns: dict[str, float], names: list[str], rounds: int = 30) -> dict[tuple[str, str], float]:
    """Rows of each stratum for each split, such that the labels inside the strata come out as wanted.

    ``inside``: rows by (stratum, label).  The wish for a stratum's own label is corrected by
    what all strata together would bring of it.
    """
    of: dict[str, int] = {}
    for (_, v), n in inside.items():
        of[v] = of.get(v, 0) + n
    goal = {}
    for v, n in of.items():
        w = {s: max(want.get((v, s), 0.0), 0.0) for s in names}
        goal |= {(v, s): n * w[s] / (sum(w.values()) or 1.0) for s in names}
    wish = {(v, s): goal.get((v, s), 0.0) for v in have for s in names}
    cells = _fitted(wish, have, columns)
    for _ in range(rounds):
        got = dict.fromkeys(goal, 0.0)
        for (t, v), n in inside.items():
            for s in names:
                got[v, s] += n * cells[t, s] / have[t]
        wish = {(t, s): x * min(max(goal[t, s] / (got[t, s] or 1.0), 0.5), 2.0) for (t, s), x in cells.items()}
        cells = _fitted(wish, have, columns)
    return cells


def _whole(x: dict[tuple[str, str], float], rows: dict[str, int], columns: dict[str, int]) -> dict[tuple[str, str], int]:
    """Integers near ``x`` with the exact row sums, and column sums as near as those allow."""
    out = {k: int(v) for k, v in x.items()}
    spare = {r: n - sum(v for k, v in out.items() if k[0] == r) for r, n in rows.items()}
    short = {c: n - sum(v for k, v in out.items() if k[1] == c) for c, n in columns.items()}
    for r in sorted(rows):
        for _ in range(spare[r]):
            c = max(sorted(columns), key=lambda c: (short[c], x[r, c] - out[r, c]))
            out[r, c] += 1
            short[c] -= 1
    return out


def assign_splits(rows: DataFrame, shares: dict[str, float], label: str = "label", buckets: int = 256, big_share: float = 0.001) -> DataFrame:
    """(id, lead, split) for rows (id, lead, label): whole bundles, shares as targeted.

    The record shares come first; under them the distribution of labels is kept as alike in
    all splits as whole bundles allow.  Bundles above ``big_share`` of all rows (at most
    1 / big_share of them, so they fit the driver) go largest first to the split where
    they leave the least squared distance from the wanted rows by label, weighted
    with that of the split in all.  What each split still wants of each label is then
    fitted to the rows that are left (a table of labels by splits), and the other bundles,
    each of its commonest label, are dealt accordingly: those of several rows first, those of one
    row to fill exactly what remains.  Bundles lie in hash order along a running count, taken per hash bucket and
    a table of bucket sums, never over one label in one task; the driver sees
    sums by label only.  Labels below ``big_share`` of all rows count as one.
    Null labels are a label of their own; no rows give no rows.
    """
    rows = rows.select("id", "lead", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
    per = rows.groupBy("lead", "label").agg(F.count("*").alias("n"))
    by_label = {r.label: r.n for r in per.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(int(1 / big_share)).collect()}
    total = rows.count()
    limit = max(1, int(total * big_share))
    kept = [v for v, n in by_label.items() if n >= limit]
    per = per.withColumn("label", F.when(F.col("label").isin(kept or [""]), F.col("label")).otherwise("\0rest")).groupBy("lead", "label").agg(F.sum("n").alias("n"))
    per = materialise(per, "labels")
    b = per.groupBy("lead").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("m"))
    b = materialise(b.select("lead", "n", F.col("m.label").alias("stratum"), F.xxhash64("lead", F.lit(11)).alias("h")), "bundles")
    names = sorted(shares, key=lambda s: (-shares[s], s))
    norm = sum(shares.values()) or 1.0
    share = {s: shares[s] / norm for s in names}
    left = {s: total * share[s] for s in names}  # rows a split still wants
    of_label = {r.label: r.n for r in per.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    want = {(v, s): n * share[s] for v, n in of_label.items() for s in names}
    big: dict[int, dict[str, int]] = {}
    for r in per.join(b.where(F.col("n") > limit).select("lead"), "lead").collect():  # 1 / big_share bundles of as many labels at most
        big.setdefault(r.lead, {})[r.label] = r.n
    placed = []
    for lead, labels in sorted(big.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        n = sum(labels.values())

        def worse(s: str) -> float:
            each = sum((want[v, s] - k) ** 2 - want[v, s] ** 2 for v, k in labels.items())
            return each + 4 * ((left[s] - n) ** 2 - left[s] ** 2)

        s = min(names, key=worse)
        left[s] -= n
        for v, k in labels.items():
            want[v, s] -= k
        placed.append((lead, s))
    spark = b.sparkSession
    out = spark.createDataFrame(placed, "lead long, split string")
    small = b.where(F.col("n") <= limit).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    for part in (small.where("n > 1"), small.where("n = 1")):
        have = {r.stratum: r.n for r in part.groupBy("stratum").agg(F.sum("n").alias("n")).collect()}
        if not have:
            continue
        here = sum(have.values())
        over = sum(max(v, 0.0) for v in left.values()) or 1.0
        columns = {s: max(left[s], 0.0) * here / over for s in names}
        inside = {(r.stratum, r.label): r.n for r in per.join(part.select("lead", "stratum"), "lead").groupBy("stratum", "label").agg(F.sum("n").alias("n")).collect()}
        cells = _steered(want, inside, have, columns, names)
        cut = _whole(cells, have, {s: round(n) for s, n in columns.items()})
        sums = part.groupBy("stratum", "bucket").agg(F.sum("n").alias("m"))
        # one row per label and bucket: bounded, whatever the number of bundles
        before = sums.select("stratum", "bucket", (F.sum("m").over(W.partitionBy("stratum").orderBy("bucket")) - F.col("m")).alias("start"))
        run = F.sum("n").over(W.partitionBy("stratum", "bucket").orderBy("h", "lead")) - F.col("n") / 2
        laid = part.withColumn("run", run).join(F.broadcast(before), ["stratum", "bucket"])
        edges = []
        for v in have:
            at = 0
            for s in names:
                edges.append((v, s, float(at), float(at + cut[v, s])))
                at += cut[v, s]
        edge = F.broadcast(spark.createDataFrame(edges, "stratum string, split string, lo double, hi double"))  # a row per label and split
        u = F.col("start") + F.col("run")
        dealt = materialise(laid.join(edge, "stratum").where((u >= F.col("lo")) & (u < F.col("hi"))).select("lead", "n", "stratum", "split"), "dealt")
        for r in dealt.groupBy("stratum", "split").agg(F.sum("n").alias("n")).collect():
            left[r.split] -= r.n
            want[r.stratum, r.split] = want.get((r.stratum, r.split), 0.0) - r.n
        out = out.unionByName(dealt.select("lead", "split"))
    return rows.select("id", "lead").join(out, "lead").select("id", "lead", "split")


def split_report(rows: DataFrame, shares: dict[str, float], label: str = "label") -> DataFrame:
    """(split, label, records, share, target_share, deviation) for rows (split, label).

    ``share`` is the part of the label's rows that stand in the split; a null label in the
    result stands for all rows.  Labels that are null count as ''.
    """
    x = rows.select("split", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
    n = x.groupBy("label", "split").agg(F.count("*").alias("records"))
    n = n.unionByName(n.groupBy("split").agg(F.sum("records").alias("records")).select(F.lit(None).cast("string").alias("label"), "split", "records"))
    of = n.groupBy("label").agg(F.sum("records").alias("all"))
    norm = sum(shares.values()) or 1.0
    t = F.broadcast(rows.sparkSession.createDataFrame([(k, v / norm) for k, v in shares.items()], "split string, target_share double"))  # a row per split
    grid = of.crossJoin(t)
    out = grid.join(n.withColumnRenamed("label", "l").withColumnRenamed("split", "s"), F.col("label").eqNullSafe(F.col("l")) & (F.col("split") == F.col("s")), "left")
    share = F.coalesce("records", F.lit(0)) / F.col("all")
    return out.select("split", "label", F.coalesce("records", F.lit(0)).alias("records"), share.alias("share"), "target_share", (share - F.col("target_share")).alias("deviation"))
