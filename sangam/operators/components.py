"""Connected components by iterated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.session import drop, materialise

MAX_ROUNDS = 60


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, label) for every id in edges (a, b); label is the smallest id of its component.

    Each round takes the least label among a node and its neighbours, then jumps to the
    label of that label, so chains close in logarithmically many rounds.  Aggregates
    combine on the map side; the tables are cut from their lineage every round.  Nulls in
    an edge are ignored, loops and repeated edges do no harm, no edges give no rows.
    Raises if ``max_rounds`` do not suffice rather than return a partial answer.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = materialise(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    written = labels
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "id").select("id", F.least("label", "m").alias("m"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("m"), F.col("label").alias("up"))
        step = materialise(hooked.join(jump, "m", "left").select("id", F.least("m", F.coalesce("up", "m")).alias("label"), "old"), "labels")
        done = step.where("label <> old").isEmpty()
        drop(written)
        written, labels = step, step.select("id", "label")
        if done:
            drop(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
