"""Resampling by digests: the same items for every system, seed and run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def numbered(items: DataFrame, key: str) -> DataFrame:
    """``items`` with ``i`` from 0 in the order of ``key``: a test set, which people read, is small."""
    return items.withColumn("i", (F.row_number().over(W.orderBy(key)) - 1).cast("long"))


def resampled(items: DataFrame, samples: int) -> DataFrame:
    """``items`` (with i) drawn with replacement ``samples`` times: ``b`` and the drawn rows.

    The index of a draw is a digest of its sample and place, so every system scored on the
    same items is resampled alike.  No items give no rows.
    """
    n = items.count()
    spark = items.sparkSession
    draws = spark.range(samples * n).select(F.floor(F.col("id") / max(n, 1)).cast("long").alias("b"), (F.col("id") % max(n, 1)).alias("j"))
    index = F.conv(F.substring(F.md5(F.concat_ws("|", "b", "j")), 1, 8), 16, 10).cast("long") % max(n, 1)
    return draws.select("b", index.alias("i")).join(items, "i")


def first_ranks(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key with their rank ``r`` from 1.

    The bound on the rank is pushed below the shuffle, so no key is gathered whole.
    """
    return rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("r") <= n)
