"""Ordered cleaning filters with a full attrition account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sangam.functions import text as T
from sangam.session import materialise

# The filters' names in the order they are charged.
FILTERS = ["missing_field", "not_romanized", "untranslated", "length_bounds", "length_ratio", "exact_duplicate"]
# A token with a letter or digit, as T.TOKEN cuts them: words are counted without making arrays of them.
_WORD = rf"_+'_*[\p{{L}}\p{{N}}]{T.WORD}*|_*[\p{{L}}\p{{N}}]{T.WORD}*(?:'{T.WORD}+)?"


def word_count(x: str) -> Column:
    """Number of word tokens; null counts as empty."""
    return F.regexp_count(F.coalesce(F.col(x), F.lit("")), F.lit(_WORD))


def _blank(x: str) -> Column:
    """Whether nothing is left of a text once white space is collapsed."""
    return ~F.coalesce(F.col(x), F.lit("")).rlike("[^" + T.SPACE[1:-2] + "]")


def measured(df: DataFrame, english: str, hinglish: str, *keep: str) -> DataFrame:
    """``keep`` and what the filters look at, each made once: blank, script share, keys, word counts."""
    deva = F.col(hinglish).rlike(r"[\x{0900}-\x{097F}]")
    return df.select(
        *keep, (_blank(english) | _blank(hinglish)).alias("_blank"), F.when(deva, T.script_fraction(hinglish)).otherwise(0.0).alias("_script"),
        T.dedup_key(english).alias("_k1"), T.dedup_key(hinglish).alias("_k2"), word_count(english).alias("_e"), word_count(hinglish).alias("_h"),
    )


def first_reason(low: int = 2, high: int = 60, ratio: float = 3.0, script: float = 0.2) -> Column:
    """The first row-wise filter a :func:`measured` pair fails, or null; ratios and bounds are inclusive."""
    r = F.col("_h") / F.col("_e")
    return (
        F.when(F.col("_blank"), FILTERS[0])
        .when(F.col("_script") > script, FILTERS[1])
        .when(F.col("_k1") == F.col("_k2"), FILTERS[2])
        .when((F.least("_e", "_h") < low) | (F.greatest("_e", "_h") > high), FILTERS[3])
        .when((r > ratio) | (r < 1 / ratio), FILTERS[4])
    )


def route(df: DataFrame, english: str = "english", hinglish: str = "hinglish", order: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(order, *keep, reason): null for kept rows.

    Texts are looked at in one pass, whose narrow result is written.  Duplicates are
    charged among survivors of the other filters only; the first by ``order`` stays.  The
    first row of a key pair comes from an aggregate that combines on
    the map side, so a pair repeated by a third of all rows is no hot task.  Null texts
    count as empty.
    """
    m = measured(df, english, hinglish, order, *keep)
    d = m.select(order, *keep, first_reason().alias("reason"), F.unhex(F.md5(F.concat_ws("\t", "_k1", "_k2"))).alias("_k"))
    d = materialise(d, "routed")
    firsts = d.where("reason is null").groupBy("_k").agg(F.min(order).alias("_first"))
    kept = d.where("reason is null").join(firsts, "_k").withColumn("reason", F.when(F.col(order) != F.col("_first"), FILTERS[5]))
    return d.where("reason is not null").drop("_k").unionByName(kept.drop("_k", "_first"))


def attrition(routed: DataFrame) -> DataFrame:
    """(step, filter_name, rows_in, removed, rows_out, pct_removed), one row per filter."""
    # one aggregate over the rows; the total is the sum of its few groups
    n = routed.groupBy(F.coalesce("reason", F.lit("")).alias("filter_name")).agg(F.count("*").alias("c"))
    c = {r.filter_name: r.c for r in n.collect()}
    rows = [(i + 1, f, c.get(f, 0), sum(c.values())) for i, f in enumerate(FILTERS)]
    d = routed.sparkSession.createDataFrame(rows, "step int, filter_name string, removed long, total long")
    upto = F.sum("removed").over(W.orderBy("step"))  # six rows
    d = d.withColumn("rows_out", F.col("total") - upto).withColumn("rows_in", F.col("rows_out") + F.col("removed"))
    pct = F.when(F.col("rows_in") > 0, F.lit(100.0) * F.col("removed") / F.col("rows_in")).otherwise(F.lit(0.0))
    return d.select("step", "filter_name", "rows_in", "removed", "rows_out", pct.alias("pct_removed"))
