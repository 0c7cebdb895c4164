"""Near-duplicate texts: MinHash banding, shuffle on band keys, exact check on full n-gram sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.functions.text import folded
from sangam.operators.components import components
from sangam.operators.similar import similar_pairs
from sangam.session import materialise


def distinct_texts(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, text): each distinct folded text with the smallest id it stands under.

    The aggregate combines on the map side, so a text that a third of all rows repeat
    costs one row per task.
    """
    return df.select(F.col(id_col).cast("long").alias("id"), folded(text).alias("text")).groupBy("text").agg(F.min("id").alias("id")).select("id", "text")


def near_duplicate_pairs(df: DataFrame, text: str, id_col: str, threshold: float = 0.7) -> DataFrame:
    """(seq_a, seq_b) of distinct folded texts, each under its smallest id."""
    texts = materialise(distinct_texts(df, text, id_col), "texts")
    p = similar_pairs(texts, threshold)
    return p.select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def near_duplicate_groups(df: DataFrame, text: str, id_col: str, threshold: float = 0.8) -> DataFrame:
    """One row per input row: (id_col, class_id, links).

    ``class_id`` is the smallest id reachable over near-duplicate links, ``links`` the
    number of other distinct texts its text is linked to.  Rows with empty or null text
    form the class of the empty text.  Extra columns are ignored.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), folded(text).alias("text"))
    texts = materialise(base.groupBy("text").agg(F.min("id").alias("id")).select("id", "text"), "texts")
    pairs = materialise(similar_pairs(texts, threshold).select("a", "b"), "links")
    both = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    links = both.groupBy("id").agg(F.count("*").alias("links"))
    classes = components(pairs)
    h = F.unhex(F.md5("text"))
    reps = texts.select(F.col("id").alias("rep"), h.alias("h")).join(classes.select(F.col("id").alias("rep"), "label"), "rep", "left").join(links.withColumnRenamed("id", "rep"), "rep", "left")
    reps = reps.select("h", F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return base.select("id", h.alias("h")).join(reps, "h").select(F.col("id").alias(id_col), "class_id", "links")
