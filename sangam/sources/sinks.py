"""Sinks: split folders with a hashed manifest, run-keyed warehouse tables."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest(df: DataFrame, split: str, id_col: str, digits: int = 4) -> DataFrame:
    """(split, records, ids_sha256): an order-free digest of the ids of each split.

    Ids are hashed in sorted order within buckets of so many hex digits of their own digest, and bucket
    digests in bucket order, so no split's ids are gathered in one task.
    """
    b = df.select(F.col(split).alias("split"), F.col(id_col).cast("string").alias("id")).withColumn("k", F.substring(F.md5("id"), 1, digits))
    per = b.groupBy("split", "k").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("id")), "\n"), 256).alias("h"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n")
    return per.groupBy("split").agg(F.sum("n").alias("records"), F.sha2(ordered, 256).alias("ids_sha256"))


def chat_fates(df: DataFrame, source: str, target: str, max_words: int) -> DataFrame:
    """``df`` with ``fate``: empty, too_long (words between blanks) or kept."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    words = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    long = F.greatest(words(source), words(target)) > max_words
    return df.withColumn("fate", F.when(blank(source) | blank(target), "empty").when(long, "too_long").otherwise("kept"))


def chat_messages(system: str, source: Column, examples: list[tuple[str, str]] | None = None, answer: Column | None = None) -> Column:
    """Messages (role, content): the system's, a turn for each example, the user's, and the answer if given."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    shots = [turn(r, F.lit(v)) for pair in examples or [] for r, v in zip(("user", "assistant"), pair)]
    return F.array(turn("system", F.lit(system)), *shots, turn("user", source), *([turn("assistant", answer)] if answer is not None else []))


def chat_row(system: str, source: Column, target: Column) -> Column:
    """One line of a chat-format JSON Lines file."""
    return F.to_json(F.struct(chat_messages(system, source, answer=target).alias("messages")))


def write_chat(df: DataFrame, path: str, system: str, source: str, target: str, max_words: int = 60) -> None:
    """Chat rows of the kept records as JSON Lines."""
    kept = chat_fates(df, source, target, max_words).where("fate = 'kept'")
    kept.select(chat_row(system, F.col(source), F.col(target)).alias("value")).write.mode("overwrite").text(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append result rows, each with the time of writing."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """Rows of figures as JSON, nulls written."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def markdown_cell(x: Column) -> Column:
    """A sheet cell: bars escaped, line breaks to blanks, cut to 160 characters."""
    v = F.regexp_replace(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\|", "\\\\|"), r"\s+", " ")
    return F.when(F.length(v) > 160, F.concat(F.substring(v, 1, 157), F.lit("..."))).otherwise(v)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def load_run(df: DataFrame, path: str) -> None:
    """Replace the partitions of the runs in ``df``; loading a run again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_split_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows as TSV with a header and no quotes: tabs and line breaks inside texts become blanks."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ").alias(c) for c in columns]
    w = df.select(*clean).write.mode("overwrite").option("sep", "\t").option("header", True)
    # without a quote character nothing is escaped: a quote is data
    w.option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A quoted CSV for people to fill in."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


class RunLedger:
    """Appends one record of a run when its block ends: its time, and whether it failed."""

    def __init__(self, spark, path: str, name: str, seed: int | None = None):
        self.spark, self.path, self.name, self.seed = spark, path, name, seed

    def __enter__(self) -> RunLedger:
        self.started = time.time()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        row = (self.name, self.seed, self.started, time.time() - self.started, "failed" if error else "ok", str(error) if error else None)
        self.spark.createDataFrame([row], "name string, seed long, started double, elapsed_seconds double, status string, error string").write.mode("append").json(self.path)
        return False
