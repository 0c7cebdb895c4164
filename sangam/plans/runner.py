"""Runs the SQL files of a folder over registered tables, in the order of their names."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from sangam.session import table


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Tables of a data folder as views."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def run_folder(spark: SparkSession, folder: str) -> Iterator[tuple[str, DataFrame]]:
    """(file name without its ending, result) of each ``*.sql`` file; other files are passed over."""
    for f in sorted(os.listdir(folder)):
        if f.endswith(".sql"):
            with open(os.path.join(folder, f), encoding="utf-8") as sql:
                yield f[:-4], spark.sql(sql.read().rstrip().rstrip(";"))


def shown(df: DataFrame, rows: int = 20) -> str:
    """The first rows as an aligned text table."""
    cells = [df.columns] + [["" if v is None else str(v) for v in r] for r in df.limit(rows).collect()]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells)
