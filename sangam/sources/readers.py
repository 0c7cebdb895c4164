"""Readers with fixed contracts: quoted CSV, raw TSV, CoNLL, lexicons, reference sets."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sangam.functions import text as T

# Header names by role.
ROLES = {"english": ("english", "en", "source"), "hinglish": ("hinglish", "codemixed", "target"), "hindi": ("hindi", "hi")}


def detect_columns(header: list[str]) -> dict[str, str]:
    """Role to column, in one pass from the left; positional if no header is known."""
    found: dict[str, str] = {}
    for name in header:
        low = name.strip().lower()
        for role in ("hinglish", "english", "hindi"):
            if role not in found and name not in found.values() and (role in low or low in ROLES[role]):
                found[role] = name
                break
    if {"english", "hinglish"} <= found.keys():
        return found
    order = ("english", "hindi", "hinglish") if len(header) >= 3 else ("english", "hinglish")
    return dict(zip(order, header))


def known_header(names: list[str]) -> bool:
    """Whether a first line names the English and the Hinglish side."""
    low = [n.strip().lower() for n in names]
    has = lambda role: any(role in n or n in ROLES[role] for n in low)
    return has("english") and has("hinglish")


def read_delimited(spark: SparkSession, path: str, header: bool | None = None) -> DataFrame:
    """CSV with quotes, or TSV where a quote is data; blank rows dropped, nulls made empty.

    ``header``: whether the first line is one; by default it is if it names the sides, and
    the columns are then positional: c0, c1 and so on.  Pickled files are refused.
    """
    if path.endswith((".pkl", ".pickle")):
        raise ValueError("pickled files are not read")
    tab = path.endswith((".tsv", ".tsv.gz"))
    r = spark.read.option("sep", "\t" if tab else ",")
    r = r.option("quote", "") if tab else r.option("multiLine", True).option("escape", '"')
    if header is None:
        first = r.option("header", False).csv(path).first()
        header = first is not None and known_header([v or "" for v in first])
    df = r.option("header", header).csv(path)
    if not header:
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    return df.where(F.trim(F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns])) != "")


def ingest(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(seq, id, source, english, hindi, hinglish, row, ref): one record per reference of each row of a file.

    Sides are found by header name or position, normalised, and missing ones made empty;
    ``seq`` follows the file, ``id`` is the content id.
    """
    df = read_delimited(spark, path)
    roles = detect_columns(df.columns)
    side = lambda r: F.col(f"`{roles[r]}`") if r in roles else F.lit("")
    rows = df.select(F.monotonically_increasing_id().alias("row"), *[side(r).alias(r) for r in ("english", "hindi", "hinglish")])
    x = explode_references(rows, "hinglish").withColumn("hinglish", T.normalise("reference")).drop("reference")
    x = x.withColumn("english", T.normalise("english")).withColumn("hindi", T.normalise("hindi")).withColumn("source", F.lit(source))
    seq = F.shiftleft(F.col("row"), 10) + F.col("ref")  # room for 1024 references of a row
    return x.select(seq.alias("seq"), T.content_id("english", "hinglish").alias("id"), "source", "english", "hindi", "hinglish", "row", "ref")


def first_references(spark: SparkSession, path: str) -> DataFrame:
    """(english, hindi, hinglish): a corpus file with the first reference of each row only."""
    x = ingest(spark, path, "")
    return x.where("ref = 0").select("english", "hindi", "hinglish")


def read_nested(spark: SparkSession, paths: list[str], column: str, sides: tuple[str, str]) -> DataFrame:
    """(path, a, b): Parquet files of one struct column of two sides, as one table."""
    df = spark.read.parquet(*paths)
    return df.select(F.input_file_name().alias("path"), *[F.coalesce(F.col(f"{column}.{s}"), F.lit("")).alias(n) for s, n in zip(sides, "ab")])


def read_parallel(spark: SparkSession, path: str, most: float = 0.05) -> DataFrame:
    """(english, hindi) of a TSV: comments, blank lines and a header skipped; native script on the Hindi side is an error."""
    t = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    p = F.split("value", "\t")
    t = t.select(F.trim(p[0]).alias("english"), F.trim(F.get(p, F.lit(1))).alias("hindi")).where("hindi is not null and not (lower(english) = 'english' and lower(hindi) like 'hindi%')")
    ok = F.when(T.script_fraction("hindi") <= most, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not romanised: "), F.col("hindi"))).cast("boolean"))
    return t.where(ok)


def read_strict_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(label, form): case kept, the label not counted as a form; a form twice, in a group or across groups, is an error."""
    t = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    p = F.split("value", "\t")
    x = t.select(F.trim(p[0]).alias("label"), F.explode(F.filter(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda v: F.trim(v)), lambda v: v != "")).alias("form"))
    twice = [r.form for r in x.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").orderBy("form").limit(5).collect()]
    if twice:
        raise ValueError(f"forms given twice: {twice}")
    return x


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, line): the lines of a text with their place from 0, numbered by partition, never in one task."""
    t = spark.read.text(path).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    n = {r.p: r.n for r in t.groupBy("p").agg(F.count("*").alias("n")).collect()}
    start, at = [], 0
    for k in sorted(n):
        start.append((k, at))
        at += n[k]
    first = F.broadcast(spark.createDataFrame(start, "p int, start long"))  # a row per partition
    return t.join(first, "p").select((F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("i"), "line")


def read_aligned(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(i, a, b): two texts line by line; an error if they have not as many lines."""
    a, b = read_lines(spark, left), read_lines(spark, right)
    if a.count() != b.count():
        raise ValueError("files are not aligned")
    return a.withColumnRenamed("line", "a").join(b.withColumnRenamed("line", "b"), "i")


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of a folder of JSON run records, in either of two layouts.

    Records: (path, name, seed, started_at, elapsed, status).  A file that is no JSON, or has no name,
    is a problem (path, problem), no error.
    """
    schema = "name string, run string, seed long, started_at string, elapsed_seconds double, status string, timing struct<started_at:string,seconds:double>, _bad string"
    r = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path)
    r = r.withColumn("path", F.col("_metadata.file_path")).withColumn("name", F.coalesce("name", "run"))
    bad = F.when(F.col("_bad").isNotNull(), "not readable").when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name")
    good = r.where(bad.isNull()).select("path", "name", "seed", F.coalesce("started_at", "timing.started_at").alias("started_at"), F.coalesce("elapsed_seconds", "timing.seconds").alias("elapsed"), "status")
    return good, r.where(bad.isNotNull()).select("path", bad.alias("problem"))


def read_split(spark: SparkSession, path: str, source: str = "english", target: str = "hinglish", limit: int | None = None) -> DataFrame:
    """(source, target) of a split TSV by header name: short rows and rows with a blank side dropped.

    ``limit`` keeps so many rows by a digest of their texts, the same on every run.
    """
    df = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    x = df.select(F.col(source).alias("source"), F.col(target).alias("target")).where("trim(source) <> '' and trim(target) <> ''")
    return x if limit is None else x.orderBy(F.sha2(F.concat_ws("\t", "source", "target"), 256)).limit(limit)


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(seq, kind, english, hindi, hinglish): a corpus of templates with planted defects, made from digests of the row number.

    Kinds: base, a further rendering of a base row, near and exact copies, and one defect for each of
    the cleaning filters, in fixed shares; the same rows for the same seed whatever the partitioning.
    """
    h = lambda k: F.abs(F.xxhash64("id", F.lit(seed), F.lit(k)) % 1_000_003)
    r = h(0) / 1_000_003
    kinds = [("base", 0.70), ("extra_ref", 0.17), ("near_dup", 0.04), ("exact_dup", 0.03), ("missing_field", 0.01), ("not_romanized", 0.01), ("untranslated", 0.01), ("length_bounds", 0.015), ("length_ratio", 0.015)]
    kind, edge = F.lit(kinds[0][0]), 1.0
    for k, share in reversed(kinds[1:]):
        kind = F.when(r >= edge - share, F.lit(k)).otherwise(kind) if edge == 1.0 else F.when((r >= edge - share) & (r < edge), F.lit(k)).otherwise(kind)
        edge -= share
    of = F.when(kind.isin("extra_ref", "near_dup", "exact_dup"), h(9) % F.greatest(F.col("id"), F.lit(1))).otherwise(F.col("id"))
    x = spark.range(n).select("id", kind.alias("kind"), of.alias("of"))
    w = lambda k, words: F.element_at(F.array(*[F.lit(v) for v in words]), (F.abs(F.xxhash64("of", F.lit(seed), F.lit(k)) % len(words)) + 1).cast("int"))
    thing, place, day = w(1, ["lamp", "kite", "drum", "kettle", "scarf", "ladder", "map"]), w(2, ["market", "school", "station", "garden", "office"]), w(3, ["today", "tomorrow", "on Monday", "at noon"])
    en = F.concat(F.lit("The "), thing, F.lit(" number "), F.col("of").cast("string"), F.lit(" is at the "), place, F.lit(" "), day)
    hi = F.concat(place, F.lit(" mein "), thing, F.lit(" number "), F.col("of").cast("string"), F.lit(" "), day, F.lit(" hai"))
    k = F.col("kind")
    english = F.when(k == "missing_field", "").when(k == "near_dup", F.concat(F.lit("Look, "), en)).when(k == "length_bounds", "hello").otherwise(en)
    hinglish = F.when(k == "extra_ref", F.concat(hi, F.lit(" na"))).when(k == "untranslated", en).when(k == "not_romanized", "यह दीपक बाज़ार में है").when(k == "length_bounds", "namaste").when(k == "length_ratio", F.repeat(F.concat(hi, F.lit(" ")), 5)).otherwise(hi)
    return x.select(F.col("id").alias("seq"), "kind", english.alias("english"), F.lit("").alias("hindi"), F.trim(hinglish).alias("hinglish"))


@F.pandas_udf(ArrayType(StringType()))
def list_cell(cells: pd.Series) -> pd.Series:
    """Items of a cell holding a Python list literal; any other cell is its own item, an empty list one empty item."""

    def one(c: str | None) -> list[str]:
        c = c or ""
        if c.strip()[:1] in ("[", "("):
            try:
                v = ast.literal_eval(c.strip())
                return [str(x) for x in v] or [""]
            except (ValueError, SyntaxError):
                return [c]
        return [c]

    return cells.map(one)


def explode_references(df: DataFrame, cell: str, out: str = "reference", pos: str = "ref") -> DataFrame:
    return df.select("*", F.posexplode(list_cell(F.col(cell))).alias(pos, out))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(grp_order, label, pos, form): comments and short lines skipped, label first, no repeats."""
    t = spark.read.text(path).where("trim(value) <> '' and value not like '#%'").withColumn("grp_order", F.monotonically_increasing_id())
    parts = F.split(F.lower("value"), "\t")
    t = t.select("grp_order", F.trim(parts[0]).alias("label"), parts.alias("p")).where(F.size("p") >= 3)
    forms = F.array_distinct(F.concat(F.array("label"), F.filter(F.transform(F.slice("p", 2, F.size("p")), lambda v: F.trim(v)), lambda x: x != "")))
    return t.select("grp_order", "label", F.posexplode(forms).alias("pos", "form"))


def form_index(lexicon: DataFrame) -> DataFrame:
    """form to label; the first group to claim a form keeps it."""
    return lexicon.groupBy("form").agg(F.min_by("label", "grp_order").alias("label"))


def _tagged_line(line: Column) -> Column:
    fields = F.split(F.trim(line), r"\s+")
    return F.struct(fields[0].alias("token"), F.element_at(fields, -1).alias("tag"))


def conll_sentences(lines: Column) -> Column:
    """Sentences (arrays of (token, tag)) of an array of lines; blank lines end one, '#' lines are skipped.

    Lines are joined and split at blank ones, in time linear in the text.
    """
    kept = F.array_join(F.filter(lines, lambda x: ~x.startswith("#")), "\n")
    blocks = F.filter(F.split(kept, r"\n(?:[ \t\r]*\n)+"), lambda b: F.trim(F.regexp_replace(b, r"\s", "")) != "")
    return F.transform(blocks, lambda b: F.transform(F.filter(F.split(b, "\n"), lambda x: F.trim(x) != ""), _tagged_line))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, pos, token, tag): a file of token lines; a blank line ends a sentence, '#' lines are skipped.

    Read with the blank line as the record's end, so a large file is split between tasks; sentence
    numbers rise with the file and have gaps.
    """
    t = spark.read.option("lineSep", "\n\n").text(path).withColumn("sentence", F.monotonically_increasing_id())
    lines = F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    x = t.select("sentence", F.posexplode(lines).alias("pos", "line"))
    return x.select("sentence", "pos", _tagged_line(F.col("line")).alias("x")).select("sentence", "pos", "x.token", "x.tag")


def read_reference_sets(spark: SparkSession, path: str) -> DataFrame:
    """(english, references); an empty set is an error."""
    df = spark.read.schema("english string, references array<string>").json(path)
    return df.where(F.when(F.size("references") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("empty reference set")).cast("boolean")))


