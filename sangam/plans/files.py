"""Queries that write a file and read it back: each reader and sink against SQL over the table it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sangam.functions import text as T
from sangam.plans.corpus import S_NORM, S_PREP, _prep, _raw
from sangam.session import shared_dir, table
from sangam.sources import readers, sinks

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _path(s, name: str) -> str:
    return f"{shared_dir(s)}/sangam-file-{uuid.uuid4().hex}/{name}"


@query("WITH " + S_PREP + ", t AS (SELECT regexp_replace(coalesce(english, ''), '[\\t\\r\\n]+', ' ', 'g') AS a, regexp_replace(coalesce(hinglish, ''), '[\\t\\r\\n]+', ' ', 'g') AS b FROM prep WHERE split = 'test') SELECT md5(trim(a, ' ')) AS english_md5, md5(trim(b, ' ')) AS hinglish_md5 FROM t WHERE trim(a, ' ') <> '' AND trim(b, ' ') <> ''")
def split_tsv(s, d):
    """A split written as TSV, where a quote is data, and read by header name."""
    p = _path(s, "test.tsv")
    sinks.write_split_tsv(_prep(s, d).where("split = 'test'"), p, ["seq", "english", "hindi", "hinglish"])
    return readers.read_split(s, p).select(F.md5(F.trim("source")).alias("english_md5"), F.md5(F.trim("target")).alias("hinglish_md5"))


@query("SELECT run_id AS name, coalesce(seed, -1) AS seed, elapsed_seconds AS elapsed, CASE WHEN gate_passed = 1 THEN 'ok' ELSE 'failed' END AS status FROM pipeline_runs")
def ledger_scan(s, d):
    """Run records in two layouts written as JSON and scanned."""
    p = _path(s, "runs")
    r = table(s, d, "pipeline_runs").withColumn("status", F.when(F.col("gate_passed") == 1, "ok").otherwise("failed"))
    r.where("synthetic = 1").select(F.col("run_id").alias("name"), "seed", "elapsed_seconds", "status").repartition(40, "name").write.option("maxRecordsPerFile", 1).json(p + "/a")
    r.where("synthetic <> 1").select(F.col("run_id").alias("run"), "seed", "status", F.struct(F.col("elapsed_seconds").alias("seconds")).alias("timing")).repartition(40, "run").write.option("maxRecordsPerFile", 1).json(p + "/b")
    return readers.read_ledger(s, p)[0].select("name", F.coalesce("seed", F.lit(-1)).alias("seed"), "elapsed", "status")


@query("WITH t AS (SELECT regexp_replace(english, '[\\t\\r\\n]+', ' ', 'g') AS e, regexp_replace(hinglish, '[\\t\\r\\n]+', ' ', 'g') AS h FROM prepared_records WHERE NOT regexp_matches(hinglish, '[\\x{0900}-\\x{097F}]')) SELECT md5(trim(e, ' ')) AS english_md5, md5(trim(h, ' ')) AS hindi_md5 FROM t WHERE trim(e, ' ') <> '' AND NOT starts_with(e, '#')")
def parallel_tsv(s, d):
    """Pairs written as a parallel TSV under comments and a header, and read."""
    p = _path(s, "pairs")
    t = _prep(s, d).where(~F.col("hinglish").rlike(r"[\x{0900}-\x{097F}]"))
    one = lambda c: F.regexp_replace(c, r"[\t\r\n]+", " ")
    s.createDataFrame([("# pairs",), ("",), ("english\thindi_roman",)], "value string").coalesce(1).write.text(p + "/head")
    t.select(F.concat_ws("\t", one("english"), one("hinglish")).alias("value")).write.text(p + "/rows")
    return readers.read_parallel(s, [p + "/head", p + "/rows"]).where("english <> ''").select(F.md5("english").alias("english_md5"), F.md5("hindi").alias("hindi_md5"))


@query("WITH t AS (SELECT regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)^\\s*(?:assistant|hinglish|translation|output|answer)\\s*:\\s*', ''), '(?i)^\\s*(?:assistant|hinglish|translation|output|answer)\\s*:\\s*', ''), '(?i)^\\s*(?:assistant|hinglish|translation|output|answer)\\s*:\\s*', '') AS v, doc_id FROM documents) SELECT doc_id, md5(coalesce(list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], '')) AS first_md5 FROM t")
def cleaned_outputs(s, d):
    """Chat prefixes off, then the first line."""
    return table(s, d, "documents").select("doc_id", F.md5(T.clean_output("text")).alias("first_md5"))


@query("SELECT seq, md5(english || ' | ' || hindi) AS input_md5 FROM raw_records WHERE coalesce(trim(hindi, ' '), '') <> '' AND english IS NOT NULL")
def model_inputs(s, d):
    """English and Hindi as one input."""
    t = _raw(s, d).where((F.coalesce(F.trim("hindi"), F.lit("")) != "") & F.col("english").isNotNull())
    return t.select("seq", F.md5(T.build_source(F.col("english"), F.col("hindi"), "both")).alias("input_md5"))


@query("SELECT source, count(*) AS n, round(avg(english_chars), 6) AS english_chars FROM (SELECT run_id, length(english) AS english_chars FROM raw_records WHERE english IS NOT NULL) JOIN pipeline_runs USING (run_id) GROUP BY source")
def nested_parquet(s, d):
    """Two Parquet files of a struct column, as one table."""
    t = _raw(s, d).where("english is not null").join(F.broadcast(table(s, d, "pipeline_runs").select("run_id", "source")), "run_id").select("source", F.struct(F.col("english").alias("en"), F.col("source").alias("src")).alias("translation"))
    a, b = _path(s, "a"), _path(s, "b")
    even = F.crc32("translation.en") % 2 == 0
    t.where(even).write.parquet(a)
    t.where(~even).write.parquet(b)
    x = readers.read_nested(s, [a, b], "translation", ("src", "en"))
    return x.groupBy(F.col("a").alias("source")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("b")), 6).alias("english_chars"))
