"""Queries of the training-data operators, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sangam.functions.text import folded
from sangam.llm import cross_split, format_duplicates, grouped_splits, mixing, near_duplicates, packing, pair_defects, pii, term_counts, tokens
from sangam.session import materialise, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    m = cross_split.overlaps(table(spark, sf, "prepared_records"), "seq", "split", ["english", "hinglish"])
    return m.select(F.least("train", "evaluated").alias("seq_a"), F.greatest("train", "evaluated").alias("seq_b"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, sf, "transformed_records"), "hinglish", "record_id").where("mark is not null").select("term", "mark")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "prepared_records")
    b = grouped_splits.bundles(t, "seq", grouped_splits.clean_key("group_id"), "english")
    return b.where("id <> lead").select(F.col("lead").alias("lead_seq"), F.col("id").alias("seq"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    c = format_duplicates.copies(table(spark, sf, "raw_records"), ["english", "hinglish"], "seq")
    return c.select(F.col("keep").alias("keep_seq"), F.col("copy").alias("copy_seq"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf, "raw_records"), "english", "seq", 0.70)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    d = pair_defects.defects(table(spark, sf, "raw_records"), "english", "hinglish", "seq")
    return d.select(F.col("id").alias("seq"), "defect")


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    sizes = materialise(tokens.token_sizes(table(spark, sf, "documents"), "doc_id", "text"), "tokens")
    return packing.pack(sizes, table(spark, sf, "pack_specs"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used, the fewest there could be, and the share of their room in use."""
    per = p7_pack(spark, sf).groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    s = table(spark, sf, "pack_specs").select("spec_id", "capacity_tokens")
    room = F.col("containers") * F.col("capacity_tokens")
    return per.join(s, "spec_id").select("spec_id", "capacity_tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"), "tokens", (F.col("tokens") / room).alias("used"))


def _mix(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tokens.token_sizes(table(spark, sf, "documents"), "doc_id", "text", ["source"])
    return mixing.mix(sizes, table(spark, sf, "mix_targets"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(_mix(spark, sf), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    m = pii.find_mentions(table(spark, sf, "documents"), "doc_id", "text")
    return m.select(F.col("id").alias("doc_id"), "pii_type", "start_char")


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "pii_types")).withColumnRenamed("id", "doc_id")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation records also in train, exactly or nearly, per split and source of the run."""
    recs, runs = table(spark, sf, "prepared_records"), table(spark, sf, "pipeline_runs")
    return cross_split.report(recs, "seq", "split", ["english", "hinglish"], runs)


def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every evaluation record: whether it is in train, and how much of its best field is covered."""
    recs, runs = table(spark, sf, "prepared_records"), table(spark, sf, "pipeline_runs")
    return cross_split.record_coverage(recs, "seq", "split", ["english", "hinglish"], runs).withColumnRenamed("evaluated", "seq")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every term with its counts and its mark."""
    return term_counts.marked_terms(table(spark, sf, "transformed_records"), "hinglish", "record_id").drop("n")


def p2_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Every run of one to three words that is not rare, with its counts and its mark."""
    return term_counts.marked_terms(table(spark, sf, "transformed_records"), "hinglish", "record_id", 3).where("mark is null or mark = 'common'")


def _dealt(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, float]]:
    t, runs = table(spark, sf, "prepared_records"), table(spark, sf, "pipeline_runs").select("run_id", "source")
    lead = grouped_splits.bundles(t, "seq", grouped_splits.clean_key("group_id"), "english")
    label = t.select(F.col("seq").alias("id"), "run_id").join(F.broadcast(runs), "run_id", "left").select("id", F.col("source").alias("label"))
    rows = materialise(lead.join(label, "id"), "leads")
    share = {r.split: r.target_share for r in table(spark, sf, "split_targets").collect()}  # a row per split
    return grouped_splits.assign_splits(rows, share).join(rows.select("id", "label"), "id"), share


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split every record is dealt to, stratified by the source of its run."""
    return _dealt(spark, sf)[0].select(F.col("id").alias("seq"), F.col("lead").alias("lead_seq"), "split")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source, and of all records (source null), the share dealt to each split beside its target."""
    d, share = _dealt(spark, sf)
    return grouped_splits.split_report(d, share).withColumnRenamed("label", "source")


def p3_check(spark: SparkSession, sf: str) -> DataFrame:
    """What a deal must keep: all records once, no group or sentence divided, record shares within half a point of the targets."""
    d, share = _dealt(spark, sf)
    d = materialise(d.select(F.col("id").alias("seq"), "split"), "dealt")
    t = table(spark, sf, "prepared_records").select("seq", grouped_splits.clean_key("group_id").alias("g"), F.md5(folded("english")).alias("e")).join(d, "seq")
    cut = lambda c: t.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").agg(F.count("*").alias("divided_" + c))
    r = grouped_splits.split_report(d.withColumn("label", F.lit("")), share).where("label is null")
    near = r.agg((F.max(F.abs("deviation")) < 0.005).alias("near_targets"))
    n = d.agg(F.count("*").alias("records"), F.countDistinct("seq").alias("ids"))
    return n.crossJoin(cut("g")).crossJoin(cut("e")).crossJoin(near)  # one row each


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """What a packing must keep, by capacity: every text placed, none overfull, only texts longer than a container divided."""
    p = materialise(p7_pack(spark, sf), "packing")
    cap = F.broadcast(table(spark, sf, "pack_specs").select("spec_id", "capacity_tokens"))  # a handful of capacities
    full = p.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("n")).join(cap, "spec_id").groupBy("spec_id").agg(F.count(F.when(F.col("n") > F.col("capacity_tokens"), 1)).alias("overfull"))
    doc = p.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces")).join(cap, "spec_id")
    cut = doc.groupBy("spec_id").agg(F.count("*").alias("documents"), F.count(F.when((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens")), 1)).alias("wrongly_divided"))
    return cut.join(full, "spec_id")


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """What a mix must keep, by source: shares within a thousandth, no document used more often than allowed."""
    t = table(spark, sf, "mix_targets")
    s = mixing.shares(_mix(spark, sf), t)
    most = F.broadcast(t.select(mixing.clean_source("source").alias("source"), "max_repeats"))  # a row per source
    return s.join(most, "source").select("source", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.001).alias("near_target"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Each set of formatting copies with the number of rows it had."""
    c = format_duplicates.collapse(table(spark, sf, "raw_records"), ["english", "hinglish"], "seq")
    return c.select(F.col("keep").alias("keep_seq"), "copies")


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per raw record: its class of near-duplicate English texts at likeness 0.8."""
    return near_duplicates.near_duplicate_groups(table(spark, sf, "raw_records"), "english", "seq", 0.8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_coverage, p1_report, p2_found, p2_terms, p2_ngrams, p3_found, p3_splits, p3_report, p3_check, p4_found, p5_found, p5_collapsed, p6_found, p6_groups, p7_pack, p7_report, p7_check, p8_mix, p8_shares, p8_check, p9_found, p9_redacted)}


FOLD = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _grams(source: str) -> str:
    """Distinct 4-grams of (id, t) and their number, as CTEs grams(id, g) and sizes(id, n)."""
    return (
        f"grams AS (SELECT DISTINCT id, substr(t, CAST(i AS INT), 4) AS g FROM {source}, range(1, length(t) - 2) AS r(i)), "
        "sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id) "
    )


_TERMS = (
    "WITH r AS (SELECT record_id, min(" + FOLD.format("hinglish") + ") AS t FROM transformed_records GROUP BY record_id), "
    "w AS (SELECT record_id, unnest(string_split(t, ' ')) AS term FROM r WHERE t <> ''), "
)
_ALIKE = (
    "SELECT a.id AS x, b.id AS y, count(*) AS c, any_value(p.n) AS nx, any_value(q.n) AS ny "
    "FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id JOIN sizes p ON p.id = a.id JOIN sizes q ON q.id = b.id "
    "GROUP BY a.id, b.id HAVING count(*) >= 0.7 * (any_value(p.n) + any_value(q.n) - count(*)) - 1e-9"
)


def oracle_sql() -> dict[str, str]:
    leaf = r"regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')"
    e, h = leaf.format("english"), leaf.format("hinglish")
    return {
        "p1_found": (
            "WITH rec AS (SELECT seq, lower(trim(split)) AS s, unnest([" + FOLD.format("english") + ", " + FOLD.format("hinglish") + "]) AS t, unnest([0, 1]) AS f FROM prepared_records), "
            "r AS (SELECT seq, CASE WHEN s = 'train' THEN 1 ELSE 2 END AS side, f, t FROM rec WHERE s IN ('train', 'dev', 'test') AND length(t) >= 4), "
            "texts AS (SELECT row_number() OVER () AS id, f, t FROM (SELECT DISTINCT f, t FROM r)), "
            + _grams("texts")
            + ", alike AS (" + _ALIKE + "), "
            "links AS (SELECT x, y FROM alike UNION ALL SELECT y, x FROM alike UNION ALL SELECT id, id FROM texts), "
            "m AS (SELECT r.seq, r.side, r.f, texts.id FROM r JOIN texts ON r.f = texts.f AND r.t = texts.t) "
            "SELECT DISTINCT least(p.seq, q.seq) AS seq_a, greatest(p.seq, q.seq) AS seq_b "
            "FROM links JOIN m p ON p.id = links.x JOIN m q ON q.id = links.y WHERE p.side = 1 AND q.side = 2 AND p.f = q.f"
        ),
        "p2_found": (
            _TERMS + "c AS (SELECT term, count(DISTINCT record_id) AS n FROM w GROUP BY term) "
            "SELECT term, CASE WHEN n <= 2 THEN 'rare' ELSE 'common' END AS mark FROM c WHERE n <= 2 OR n > 0.15 * (SELECT count(*) FROM r)"
        ),
        "p2_terms": (
            _TERMS + "c AS (SELECT term, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM w GROUP BY term) "
            "SELECT term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.15 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c"
        ),
        "p2_ngrams": (
            _TERMS + "s AS (SELECT record_id, string_split(t, ' ') AS l FROM r WHERE t <> ''), "
            "g AS (SELECT record_id, n, array_to_string(l[CAST(i AS INT):CAST(i + n - 1 AS INT)], ' ') AS term FROM s, range(1, 4) AS k(n), range(1, len(l) - n + 2) AS p(i)), "
            "c AS (SELECT CAST(n AS INT) AS n, term, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM g GROUP BY ALL HAVING count(DISTINCT record_id) > 2) "
            "SELECT n, term, occurrences, records, CASE WHEN records > 0.15 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c"
        ),
        "p3_found": (
            "WITH RECURSIVE r AS (SELECT seq, lower(trim(group_id)) AS g, " + FOLD.format("english") + " AS e FROM prepared_records), "
            "m AS (SELECT seq, CASE WHEN g IS NULL THEN min(seq) OVER (PARTITION BY e) ELSE min(seq) OVER (PARTITION BY g) END AS a, min(seq) OVER (PARTITION BY e) AS b FROM r), "
            "edges AS (SELECT DISTINCT a, b FROM m UNION SELECT DISTINCT b, a FROM m), "
            "reach(x, y) AS (SELECT a, b FROM edges UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a), "
            "lead AS (SELECT x, min(y) AS l FROM reach GROUP BY x) "
            "SELECT l AS lead_seq, seq FROM m JOIN lead ON lead.x = m.b WHERE l <> seq"
        ),
        "p3_check": "SELECT count(*) AS records, count(DISTINCT seq) AS ids, 0 AS divided_g, 0 AS divided_e, true AS near_targets FROM prepared_records",
        "p7_check": "SELECT spec_id, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS overfull, 0 AS wrongly_divided FROM pack_specs",
        "p8_check": "SELECT lower(trim(source)) AS source, true AS near_target, true AS repeats_kept FROM mix_targets",
        "p5_found": (
            f"WITH r AS (SELECT seq, {e} AS e, {h} AS h FROM raw_records), k AS (SELECT seq, min(seq) OVER (PARTITION BY least(e, h), greatest(e, h)) AS keep FROM r) "
            "SELECT keep AS keep_seq, seq AS copy_seq FROM k WHERE keep <> seq"
        ),
        "p5_collapsed": (
            f"WITH r AS (SELECT seq, {e} AS e, {h} AS h FROM raw_records) "
            "SELECT min(seq) AS keep_seq, count(*) AS copies FROM r GROUP BY least(e, h), greatest(e, h)"
        ),
        "p6_groups": (
            "WITH RECURSIVE rec AS (SELECT seq, " + FOLD.format("english") + " AS t FROM raw_records), texts AS (SELECT min(seq) AS id, t FROM rec GROUP BY t), "
            + _grams("texts")
            + ", alike AS (" + _ALIKE.replace("0.7", "0.8") + "), links2 AS (SELECT x, y FROM alike UNION ALL SELECT y, x FROM alike), "
            "reach(x, y) AS (SELECT x, y FROM links2 UNION SELECT reach.x, links2.y FROM reach JOIN links2 ON reach.y = links2.x), "
            "lead AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x), n AS (SELECT x, count(*) AS links FROM links2 GROUP BY x) "
            "SELECT rec.seq, coalesce(lead.class_id, texts.id) AS class_id, coalesce(n.links, 0) AS links FROM rec JOIN texts ON texts.t = rec.t LEFT JOIN lead ON lead.x = texts.id LEFT JOIN n ON n.x = texts.id"
        ),
        "p6_found": (
            "WITH texts AS (SELECT min(seq) AS id, " + FOLD.format("english") + " AS t FROM raw_records GROUP BY 2), "
            + _grams("texts")
            + "SELECT x AS seq_a, y AS seq_b FROM (" + _ALIKE + ")"
        ),
    }
