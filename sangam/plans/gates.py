"""Queries of splits, gates, contracts and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sangam.functions import text as T
from sangam.operators import codemix, gates, neardup
from sangam.plans import corpus
from sangam.plans.corpus import _S_NEAR, LEXICON, S_KEY, S_LEX, S_NORM, S_PREP, S_SCRIPT, S_SPANS, S_LANG, S_WORDS, _exploded, _lexicon, _prep, _raw, _tagged
from sangam.session import materialise, table
from sangam.sources import sinks

Q: dict = {}
SQL: dict[str, str] = {}
RATIOS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


S_GROUPS = S_PREP + ", gr AS (SELECT coalesce(group_id, 's' || seq) AS gid, count(*) AS n FROM prep GROUP BY 1)"


def _groups(s, d):
    return _prep(s, d).groupBy(F.coalesce("group_id", F.concat(F.lit("s"), F.col("seq").cast("string"))).alias("gid")).agg(F.count("*").alias("n"))


@query(
    "WITH RECURSIVE " + S_GROUPS + ", tot AS (SELECT sum(n)::BIGINT AS t FROM gr), h AS (SELECT gid, n, md5('42|' || gid) AS h FROM gr), "
    "it AS (SELECT gid, n, CASE WHEN n * 4096 > t THEN 'g' || h ELSE 'b' || substr(h, 1, 3) END AS item FROM h, tot), "
    "items AS (SELECT item, sum(n)::BIGINT AS n, row_number() OVER (ORDER BY md5('42|' || item)) AS k FROM it GROUP BY item), "
    "f(k, a, b, c, item, pick) AS (SELECT 0::BIGINT, 0.8::DOUBLE * t, 0.1::DOUBLE * t, 0.1::DOUBLE * t, '', '' FROM tot UNION ALL "
    "SELECT i.k, a - CASE WHEN p = 'train' THEN i.n ELSE 0 END, b - CASE WHEN p = 'dev' THEN i.n ELSE 0 END, c - CASE WHEN p = 'test' THEN i.n ELSE 0 END, i.item, p FROM "
    "(SELECT f.*, CASE WHEN a / (0.8::DOUBLE * t) >= b / (0.1::DOUBLE * t) AND a / (0.8::DOUBLE * t) >= c / (0.1::DOUBLE * t) THEN 'train' WHEN b / (0.1::DOUBLE * t) >= c / (0.1::DOUBLE * t) THEN 'dev' ELSE 'test' END AS p FROM f, tot) x JOIN items i ON i.k = x.k + 1) "
    "SELECT gid, pick AS split FROM it JOIN f ON f.item = it.item"
)
def greedy_splits(s, d):
    """Whole groups, each to the split furthest below its target, in seeded order."""
    return gates.greedy_assignment(_groups(s, d), RATIOS)


@query("WITH " + S_GROUPS + " SELECT sum(n)::BIGINT AS records, max(n) AS largest, max(n) > greatest(0.05 * sum(n), 2) AS degenerate FROM gr")
def degenerate_groups(s, d):
    """Whether one group is too large a part of all; :func:`neardup.check_degenerate` halts on it."""
    return gates.degenerate(_groups(s, d))


_SETS = S_PREP + ", sets AS (SELECT " + S_KEY.format("english") + " AS key, min(seq) AS id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM prep GROUP BY 1), " + _S_NEAR
_OVER = "over AS (SELECT near.a, near.b, jaccard, x.splits AS splits_a, y.splits AS splits_b FROM near JOIN sets x ON x.id = near.a JOIN sets y ON y.id = near.b WHERE x.splits <> y.splits)"


@query("WITH " + _SETS + ", " + _OVER + " SELECT * FROM over")
def near_overlap(s, d):
    """Near source keys whose sets of splits differ."""
    return gates.near_overlaps(materialise(gates.split_sets(_prep(s, d), "english", "split"), "sets"))


@query("WITH " + _SETS + ", " + _OVER + ", tg AS (SELECT count(DISTINCT split) AS n FROM prep GROUP BY " + S_KEY.format("hinglish") + "), r AS (SELECT (SELECT count(*) FROM sets WHERE contains(splits, ',')) AS exact, (SELECT count(*) FROM over) AS near, (SELECT count(*) FROM tg WHERE n > 1) AS shared_targets) SELECT *, exact = 0 AND near = 0 AS passed FROM r")
def leakage_gate(s, d):
    """The gate's figures; :func:`gates.halt` stops on them before any write."""
    return gates.leakage(_prep(s, d), "english", "hinglish", "split")


_CONT = (
    S_PREP + ", c AS (SELECT seq AS id, " + S_KEY.format("english") + " AS e, CASE WHEN regexp_matches(hinglish, '\\S') THEN " + S_KEY.format("hinglish") + " END AS o FROM raw_records), "
    "pe AS (SELECT DISTINCT " + S_KEY.format("english") + " AS e, split FROM prep), po AS (SELECT DISTINCT " + S_KEY.format("hinglish") + " AS o, split FROM prep WHERE regexp_matches(hinglish, '\\S')), "
    "hits AS (SELECT id, 'exact' AS kind, split FROM c JOIN pe USING (e) UNION ALL SELECT id, 'other_exact', split FROM c JOIN po USING (o)), "
    "rest AS (SELECT id, e FROM c WHERE id NOT IN (SELECT id FROM hits)), ks AS (SELECT e, 1 AS side, row_number() OVER () AS k FROM (SELECT DISTINCT e FROM rest WHERE length(e) >= 4) UNION ALL SELECT e, 2, 1000000 + row_number() OVER () FROM (SELECT DISTINCT e FROM pe WHERE length(e) >= 4)), "
    "gm AS (SELECT DISTINCT k, side, substr(e, i::INT, 4) AS g FROM ks, range(1, length(e) - 2) r(i)), gn AS (SELECT k, count(*) AS n FROM gm GROUP BY k), "
    "nr AS (SELECT a.k AS x, b.k AS y FROM gm a JOIN gm b ON a.g = b.g AND a.side = 1 AND b.side = 2 JOIN gn p ON p.k = a.k JOIN gn q ON q.k = b.k GROUP BY 1, 2 HAVING count(*)::DOUBLE / (any_value(p.n) + any_value(q.n) - count(*)) >= 0.7), "
    "nh AS (SELECT DISTINCT rest.id, 'near' AS kind, pe.split FROM rest JOIN ks u ON u.e = rest.e AND u.side = 1 JOIN nr ON nr.x = u.k JOIN ks v ON v.k = nr.y JOIN pe ON pe.e = v.e), "
    "allhits AS (SELECT * FROM hits UNION ALL SELECT * FROM nh)"
)


def _contamination(s, d):
    c = _raw(s, d).select(F.col("seq").alias("id"), "english", F.col("hinglish").alias("other"))
    return neardup.contamination(c, _prep(s, d).select(F.col("seq").alias("id"), "split", "english", F.col("hinglish").alias("other")))


@query("WITH " + _CONT + " SELECT kind, split, count(*) AS rows FROM allhits GROUP BY ALL")
def contamination_hits(s, d):
    """Rows meeting each split by English key, by the other side, and else nearly."""
    return _contamination(s, d).groupBy("kind", "split").agg(F.count("*").alias("rows"))


@query("WITH " + _CONT + " SELECT seq FROM raw_records WHERE seq NOT IN (SELECT id FROM allhits WHERE split IN ('dev', 'test'))")
def contamination_kept(s, d):
    """Rows left when all that meet dev or test, in any of the three ways, are taken out."""
    bad = _contamination(s, d).where(F.col("split").isin("dev", "test")).select(F.col("id").alias("seq")).distinct()
    return _raw(s, d).select("seq").join(bad, "seq", "left_anti")


def _s_manifest(src: str) -> str:
    return (
        "(SELECT split, sum(n)::BIGINT AS records, sha256(string_agg(h, chr(10) ORDER BY k)) AS ids_sha256 FROM (SELECT split, k, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS h "
        "FROM (SELECT split, seq::VARCHAR AS id, substr(md5(seq::VARCHAR), 1, 4) AS k FROM " + src + ") GROUP BY split, k) GROUP BY split)"
    )


@query("WITH " + S_PREP + " SELECT * FROM " + _s_manifest("prep"))
def split_manifest(s, d):
    """K1: digests per split, in buckets so that no split meets in one task."""
    return sinks.manifest(_prep(s, d), "split", "seq")


@query("WITH " + S_PREP + ", live AS (SELECT * FROM prep WHERE record_id IN (SELECT record_id FROM transformed_records) OR split = 'train'), a AS " + _s_manifest("prep") + ", b AS " + _s_manifest("live") + " SELECT split, CASE WHEN b.ids_sha256 IS NULL THEN 'MISSING' WHEN a.ids_sha256 IS NULL THEN 'NEW' WHEN a.ids_sha256 = b.ids_sha256 THEN 'ok' ELSE 'CHANGED' END AS status, a.records AS records_committed, b.records AS records_fresh FROM a FULL JOIN b USING (split)")
def manifest_check(s, d):
    """The committed manifest against one made of the rows still there."""
    p = _prep(s, d)
    live = p.where("split <> 'train'").join(table(s, d, "transformed_records").select("record_id").distinct(), "record_id", "left_semi").unionByName(p.where("split = 'train'"))
    return gates.manifest_diff(sinks.manifest(p, "split", "seq"), sinks.manifest(live, "split", "seq"))


@query("WITH p AS (SELECT seq, english, hindi, " + S_NORM.format("english") + " AS ne, " + S_NORM.format("hindi") + " AS nh, " + S_SCRIPT.format("english") + " AS se, " + S_SCRIPT.format("hindi") + " AS sh, len(" + S_WORDS.format("english") + ") AS e, len(" + S_WORDS.format("hindi") + ") AS h, " + S_KEY.format("english") + " AS k FROM raw_records), "
       "q AS (SELECT *, CASE WHEN ne = '' OR nh = '' THEN 'missing_field' WHEN se > 0 THEN 'english_not_latin' WHEN sh < 0.8 THEN 'hindi_not_devanagari' WHEN least(e, h) < 4 OR greatest(e, h) > 25 THEN 'length_bounds' WHEN h::DOUBLE / e > 2 OR h::DOUBLE / e < 0.5 THEN 'length_ratio' END AS r0 FROM p), "
       "r AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN r0 WHEN row_number() OVER (PARTITION BY r0 IS NULL, k ORDER BY seq) > 1 THEN 'duplicate_source' ELSE 'kept' END AS reason FROM q) SELECT reason, count(*) AS rows, min(seq) AS first FROM r GROUP BY reason")  # fmt: skip
def parallel_filters(s, d):
    """F8: the parallel-corpus filters over the English and Hindi sides."""
    r = gates.parallel_route(_raw(s, d), "english", "hindi", "seq")
    return r.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"), F.min("seq").alias("first"))


_GOLD = "CASE WHEN english IS NULL OR trim(english, ' ') = '' THEN 'blank source' END, CASE WHEN hinglish IS NULL OR trim(hinglish, ' ') = '' THEN 'blank target' END, CASE WHEN record_id IS NOT NULL AND seq > f1 THEN 'repeated id' END, CASE WHEN seq > f2 THEN 'repeated source' END, CASE WHEN hindi IS NULL AND starts_with(lower(hinglish), 'n') THEN 'flag without note' END"


@query("WITH x AS (SELECT *, min(seq) OVER (PARTITION BY record_id) AS f1, CASE WHEN trim(english, ' ') <> '' THEN min(seq) OVER (PARTITION BY lower(trim(english, ' '))) END AS f2 FROM raw_records) SELECT error, count(*) AS rows, min(seq) AS first FROM (SELECT seq, unnest([" + _GOLD + "]) AS error FROM x) WHERE error IS NOT NULL GROUP BY error")
def gold_rules(s, d):
    """five rules of a gold set; the first row of an id and of a source comes from aggregates."""
    r = _raw(s, d).withColumn("_s", F.md5(F.lower(F.trim("english"))))
    f1 = r.groupBy("record_id").agg(F.min("seq").alias("f1"))
    f2 = r.where("trim(english) <> ''").groupBy("_s").agg(F.min("seq").alias("f2"))
    x = r.join(f1, "record_id", "left").join(f2, "_s", "left")  # null ids repeat nothing
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    p = gates.problems((blank("english"), "blank source"), (blank("hinglish"), "blank target"), (F.col("seq") > F.col("f1"), "repeated id"), (F.col("seq") > F.col("f2"), "repeated source"), (F.col("hindi").isNull() & F.lower("hinglish").startswith("n"), "flag without note"))
    return x.select("seq", F.explode(p).alias("error")).groupBy("error").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))


@query("SELECT run_id, problem FROM (SELECT run_id, unnest([CASE WHEN seed IS NULL THEN 'no seed' END, CASE WHEN coalesce(trim(source), '') = '' THEN 'no source' END, CASE WHEN input_sha256 IS NULL OR NOT regexp_full_match(input_sha256, '[0-9a-f]{64}') THEN 'bad digest' END, CASE WHEN gate_passed IS NULL THEN 'no gate' WHEN gate_passed NOT IN (0, 1) THEN 'bad gate' END, CASE WHEN synthetic IS NULL OR synthetic NOT IN (0, 1) THEN 'bad kind' END, CASE WHEN elapsed_seconds IS NULL OR elapsed_seconds < 0 THEN 'bad time' END, CASE WHEN generated_at IS NULL THEN 'no start' END, CASE WHEN loaded_at < generated_at THEN 'loaded early' END, CASE WHEN epoch(loaded_at) - epoch(generated_at) > 86400 THEN 'loaded late' END]) AS problem FROM pipeline_runs) WHERE problem IS NOT NULL")
def run_contract(s, d):
    """every rule of a run record that does not hold."""
    c = F.col
    late = c("loaded_at").cast("timestamp").cast("double") - c("generated_at").cast("timestamp").cast("double")
    p = gates.problems(
        (c("seed").isNull(), "no seed"), (F.coalesce(F.trim("source"), F.lit("")) == "", "no source"), (c("input_sha256").isNull() | ~c("input_sha256").rlike(r"\A[0-9a-f]{64}\z"), "bad digest"),
        (c("gate_passed").isNull(), "no gate"), (~c("gate_passed").isin(0, 1), "bad gate"), (c("synthetic").isNull() | ~c("synthetic").isin(0, 1), "bad kind"),
        (c("elapsed_seconds").isNull() | (c("elapsed_seconds") < 0), "bad time"), (c("generated_at").isNull(), "no start"), (c("loaded_at") < c("generated_at"), "loaded early"), (late > 86400, "loaded late"),
    )
    return table(s, d, "pipeline_runs").select("run_id", F.explode(p).alias("problem"))


@query("WITH " + S_PREP + ", m AS (SELECT 'records' AS metric, count(*)::DOUBLE AS value FROM prep UNION ALL SELECT 'train_share', 100.0 * count(*) FILTER (WHERE split = 'train') / count(*) FROM prep UNION ALL SELECT 'splits', count(DISTINCT split) FROM prep), c(metric, printed, places) AS (VALUES ('train_share', '80.0', 1), ('splits', '3', 0), ('records', '4674', 0), ('lost', '1', 0)) "
       "SELECT c.metric, printed, CASE WHEN value IS NULL THEN 'missing' WHEN abs(round(value, places) - printed::DOUBLE) < 1e-9 THEN 'ok' ELSE 'differs' END AS status FROM c LEFT JOIN m USING (metric)")  # fmt: skip
def claims(s, d):
    """printed numbers against the values they were rounded from."""
    p = _prep(s, d).agg(F.count("*").cast("double").alias("records"), (100.0 * F.count(F.when(F.col("split") == "train", 1)) / F.count("*")).alias("train_share"), F.countDistinct("split").cast("double").alias("splits"))
    m = p.select(F.expr("stack(3, 'records', records, 'train_share', train_share, 'splits', splits) as (metric, value)"))
    c = s.createDataFrame([("train_share", "80.0", 1), ("splits", "3", 0), ("records", "4674", 0), ("lost", "1", 0)], "metric string, printed string, places int")
    rounded = F.when(F.col("places") == 1, F.round("value", 1)).otherwise(F.round("value", 0))
    status = F.when(F.col("value").isNull(), "missing").when(F.abs(rounded - F.col("printed").cast("double")) < 1e-9, "ok").otherwise("differs")
    return c.join(F.broadcast(m), "metric", "left").select("metric", "printed", status.alias("status"))


S_SPACED = "len(list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda w: w <> ''))"


@query("WITH " + S_PREP + ", x AS (SELECT split, english, CASE WHEN coalesce(trim(english), '') = '' OR coalesce(trim(hinglish), '') = '' THEN 'empty' WHEN greatest(" + S_SPACED.format("english") + ", " + S_SPACED.format("hinglish") + ") > 40 THEN 'too_long' ELSE 'kept' END AS fate FROM prep) SELECT split, count(*) AS records, count(*) FILTER (WHERE fate = 'empty') AS empty, count(*) FILTER (WHERE fate = 'too_long') AS too_long, count(*) FILTER (WHERE fate = 'kept') AS rows, count(DISTINCT english) FILTER (WHERE fate = 'kept') AS sources, round(count(*) FILTER (WHERE fate = 'kept')::DOUBLE / greatest(count(DISTINCT english) FILTER (WHERE fate = 'kept'), 1), 9) AS rows_per_source FROM x GROUP BY split")
def chat_report(s, d):
    """Rows dropped as empty or too long, and what each split keeps."""
    x = sinks.chat_fates(_prep(s, d), "english", "hinglish", 40)
    n = lambda v: F.count(F.when(F.col("fate") == v, 1))
    u = F.countDistinct(F.when(F.col("fate") == "kept", F.col("english")))
    return x.groupBy("split").agg(F.count("*").alias("records"), n("empty").alias("empty"), n("too_long").alias("too_long"), n("kept").alias("rows"), u.alias("sources"), F.round(n("kept") / F.greatest(u, F.lit(1)), 9).alias("rows_per_source"))


@query("WITH " + S_PREP + " SELECT seq, md5('{\"messages\":[{\"role\":\"system\",\"content\":\"Rewrite in Hinglish.\"},{\"role\":\"user\",\"content\":' || to_json(english)::VARCHAR || '},{\"role\":\"assistant\",\"content\":' || to_json(hinglish)::VARCHAR || '}]}') AS row_md5 FROM prep WHERE coalesce(trim(english), '') <> '' AND coalesce(trim(hinglish), '') <> '' AND greatest(" + S_SPACED.format("english") + ", " + S_SPACED.format("hinglish") + ") <= 40")
def chat_rows(s, d):
    """One chat-format JSON text per kept record."""
    x = sinks.chat_fates(_prep(s, d), "english", "hinglish", 40).where("fate = 'kept'")
    return x.select("seq", F.md5(sinks.chat_row("Rewrite in Hinglish.", F.col("english"), F.col("hinglish"))).alias("row_md5"))


_L = ", ".join(f"'{f}': '{k}'" for k, v in LEXICON.items() for f in v.split())
S_FOLDV = "regexp_replace(regexp_replace(regexp_replace({0}, 'aa+', 'a', 'g'), 'ee+|ii+', 'i', 'g'), 'oo+|uu+', 'u', 'g')"
S_EVAL = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s\\x{{0900}}-\\x{{097F}}]', ' ', 'g'), '\\s+', ' ', 'g'))"
S_LEXNORM = "array_to_string(list_transform(string_split(" + S_EVAL + ", ' '), lambda t: coalesce(mp[t], mp[" + S_FOLDV.format("t") + "], " + S_FOLDV.format("t") + ")), ' ')"


@query("WITH mm AS (SELECT MAP {" + _L + "} AS mp) SELECT seq, md5(" + S_LEXNORM.format("hinglish") + ") AS norm_md5 FROM prepared_records, mm")
def lexicon_normal(s, d):
    """Every word to its label, by its form or its folded form, else folded; the sentence rebuilt."""
    return _prep(s, d).select("seq", F.md5(T.lexicon_normal(T.fold_eval("hinglish"), _forms())).alias("norm_md5"))


def _forms() -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in LEXICON.items():
        for f in v.split():
            out.setdefault(f, k)
    return out


@query("WITH mm AS (SELECT MAP {" + _L + "} AS mp), r AS (SELECT " + S_KEY.format("english") + " AS k, min(seq) AS lead FROM prepared_records GROUP BY 1), x AS (SELECT " + S_EVAL.format("q.hinglish") + " AS a, " + S_EVAL.format("p.hinglish") + " AS b, " + S_LEXNORM.format("q.hinglish") + " AS na, " + S_LEXNORM.format("p.hinglish") + " AS nb FROM prepared_records p JOIN r ON " + S_KEY.format("p.english") + " = r.k JOIN prepared_records q ON q.seq = r.lead, mm WHERE p.seq <> r.lead) SELECT CASE WHEN a = b THEN 'same' WHEN na = nb THEN 'spelling' ELSE 'other' END AS category, count(*) AS pairs FROM x GROUP BY 1")
def disagreements(s, d):
    """Two renderings of a source compared after folding; 'spelling' where the lexicon makes them equal."""
    p = _prep(s, d).select("seq", F.md5(T.dedup_key("english")).alias("k"), T.fold_eval("hinglish").alias("f"))
    p = materialise(p.withColumn("n", T.lexicon_normal(F.col("f"), _forms())), "renderings")
    lead = p.groupBy("k").agg(F.min("seq").alias("lead"), F.min_by("f", "seq").alias("a"), F.min_by("n", "seq").alias("na"))
    x = p.join(lead, "k").where("seq <> lead")
    c = F.when(F.col("a") == F.col("f"), "same").when(F.col("na") == F.col("n"), "spelling").otherwise("other")
    return x.groupBy(c.alias("category")).agg(F.count("*").alias("pairs"))


@query("WITH " + S_LEX + ", n AS (SELECT label, form, " + S_FOLDV.format("form") + " AS f FROM lex), g AS (SELECT label, count(DISTINCT f) = 1 AS together FROM n GROUP BY label), w AS (SELECT lower(unnest(" + S_WORDS.format("hinglish") + ")) AS form FROM transformed_records), o AS (SELECT label, count(*) AS occurrences, count(*) FILTER (WHERE " + S_FOLDV.format("form") + " = " + S_FOLDV.format("label") + ") AS mapped FROM w JOIN lex USING (form) GROUP BY label) SELECT g.label, together, coalesce(occurrences, 0) AS occurrences, coalesce(mapped, 0) AS mapped FROM g LEFT JOIN o USING (label)")
def group_collapse(s, d):
    """Whether folding brings a group's forms together, and how many occurrences it maps to the label."""
    lex = _lexicon(s)
    g = lex.groupBy("label").agg((F.countDistinct(T.fold_vowels("form")) == 1).alias("together"))
    w = _exploded(table(s, d, "transformed_records"), "hinglish", "form").groupBy("form").agg(F.count("*").alias("n"))
    o = w.join(F.broadcast(lex), "form").groupBy("label").agg(F.sum("n").alias("occurrences"), F.sum(F.when(T.fold_vowels("form") == T.fold_vowels("label"), F.col("n")).otherwise(0)).alias("mapped"))
    return g.join(o, "label", "left").select("label", "together", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("mapped", F.lit(0)).alias("mapped"))


@query("WITH " + S_LEX + ", w AS (SELECT lower(unnest(" + S_WORDS.format("hinglish") + ")) AS form FROM transformed_records), c AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE form <> label) AS other FROM w JOIN lex USING (form) GROUP BY label), t AS (SELECT sum(n)::DOUBLE AS n, sum(other)::DOUBLE AS other, (SELECT count(*)::DOUBLE FROM w) AS words FROM c) SELECT label, c.n AS occurrences, row_number() OVER (ORDER BY c.n DESC, label) AS place, round(t.other / t.n, 9) AS non_canonical_overall, round(t.n / t.words, 9) AS covered FROM c, t ORDER BY c.n DESC, label LIMIT 15")
def variance_top(s, d):
    """The fifteen groups met most, with the shares over all groups."""
    w = _exploded(table(s, d, "transformed_records"), "hinglish", "form").groupBy("form").agg(F.count("*").alias("n"))
    w = materialise(w.join(F.broadcast(_lexicon(s)), "form", "left"), "forms")
    c = w.where("label is not null").groupBy("label").agg(F.sum("n").alias("occurrences"))
    in_, other = F.sum(F.when(F.col("label").isNotNull(), F.col("n"))), F.sum(F.when(F.col("label") != F.col("form"), F.col("n")).otherwise(0))
    t = w.agg(F.round(other / in_, 9).alias("non_canonical_overall"), F.round(in_ / F.sum("n"), 9).alias("covered"))
    place = F.row_number().over(W.orderBy(F.desc("occurrences"), "label"))  # fifteen rows
    return c.orderBy(F.desc("occurrences"), "label").limit(15).withColumn("place", place).crossJoin(F.broadcast(t))


@query("SELECT split, count(*) AS records, string_agg(seq::VARCHAR, ',' ORDER BY content, seq) AS first_ids FROM (SELECT split, seq, content, row_number() OVER (PARTITION BY split ORDER BY content, seq) AS n FROM (SELECT lower(trim(split)) AS split, seq, substr(sha256(" + S_KEY.format("english") + " || chr(9) || " + S_KEY.format("hinglish") + "), 1, 16) AS content FROM prepared_records)) WHERE n <= 5 GROUP BY split")
def first_by_content(s, d):
    """T4: the head of each split in the order of content ids, by a bounded aggregate."""
    p = _prep(s, d).select("split", "seq", T.content_id("english", "hinglish").alias("content")).withColumn("b", F.substring("content", 1, 2))
    few = p.withColumn("n", F.row_number().over(W.partitionBy("split", "b").orderBy("content", "seq"))).where("n <= 5")
    few = few.withColumn("n", F.row_number().over(W.partitionBy("split").orderBy("content", "seq"))).where("n <= 5")
    x = few.groupBy("split").agg(F.count("*").alias("records"), F.sort_array(F.collect_list(F.struct("content", "seq"))).alias("l"))
    return x.select("split", "records", F.array_join(F.transform("l", lambda v: v["seq"].cast("string")), ",").alias("first_ids"))


@query("SELECT column_name, changed, example FROM (SELECT 'english' AS column_name, count(*) FILTER (WHERE english <> " + S_NORM.format("english") + ") AS changed, min(seq) FILTER (WHERE english <> " + S_NORM.format("english") + ") AS example FROM raw_records UNION ALL SELECT 'hinglish', count(*) FILTER (WHERE hinglish <> " + S_NORM.format("hinglish") + "), min(seq) FILTER (WHERE hinglish <> " + S_NORM.format("hinglish") + ") FROM raw_records)")
def normalisation_impact(s, d):
    """Cells that normalisation changes, by column, and the first of them."""
    ch = lambda c: F.when(F.col(c) != T.normalise(c), F.col("seq"))
    a = _raw(s, d).agg(*[f(ch(c)).alias(f"{c}_{n}") for c in ("english", "hinglish") for n, f in (("n", F.count), ("first", F.min))])
    return a.select(F.expr("stack(2, 'english', english_n, english_first, 'hinglish', hinglish_n, hinglish_first) as (column_name, changed, example)"))


@query("WITH " + S_PREP + ", p AS (SELECT *, " + S_KEY.format("english") + " AS k1, " + S_KEY.format("hinglish") + " AS k2, len(" + S_WORDS.format("english") + ") AS e, len(" + S_WORDS.format("hinglish") + ") AS h, " + S_SCRIPT.format("hinglish") + " AS sf FROM prep), "
       "c AS (SELECT bool_and(k1 <> '' AND k2 <> '') AS no_blank, bool_and(sf <= 0.2) AS romanised, bool_and(k1 <> k2) AS translated, bool_and(least(e, h) >= 2 AND greatest(e, h) <= 60) AS lengths, count(*) = count(DISTINCT k1 || chr(9) || k2) AS unique_pairs, bool_and(split IN ('train', 'dev', 'test')) AS splits_known FROM p) SELECT name, passed FROM c UNPIVOT (passed FOR name IN (no_blank, romanised, translated, lengths, unique_pairs, splits_known))")  # fmt: skip
def post_clean_panel(s, d):
    """Six checks of the prepared rows in one aggregate; :func:`gates.halt` stops on one that fails."""
    p = _prep(s, d).select("split", T.dedup_key("english").alias("k1"), T.dedup_key("hinglish").alias("k2"), F.size(T.word_tokens("english")).alias("e"), F.size(T.word_tokens("hinglish")).alias("h"), T.script_fraction("hinglish").alias("sf"))
    u = p.groupBy(F.md5(F.concat_ws("\t", "k1", "k2")).alias("k")).agg(
        F.count("*").alias("n"), F.bool_and((F.col("k1") != "") & (F.col("k2") != "")).alias("no_blank"), F.bool_and(F.col("sf") <= 0.2).alias("romanised"), F.bool_and(F.col("k1") != F.col("k2")).alias("translated"),
        F.bool_and((F.least("e", "h") >= 2) & (F.greatest("e", "h") <= 60)).alias("lengths"), F.bool_and(F.col("split").isin("train", "dev", "test")).alias("splits_known"),
    )
    names = ["no_blank", "romanised", "translated", "lengths", "splits_known"]
    a = u.agg((F.max("n") == 1).alias("unique_pairs"), *[F.bool_and(c).alias(c) for c in names])
    return a.select(F.expr("stack(6, " + ", ".join(f"'{c}', {c}" for c in [*names, "unique_pairs"]) + ") as (name, passed)"))


@query("WITH " + S_LANG + ", " + S_SPANS + ", tg AS (SELECT sum(len(list_filter(tags, lambda x: x <> 'other')))::DOUBLE AS part FROM g), z AS (SELECT stddev_pop(n) AS sd, avg(n) AS mu FROM sp) "
       "SELECT count(*) AS n_sentences, round(sum(a + b) / any_value(part), 4) AS tagger_coverage, round(avg(cmi), 2) AS cmi_mean_all, round(avg(cmi) FILTER (WHERE cmi > 0), 2) AS cmi_mean_mixed_only, round(avg(CASE WHEN cmi > 0 THEN 1.0 ELSE 0.0 END), 4) AS frac_sentences_mixed, round(sum(sw)::DOUBLE / sum(greatest(nl - 1, 0)), 4) AS switch_point_fraction, round(avg(spf), 4) AS spf_mean_per_sentence, sum(sw)::BIGINT AS n_switch_points, round(sum(sw)::DOUBLE / greatest(sum(nl) - count(*), 1), 4) AS spf_over_sentences, "
       "round((1 - (sum(a)::DOUBLE * sum(a) + sum(b)::DOUBLE * sum(b)) / (sum(nl)::DOUBLE * sum(nl))) / ((sum(a)::DOUBLE * sum(a) + sum(b)::DOUBLE * sum(b)) / (sum(nl)::DOUBLE * sum(nl))), 3) AS m_index, round(any_value((sd - mu) / (sd + mu)), 4) AS burstiness, round(any_value(mu), 2) AS mean_span_length FROM g, tg, z")  # fmt: skip
def codemix_summary(s, d):
    """A2, A3: the twelve figures over all sentences; A3's other denominator is spf_over_sentences."""
    return codemix.corpus_summary(_tagged(s, d), "tags")


@query("WITH " + S_PREP + ", " + S_LANG + ", q AS (SELECT p.split, p.english, p.hinglish, p.group_id, g.cmi, g.sw, g.nl FROM prep p LEFT JOIN (SELECT record_id, max(cmi) AS cmi, max(sw) AS sw, max(nl) AS nl FROM g GROUP BY record_id) g USING (record_id)), r AS (SELECT *, len(" + S_WORDS.format("english") + ") AS ew, len(" + S_WORDS.format("hinglish") + ") AS hw, " + S_SCRIPT.format("hinglish") + " AS sf FROM q) "
       "SELECT split, count(*) AS records, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share, count(DISTINCT english) AS sources, round(count(*)::DOUBLE / count(DISTINCT english), 9) AS refs_per_source, count(DISTINCT group_id) AS groups, avg(ew) AS english_words, avg(hw) AS hinglish_words, median(hw)::DOUBLE AS median_words, round(avg(cmi), 6) AS cmi, round(avg(CASE WHEN cmi > 0 THEN 1.0 WHEN cmi = 0 THEN 0.0 END), 6) AS mixed, round(sum(sw)::DOUBLE / sum(greatest(nl - 1, 0)), 6) AS spf, round(avg(sf), 9) AS script FROM r GROUP BY split")  # fmt: skip
def split_balance(s, d):
    """Thirteen figures of each split."""
    t = F.col("tags")
    g = _tagged(s, d).select("record_id", codemix.cmi(t).alias("cmi"), codemix.switches(t).alias("sw"), F.size(F.filter(t, lambda x: x.isin("lang1", "lang2"))).alias("nl")).groupBy("record_id").agg(*[F.max(c).alias(c) for c in ("cmi", "sw", "nl")])
    r = _prep(s, d).join(g, "record_id", "left").withColumn("ew", F.size(T.word_tokens("english"))).withColumn("hw", F.size(T.word_tokens("hinglish"))).withColumn("sf", T.script_fraction("hinglish"))
    a = r.groupBy("split").agg(
        F.count("*").alias("records"), F.countDistinct("english").alias("sources"), F.countDistinct("group_id").alias("groups"), F.avg("ew").alias("english_words"), F.avg("hw").alias("hinglish_words"), F.median("hw").alias("median_words"),
        F.round(F.avg("cmi"), 6).alias("cmi"), F.round(F.avg(F.when(F.col("cmi") > 0, 1.0).when(F.col("cmi") == 0, 0.0)), 6).alias("mixed"), F.round(F.sum("sw") / F.sum(F.greatest(F.col("nl") - 1, F.lit(0))), 6).alias("spf"), F.round(F.avg("sf"), 9).alias("script"),
    )
    share = F.round(F.col("records") / F.sum("records").over(W.partitionBy()), 9)  # three rows
    return a.withColumn("share", share).withColumn("refs_per_source", F.round(F.col("records") / F.col("sources"), 9))


@query("WITH c AS (SELECT " + S_KEY.format("english") + " AS k, list(coalesce(hinglish, '')) AS l FROM prepared_records GROUP BY 1), x AS (SELECT len(l) AS n, len(list_distinct(l)) AS u, len(list_filter(l, lambda v: trim(v) = '')) AS blank FROM c) SELECT n AS list_length, count(*) AS sources, count(*) FILTER (WHERE u < n) AS with_repeats, sum(n - u)::BIGINT AS repeats, count(*) FILTER (WHERE blank > 0) AS with_blanks FROM x GROUP BY n")
def reference_audit(s, d):
    """Lengths of reference lists, repeats and blanks in them; a source's renderings are counted, never gathered."""
    p = _prep(s, d).groupBy(F.md5(T.dedup_key("english")).alias("k"), F.md5(F.coalesce("hinglish", F.lit(""))).alias("r")).agg(F.count("*").alias("m"), F.max((F.trim(F.coalesce("hinglish", F.lit(""))) == "").cast("int")).alias("blank"))
    x = p.groupBy("k").agg(F.sum("m").alias("n"), F.count("*").alias("u"), F.max("blank").alias("blank"))
    return x.groupBy(F.col("n").alias("list_length")).agg(F.count("*").alias("sources"), F.count(F.when(F.col("u") < F.col("n"), 1)).alias("with_repeats"), F.sum(F.col("n") - F.col("u")).alias("repeats"), F.sum("blank").alias("with_blanks"))


@query("WITH " + S_LANG + ", t AS (SELECT run_id, unnest(tags) AS tag FROM g), c AS (SELECT run_id, tag, count(*)::DOUBLE AS n FROM t WHERE tag NOT IN ('other', 'unk') GROUP BY ALL) SELECT run_id, count(*) AS languages, sum(n)::BIGINT AS words, round(CASE WHEN count(*) > 1 THEN (1 - sum(n * n) / (sum(n) * sum(n))) / ((count(*) - 1) * (sum(n * n) / (sum(n) * sum(n)))) ELSE 0.0 END, 9) AS m_index FROM c GROUP BY run_id".replace(", t AS (SELECT run_id, unnest", ", tt AS (SELECT run_id, unnest").replace("FROM t WHERE tag", "FROM tt WHERE tag"))
def inventory_mixing(s, d):
    """The multilingual index over a wider inventory of tags, neutral ones left out."""
    g = codemix.inventory_m_index(_tagged(s, d), "tags", ["other", "unk"], "run_id")
    return g.withColumn("m_index", F.round("m_index", 9))


@query("WITH x AS (SELECT source, english, hindi, hinglish FROM raw_records JOIN pipeline_runs USING (run_id)) SELECT source, count(*) AS rows, count(*) FILTER (WHERE coalesce(trim(hindi, ' '), '') <> '') AS with_hindi, count(*) FILTER (WHERE coalesce(trim(hinglish, ' '), '') <> '') AS with_hinglish, avg(CASE WHEN coalesce(trim(english, ' '), '') <> '' THEN length(english) END)::DOUBLE AS english_chars, avg(CASE WHEN coalesce(trim(hinglish, ' '), '') <> '' THEN length(hinglish) END)::DOUBLE AS hinglish_chars, count(DISTINCT english) AS sources FROM x GROUP BY source")
def corpus_profile(s, d):
    """Each corpus's rows, filled sides and their mean lengths."""
    x = _raw(s, d).join(F.broadcast(table(s, d, "pipeline_runs").select("run_id", "source")), "run_id")
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return x.groupBy("source").agg(F.count("*").alias("rows"), F.count(F.when(has("hindi"), 1)).alias("with_hindi"), F.count(F.when(has("hinglish"), 1)).alias("with_hinglish"), F.avg(F.when(has("english"), F.length("english"))).alias("english_chars"), F.avg(F.when(has("hinglish"), F.length("hinglish"))).alias("hinglish_chars"), F.countDistinct("english").alias("sources"))


@query("WITH " + S_PREP + ", x AS (SELECT split, seq, length(coalesce(hinglish, '')) AS n, count(*) OVER (PARTITION BY group_id) * (group_id IS NOT NULL)::INT AS g FROM prep) SELECT split, arg_max(seq, (n, -seq)) AS longest, arg_min(seq, (n, seq)) AS shortest, arg_max(seq, (g, -seq)) AS of_biggest_group FROM x GROUP BY split")
def notable_records(s, d):
    """The longest, the shortest and one of the biggest group, ties to the first."""
    p = _prep(s, d)
    g = p.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("g"))
    x = p.join(g, "group_id", "left").withColumn("n", F.length(F.coalesce("hinglish", F.lit("")))).withColumn("g", F.coalesce("g", F.lit(0)))
    return x.groupBy("split").agg(F.max_by("seq", F.struct("n", -F.col("seq"))).alias("longest"), F.min_by("seq", F.struct("n", "seq")).alias("shortest"), F.max_by("seq", F.struct("g", -F.col("seq"))).alias("of_biggest_group"))


@query("WITH c AS (SELECT event_type, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS it, round(avg(value), 9) AS loss FROM events GROUP BY ALL), l AS (SELECT *, lag(loss) OVER (PARTITION BY event_type ORDER BY it) AS before, row_number() OVER (PARTITION BY event_type ORDER BY it DESC) AS back FROM c), b AS (SELECT event_type, arg_min(it, (loss, it)) AS best_iter, min(loss) AS best, arg_max(loss, it) AS last, coalesce(bool_and(loss > before) FILTER (WHERE back <= 3), false) AS diverged FROM l GROUP BY event_type) SELECT event_type, best_iter::INT AS best_iter, diverged, last > best * 1.05 AS overfit, (best_iter // 5 * 5)::INT AS checkpoint FROM b")
def curve_advice(s, d):
    """Whether a curve of daily means rises over its last three points, is past its best by a margin, and the last checkpoint (every five) at or before the best."""
    e = table(s, d, "events")
    first = e.agg(F.min(F.to_date("ts")).alias("first"))
    c = e.crossJoin(F.broadcast(first)).groupBy("event_type", F.datediff(F.to_date("ts"), "first").alias("it")).agg(F.round(F.avg("value"), 9).alias("loss"))
    w = W.partitionBy("event_type")  # a row per day
    c = c.withColumn("before", F.lag("loss").over(w.orderBy("it"))).withColumn("back", F.row_number().over(w.orderBy(F.desc("it"))))
    g = c.groupBy("event_type").agg(F.min_by("it", F.struct("loss", "it")).alias("best_iter"), F.min("loss").alias("best"), F.max_by("loss", "it").alias("last"), F.coalesce(F.bool_and(F.when(F.col("back") <= 3, F.col("loss") > F.col("before"))), F.lit(False)).alias("diverged"))
    return g.select("event_type", "best_iter", "diverged", (F.col("last") > F.col("best") * 1.05).alias("overfit"), (F.floor(F.col("best_iter") / 5) * 5).cast("int").alias("checkpoint"))


@query("WITH " + S_PREP + " SELECT run_id, md5(" + S_KEY.format("english") + ") AS source, min(seq) AS first_seq, count(*) AS renderings FROM prep WHERE split <> 'train' GROUP BY ALL")
def first_seen(s, d):
    """Where each source of a run is seen first, outside train."""
    p = _prep(s, d).where("split <> 'train'")
    return p.groupBy("run_id", F.md5(T.dedup_key("english")).alias("source")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("renderings"))


@query("WITH " + _SETS + ", un AS (SELECT id FROM sets WHERE splits NOT LIKE '%train%'), bm AS (SELECT u.id, max(jaccard) AS best FROM un u JOIN near ON u.id IN (near.a, near.b) JOIN sets o ON o.id = CASE WHEN near.a = u.id THEN near.b ELSE near.a END WHERE o.splits LIKE '%train%' GROUP BY u.id) SELECT un.id, round(bm.best, 9) AS best FROM un LEFT JOIN bm USING (id)")
def best_near_match(s, d):
    """Keys outside train with no equal there, and the best near one of train, from the similarity join instead of all pairs."""
    sets = materialise(gates.split_sets(_prep(s, d), "english", "split"), "sets")
    keys = sets.where("key <> ''").select("id", "key", F.when(F.col("splits").contains("train"), 1).otherwise(2).alias("side"))
    p = neardup.near_pairs(materialise(keys, "keys"), across=True)
    out = sets.where(~F.col("splits").contains("train")).select("id")
    both = p.select(F.col("a").alias("id"), "jaccard").unionAll(p.select(F.col("b").alias("id"), "jaccard")).groupBy("id").agg(F.round(F.max("jaccard"), 9).alias("best"))
    return out.join(both, "id", "left")


_PAT = {"tags": "[A-Z]{1,3}-[0-9]+", "latin": "[a-zA-Z]{3,}", "digits": "[0-9]+"}


@query("WITH x AS (SELECT run_id, " + ", ".join(f"list_distinct(list_transform(regexp_extract_all(coalesce(english, ''), '{v}'), lambda t: lower(t))) AS a_{k}, list_distinct(list_transform(regexp_extract_all(coalesce(hinglish, ''), '{v}'), lambda t: lower(t))) AS b_{k}" for k, v in _PAT.items()) + " FROM raw_records) SELECT run_id, " + ", ".join(f"round(avg(CASE WHEN len(a_{k}) > 0 THEN len(list_intersect(a_{k}, b_{k}))::DOUBLE / len(a_{k}) END), 9) AS {k}_kept" for k in _PAT) + ", avg(CASE WHEN len(list_filter(b_tags, lambda t: NOT list_contains(a_tags, t))) > 0 THEN 1.0 ELSE 0.0 END) AS invented_tags FROM x GROUP BY run_id")
def pattern_overlap(s, d):
    """Share of codes, Latin words and numbers of the source kept, and codes it never had."""
    of = lambda c, v: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(v), F.lit(0)), F.lower))
    x = _raw(s, d).select("run_id", *[of(c, v).alias(f"{n}_{k}") for k, v in _PAT.items() for c, n in (("english", "a"), ("hinglish", "b"))])
    kept = [F.round(F.avg(F.when(F.size(f"a_{k}") > 0, F.size(F.array_intersect(f"a_{k}", f"b_{k}")) / F.size(f"a_{k}"))), 9).alias(f"{k}_kept") for k in _PAT]
    return x.groupBy("run_id").agg(*kept, F.avg(F.when(F.size(F.array_except("b_tags", "a_tags")) > 0, 1.0).otherwise(0.0)).alias("invented_tags"))


@query("SELECT split, round(avg(CASE WHEN r.excess > 0 THEN 1.0 ELSE 0.0 END), 9) AS repeated, round(sum(o.inversions)::DOUBLE / sum(o.pairs), 9) AS inverted FROM (" + "SELECT seq, lower(trim(split)) AS split FROM prepared_records" + ") p LEFT JOIN (" + corpus.SQL["repeated_tokens"] + ") r USING (seq) LEFT JOIN (" + corpus.SQL["order_inversions"] + ") o USING (seq) GROUP BY split")
def batch_quality(s, d):
    """Shares of defects of a batch: rows with repeated tokens, shared words out of order."""
    p = _prep(s, d).select("seq", "split").join(corpus.repeated_tokens(s, d), "seq", "left").join(corpus.order_inversions(s, d), "seq", "left")
    return p.groupBy("split").agg(F.round(F.avg(F.when(F.col("excess") > 0, 1.0).otherwise(0.0)), 9).alias("repeated"), F.round(F.sum("inversions") / F.sum("pairs"), 9).alias("inverted"))
