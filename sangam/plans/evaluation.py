"""Evaluation of systems against several references: best references, bootstrap, ladder, ceilings, sheets.

The renderings of a test source, in the order of their seq, stand for three systems (the
first three) and their references (all others).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sangam.functions import text as T
from sangam.operators import clean, codemix, metrics, resampling
from sangam.plans.corpus import S_KEY, S_LANG, S_NORM, S_PREP, S_ROUTED, S_SPANS, S_WORDS, _prep, _raw, _tagged
from sangam.plans.gates import S_EVAL, S_FOLDV
from sangam.plans.reports import _LATEST, _RATED, _latest, _ratings, _runs
from sangam.session import materialise, table

Q: dict = {}
SQL: dict[str, str] = {}
SAMPLES = 100


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ASCII = "regexp_replace({0}, '[^\\x00-\\x7F]', '?', 'g')"
S_ITEMS = (
    "it AS (SELECT seq, md5(" + S_KEY.format("english") + ") AS k, " + _ASCII.format(S_EVAL.format("hinglish")) + " AS f FROM prepared_records WHERE lower(trim(split)) = 'test'), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS r, count(*) OVER (PARTITION BY k) AS n FROM it), "
    "hy AS (SELECT k, 'm' || (r - 1) AS system, f AS hyp FROM rk WHERE r <= 3 AND n >= 4), rf AS (SELECT k, seq, f AS ref FROM rk WHERE r > 3 AND f <> ''), "
    "pr AS (SELECT k, system, seq, levenshtein(hyp, ref) AS edits, length(ref) AS chars, hyp, ref FROM hy JOIN rf USING (k)), "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, system ORDER BY round(edits::DOUBLE / chars, 9), seq) AS place FROM pr) WHERE place = 1)"
)


def _pairs(s, d):
    """(k, system, seq, edits, chars, hyp, ref): every hypothesis beside every reference of its source."""
    p = _prep(s, d).where("split = 'test'").select("seq", F.md5(T.dedup_key("english")).alias("k"), F.regexp_replace(T.fold_eval("hinglish"), r"[^\x00-\x7F]", "?").alias("f"))
    p = materialise(p, "renderings")
    top = resampling.first_ranks(p, "k", "seq", 3)
    third = top.where("r = 3").select("k", F.col("seq").alias("last"))
    many = p.groupBy("k").agg(F.count("*").alias("n")).where("n >= 4").select("k")
    hyps = top.join(many, "k").join(third, "k").select("k", F.concat(F.lit("m"), (F.col("r") - 1).cast("string")).alias("system"), F.col("f").alias("hyp"), "last")
    pr = hyps.join(p.where("f <> ''").select("k", "seq", F.col("f").alias("ref")), "k").where("seq > last")
    return pr.select("k", "system", "seq", F.levenshtein("hyp", "ref").alias("edits"), F.length("ref").alias("chars"), "hyp", "ref")


def _best(s, d):
    """The reference each hypothesis comes nearest to by its own rate; the first of equals."""
    x = F.struct(F.round(F.col("edits") / F.col("chars"), 9).alias("rate"), "seq", "edits", "chars", "hyp", "ref")
    return _pairs(s, d).groupBy("k", "system").agg(F.min(x).alias("x")).select("k", "system", "x.seq", "x.edits", "x.chars", "x.hyp", "x.ref")


@query("WITH " + S_ITEMS + " SELECT k, system, seq, edits::INT AS edits, chars FROM best")
def best_references(s, d):
    """The best reference of each hypothesis; empty references are skipped."""
    return _best(s, d).select("k", "system", "seq", "edits", "chars")


_V = S_FOLDV.format("hyp"), S_FOLDV.format("ref")


@query("WITH " + S_ITEMS + " SELECT system, count(*) AS items, sum(edits)::DOUBLE / sum(chars) AS rate, sum(levenshtein(" + _V[0] + ", " + _V[1] + "))::DOUBLE / sum(length(" + _V[1] + ")) AS folded_rate, 100 * (sum(edits)::DOUBLE / sum(chars) - sum(levenshtein(" + _V[0] + ", " + _V[1] + "))::DOUBLE / sum(length(" + _V[1] + "))) AS spelling_gap, sum(edits)::DOUBLE / sum(strlen(hyp)) AS per_byte FROM best GROUP BY system")
def system_scores(s, d):
    """Error rates as ratios of sums, the part of them that is spelling, and edits by byte."""
    v, w = T.fold_vowels("hyp"), T.fold_vowels("ref")
    a, b = F.sum("edits") / F.sum("chars"), F.sum(F.levenshtein(v, w)) / F.sum(F.length(w))
    return _best(s, d).groupBy("system").agg(F.count("*").alias("items"), a.alias("rate"), b.alias("folded_rate"), (100 * (a - b)).alias("spelling_gap"), (F.sum("edits") / F.sum(F.octet_length("hyp"))).alias("per_byte"))


@query("WITH " + S_ITEMS + ", m AS (SELECT system, regexp_matches(hyp, '\\b(the|of|and|to|for|with|from|is|was)\\b') AS mixed, edits::DOUBLE / chars AS rate FROM best) SELECT system, count(*) FILTER (WHERE mixed) AS mixed_items, round(100 * (avg(1 - rate) FILTER (WHERE NOT mixed) - avg(1 - rate) FILTER (WHERE mixed)), 9) AS penalty FROM m GROUP BY system")
def switching_penalty(s, d):
    """Score on outputs without English function words less that on outputs with some."""
    m = _best(s, d).select("system", F.col("hyp").rlike(r"\b(the|of|and|to|for|with|from|is|was)\b").alias("mixed"), (1 - F.col("edits") / F.col("chars")).alias("score"))
    return m.groupBy("system").agg(F.count(F.when(F.col("mixed"), 1)).alias("mixed_items"), F.round(100 * (F.avg(F.when(~F.col("mixed"), F.col("score"))) - F.avg(F.when(F.col("mixed"), F.col("score")))), 9).alias("penalty"))


@query("WITH " + S_ITEMS + ", g AS (SELECT system, sum(edits)::DOUBLE / sum(chars) AS got FROM best GROUP BY system), p(system, published) AS (VALUES ('m0', 0.45), ('m1', 0.5), ('m9', 0.633)) SELECT p.system, published, round(got, 9) AS got, coalesce(abs(got - published) <= 0.1, false) AS passed FROM p LEFT JOIN g USING (system)")
def baseline_check(s, d):
    """Published figures against ours, within a tolerance; one we lack does not pass."""
    g = _best(s, d).groupBy("system").agg((F.sum("edits") / F.sum("chars")).alias("got"))
    p = s.createDataFrame([("m0", 0.45), ("m1", 0.5), ("m9", 0.633)], "system string, published double")
    return p.join(F.broadcast(g), "system", "left").select("system", "published", F.round("got", 9).alias("got"), F.coalesce(F.abs(F.col("got") - F.col("published")) <= 0.1, F.lit(False)).alias("passed"))


_SPLIT = "list_filter(string_split({0}, ' '), lambda w: w <> '')"


@query(
    "WITH " + S_ITEMS + ", hw AS (SELECT k, system, any_value(" + _SPLIT.format("hyp") + ") AS h FROM pr GROUP BY ALL), ln AS (SELECT pr.k, pr.system, min(abs(len(h) - len(" + _SPLIT.format("ref") + ")) * 100000 + len(" + _SPLIT.format("ref") + ")) % 100000 AS l FROM pr JOIN hw USING (k, system) GROUP BY ALL), "
    "hg AS (SELECT k, system, n, array_to_string(h[i::INT:(i + n - 1)::INT], ' ') AS gram FROM hw, range(1, 5) a(n), range(1, len(h) - n + 2) b(i)), hc AS (SELECT k, system, n, gram, count(*) AS c FROM hg GROUP BY ALL), "
    "rw AS (SELECT DISTINCT k, seq, " + _SPLIT.format("ref") + " AS r FROM pr), rg AS (SELECT k, seq, n, array_to_string(r[i::INT:(i + n - 1)::INT], ' ') AS gram FROM rw, range(1, 5) a(n), range(1, len(r) - n + 2) b(i)), rc AS (SELECT k, n, gram, max(c) AS m FROM (SELECT k, seq, n, gram, count(*) AS c FROM rg GROUP BY ALL) GROUP BY ALL), "
    "t AS (SELECT system, n, sum(least(c, coalesce(m, 0)))::DOUBLE AS hit, sum(c)::DOUBLE AS tot FROM hc LEFT JOIN rc USING (k, n, gram) GROUP BY ALL), lt AS (SELECT system, sum(len(h)) AS hyp_words, sum(l) AS ref_words FROM hw JOIN ln USING (k, system) GROUP BY system), "
    "o AS (SELECT *, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY system ORDER BY n) AS halves FROM t) "
    "SELECT system, hyp_words::BIGINT AS hyp_words, ref_words::BIGINT AS ref_words, round(100 * exp(least(0, 1 - ref_words::DOUBLE / hyp_words) + sum(CASE WHEN hit > 0 THEN ln(hit / tot) ELSE -halves * ln(2) - ln(tot) END) / 4), 9) AS bleu FROM o JOIN lt USING (system) GROUP BY system, hyp_words, ref_words"
)
def system_bleu(s, d):
    """BLEU of each system against all references, counts clipped by the most any has, the closest length."""
    x = metrics.multi_reference_bleu(_pairs(s, d).withColumn("pos", F.col("seq")), "system", "k")
    return x.select("system", "hyp_words", F.col("ref_words").cast("long").alias("ref_words"), F.round("bleu", 9).alias("bleu"))


@query()
def system_metrics(s, d):
    """chrF++, ROUGE-L and word error rate of each system, each by its own best reference."""
    return metrics.multi_reference_scores(_pairs(s, d).withColumn("pos", F.col("seq")), "system", "k")


_IX = "nn AS (SELECT count(*) AS n FROM st), ix AS (SELECT b.range AS b, ('0x' || substr(md5(b.range || '|' || j.range), 1, 8))::BIGINT % n AS i FROM range(100) b, nn, range(0, (SELECT n FROM nn)) j)"
_STATS = S_ITEMS + ", pv AS (SELECT k, max(CASE WHEN system = 'm0' THEN edits END)::DOUBLE AS e0, max(CASE WHEN system = 'm0' THEN chars END)::DOUBLE AS c0, max(CASE WHEN system = 'm1' THEN edits END)::DOUBLE AS e1, max(CASE WHEN system = 'm1' THEN chars END)::DOUBLE AS c1, max(CASE WHEN system = 'm2' THEN edits END)::DOUBLE AS e2, max(CASE WHEN system = 'm2' THEN chars END)::DOUBLE AS c2 FROM best GROUP BY k), st AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM pv), " + _IX
_REPS = _STATS + ", rep AS (SELECT b, sum(e0) / sum(c0) AS s0, sum(e1) / sum(c1) AS s1, sum(e2) / sum(c2) AS s2, avg(e0 / c0 - e1 / c1) AS d01 FROM ix JOIN st USING (i) GROUP BY b)"


def _items(s, d):
    """(i, e0, c0, e1, c1, e2, c2): numbered test items with each system's additive statistics."""
    b = _best(s, d)
    p = b.groupBy("k").agg(*[F.max(F.when(F.col("system") == f"m{n}", F.col(c))).cast("double").alias(f"{c[0]}{n}") for n in range(3) for c in ("edits", "chars")])
    return materialise(resampling.numbered(p, "k"), "items")


def _replicates(s, d):
    x = resampling.resampled(_items(s, d), SAMPLES)
    r = lambda n: F.sum(f"e{n}") / F.sum(f"c{n}")
    return x.groupBy("b").agg(*[r(n).alias(f"s{n}") for n in range(3)], F.avg(F.col("e0") / F.col("c0") - F.col("e1") / F.col("c1")).alias("d01"))


def _q(c: str, p: float):
    return F.round(F.percentile(c, F.lit(p)), 9)


@query("WITH " + _REPS + " SELECT round(quantile_cont(s0, 0.025), 9) AS low0, round(quantile_cont(s0, 0.975), 9) AS high0, round(quantile_cont(s0 - s1, 0.025), 9) AS low, round(quantile_cont(s0 - s1, 0.975), 9) AS high, avg(CASE WHEN s0 - s1 >= 0 THEN 1.0 ELSE 0.0 END) AS p FROM rep")
def paired_bootstrap(s, d):
    """Intervals of one system and of the difference of two over the same resampled items; for an error rate the sign is turned."""
    r = _replicates(s, d).withColumn("diff", F.col("s0") - F.col("s1"))
    return r.agg(_q("s0", 0.025).alias("low0"), _q("s0", 0.975).alias("high0"), _q("diff", 0.025).alias("low"), _q("diff", 0.975).alias("high"), F.avg(F.when(F.col("diff") >= 0, 1.0).otherwise(0.0)).alias("p"))


@query("WITH " + _REPS + ", l AS (SELECT list(round(d01, 9) ORDER BY d01) AS v FROM rep) SELECT v[1 + floor(0.025 * 100)::INT] AS low, v[1 + floor(0.975 * 100)::INT] AS high FROM l")
def paired_difference(s, d):
    """Mean difference by item, with percentiles by floor index."""
    v = F.sort_array(F.collect_list(F.round("d01", 9)))  # one value for each of the samples
    return _replicates(s, d).agg(v.alias("v")).select(F.element_at("v", 1 + int(0.025 * SAMPLES)).alias("low"), F.element_at("v", 1 + int(0.975 * SAMPLES)).alias("high"))


@query("WITH " + _REPS + ", t AS (SELECT sum(e0) / sum(c0) AS t0, sum(e1) / sum(c1) AS t1, sum(e2) / sum(c2) AS t2 FROM st), x AS (SELECT 'm1' AS system, 'm0' AS vs, t1 - t0 AS diff, (SELECT quantile_cont(s1 - s0, 0.025) FROM rep) AS low, (SELECT quantile_cont(s1 - s0, 0.975) FROM rep) AS high FROM t UNION ALL SELECT 'm2', 'm1', t2 - t1, (SELECT quantile_cont(s2 - s1, 0.025) FROM rep), (SELECT quantile_cont(s2 - s1, 0.975) FROM rep) FROM t) "
       "SELECT system, vs, round(diff, 9) AS diff, round(low, 9) AS low, round(high, 9) AS high, CASE WHEN high < 0 AND -diff > 0.01 THEN 'improvement' WHEN low > 0 AND diff > 0.01 THEN 'worse' ELSE 'null' END AS verdict FROM x")  # fmt: skip
def ladder(s, d):
    """Each rung against the one below: difference, its interval, verdict beyond a threshold; lower rates are better."""
    items = _items(s, d)
    tot = items.agg(*[(F.sum(f"e{n}") / F.sum(f"c{n}")).alias(f"t{n}") for n in range(3)])
    x = resampling.resampled(items, SAMPLES).groupBy("b").agg(*[(F.sum(f"e{n}") / F.sum(f"c{n}")).alias(f"s{n}") for n in range(3)])
    r = x.agg(*[F.percentile(F.col(f"s{n}") - F.col(f"s{n - 1}"), F.lit(p)).alias(f"{w}{n}") for n in (1, 2) for w, p in (("low", 0.025), ("high", 0.975))]).crossJoin(tot)  # one row each
    one = F.explode(F.array(*[F.struct(F.lit(f"m{n}").alias("system"), F.lit(f"m{n - 1}").alias("vs"), (F.col(f"t{n}") - F.col(f"t{n - 1}")).alias("diff"), F.col(f"low{n}").alias("low"), F.col(f"high{n}").alias("high")) for n in (1, 2)]))
    v = r.select(one.alias("x")).select("x.*")
    c = F.col
    verdict = F.when((c("high") < 0) & (-c("diff") > 0.01), "improvement").when((c("low") > 0) & (c("diff") > 0.01), "worse").otherwise("null")
    return v.select("system", "vs", F.round("diff", 9).alias("diff"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), verdict.alias("verdict"))


@query("WITH " + S_ITEMS + ", tw AS (SELECT k, max(CASE WHEN r = 1 THEN f END) AS a, max(CASE WHEN r = 2 THEN f END) AS b FROM rk WHERE n >= 2 AND r <= 2 GROUP BY k HAVING min(f) FILTER (WHERE r <= 2) <> ''), pv AS (SELECT k, 1 - levenshtein(a, b)::DOUBLE / length(b) AS x, 1 - levenshtein(a, b)::DOUBLE / length(a) AS y FROM tw), st AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM pv), " + _IX + ", rep AS (SELECT b, avg((x + y) / 2) AS m FROM ix JOIN st USING (i) GROUP BY b) SELECT (SELECT round(avg(x), 9) FROM st) AS one_way, (SELECT round(avg(y), 9) FROM st) AS other_way, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM rep")
def human_ceiling(s, d):
    """Two people's renderings scored against each other in both directions, with an interval."""
    p = _prep(s, d).where("split = 'test'").select("seq", F.md5(T.dedup_key("english")).alias("k"), F.regexp_replace(T.fold_eval("hinglish"), r"[^\x00-\x7F]", "?").alias("f"))
    nth = lambda n: F.max(F.when(F.col("r") == n, F.col("f")))
    g = resampling.first_ranks(p, "k", "seq", 2).groupBy("k").agg(nth(1).alias("a"), nth(2).alias("b")).where("a <> '' and b <> ''")
    e = F.levenshtein("a", "b")
    st = materialise(resampling.numbered(g.select("k", (1 - e / F.length("b")).alias("x"), (1 - e / F.length("a")).alias("y")), "k"), "items")
    rep = resampling.resampled(st, SAMPLES).groupBy("b").agg(F.avg((F.col("x") + F.col("y")) / 2).alias("m"))
    return st.agg(F.round(F.avg("x"), 9).alias("one_way"), F.round(F.avg("y"), 9).alias("other_way")).crossJoin(rep.agg(_q("m", 0.025).alias("low"), _q("m", 0.975).alias("high")))  # one row each


@query("WITH pv AS (SELECT source AS k, avg(len(" + S_WORDS.format("english") + ")) AS x, avg(len(" + S_WORDS.format("hinglish") + ")) AS y FROM raw_records JOIN pipeline_runs USING (run_id) GROUP BY source), st AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM pv), " + _IX + ", rep AS (SELECT b, corr(x, y) AS r FROM ix JOIN st USING (i) GROUP BY b HAVING count(DISTINCT i) > 2) SELECT (SELECT round(corr(x, y), 6) FROM st) AS r, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high, count(*) AS samples FROM rep")
def correlation_bootstrap(s, d):
    """Interval of a correlation over the few sources."""
    p = _raw(s, d).join(F.broadcast(_runs(s, d).select("run_id", "source")), "run_id").groupBy(F.col("source").alias("k")).agg(F.avg(F.size(T.word_tokens("english"))).alias("x"), F.avg(F.size(T.word_tokens("hinglish"))).alias("y"))
    st = materialise(resampling.numbered(p, "k"), "points")
    rep = resampling.resampled(st, SAMPLES).groupBy("b").agg(F.corr("x", "y").alias("r"), F.countDistinct("i").alias("n")).where("n > 2")
    return st.agg(F.round(F.corr("x", "y"), 6).alias("r")).crossJoin(rep.agg(F.round(F.percentile("r", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("r", F.lit(0.975)), 6).alias("high"), F.count("*").alias("samples")))  # one row each


@query("WITH " + S_LANG + ", x AS (SELECT source, avg(cmi) AS cmi, avg(spf) AS spf FROM g JOIN pipeline_runs USING (run_id) GROUP BY source), tt AS (SELECT avg(cmi) AS target, avg(spf) AS spf_target FROM g), ff AS (SELECT min(cmi) AS floor FROM x) SELECT source, round(cmi, 6) AS cmi, round(cmi - target, 6) AS cmi_off, round(spf - spf_target, 6) AS spf_off, cmi > floor + 0.000001 AS above_floor FROM x, tt, ff")
def system_mixing(s, d):
    """Each source's code mixing beside the target of all and the least of any."""
    t = F.col("tags")
    x = _tagged(s, d).select("run_id", codemix.cmi(t).alias("cmi"), codemix.spf(t).alias("spf"))
    x = materialise(x, "mixing")
    g = x.join(F.broadcast(_runs(s, d).select("run_id", "source")), "run_id").groupBy("source").agg(F.avg("cmi").alias("cmi"), F.avg("spf").alias("spf"))
    a = x.agg(F.avg("cmi").alias("target"), F.avg("spf").alias("spf_target"))
    low = F.min("cmi").over(W.partitionBy())  # a row per source
    return g.withColumn("floor", low).crossJoin(F.broadcast(a)).select("source", F.round("cmi", 6).alias("cmi"), F.round(F.col("cmi") - F.col("target"), 6).alias("cmi_off"), F.round(F.col("spf") - F.col("spf_target"), 6).alias("spf_off"), (F.col("cmi") > F.col("floor") + 0.000001).alias("above_floor"))


_SHEET = "kk AS (SELECT DISTINCT md5(" + S_KEY.format("english") + ") AS k FROM prepared_records), smp AS (SELECT k, row_number() OVER (ORDER BY sha256('11|' || k)) AS n FROM kk ORDER BY sha256('11|' || k) LIMIT 40), jd AS (SELECT k, system, judge, n <= 10 AS overlap FROM smp, (VALUES ('a'), ('b')) v(system), (VALUES ('x'), ('y')) w(judge) WHERE n <= 10 OR (n % 2 = 0) = (judge = 'x'))"


@query("WITH " + _SHEET + " SELECT judge, printf('%s%03d', judge, row_number() OVER (PARTITION BY judge ORDER BY sha256(judge || '|' || k || '|' || system))) AS row_id, overlap, sha256(k || '|' || system) AS sealed FROM jd")
def judging_sheets(s, d):
    """Forty sampled sources under two systems for two judges, ten of them for both, each judge's order its own, the system sealed."""
    k = _prep(s, d).select(F.md5(T.dedup_key("english")).alias("k")).distinct()
    o = F.sha2(F.concat(F.lit("11|"), "k"), 256)
    smp = k.orderBy(o).limit(40).withColumn("n", F.row_number().over(W.orderBy(o)))  # forty rows
    x = smp.crossJoin(F.broadcast(s.createDataFrame([(a, b) for a in "ab" for b in "xy"], "system string, judge string")))
    x = x.withColumn("overlap", F.col("n") <= 10).where(F.col("overlap") | ((F.col("n") % 2 == 0) == (F.col("judge") == "x")))
    place = F.row_number().over(W.partitionBy("judge").orderBy(F.sha2(F.concat_ws("|", "judge", "k", "system"), 256)))
    return x.select("judge", F.format_string("%s%03d", "judge", place).alias("row_id"), "overlap", F.sha2(F.concat_ws("|", "k", "system"), 256).alias("sealed"))


@query("WITH " + _SHEET + ", sh AS (SELECT k, system, judge, ('0x' || substr(md5(judge || k || system), 1, 2))::INT % 5 + 1 AS v FROM jd WHERE overlap), ky AS (SELECT DISTINCT k, system FROM jd) SELECT x.system, count(*) AS items, avg(CASE WHEN x.v = y.v THEN 1.0 ELSE 0.0 END) AS agreement, avg(x.v)::DOUBLE AS mean_x FROM sh x JOIN sh y ON x.k = y.k AND x.system = y.system AND x.judge = 'x' AND y.judge = 'y' JOIN ky ON ky.k = x.k AND ky.system = x.system GROUP BY x.system")
def sheet_results(s, d):
    """Filled sheets joined with the sealed key, by system; the scores here are digests."""
    k = _prep(s, d).select(F.md5(T.dedup_key("english")).alias("k")).distinct()
    smp = k.orderBy(F.sha2(F.concat(F.lit("11|"), "k"), 256)).limit(10)
    x = smp.crossJoin(F.broadcast(s.createDataFrame([(a, b) for a in "ab" for b in "xy"], "system string, judge string")))
    v = (F.conv(F.substring(F.md5(F.concat("judge", "k", "system")), 1, 2), 16, 10).cast("int") % 5 + 1).alias("v")
    sh = materialise(x.select(F.sha2(F.concat_ws("|", "k", "system"), 256).alias("sealed"), "judge", v), "sheets")
    key = x.select(F.sha2(F.concat_ws("|", "k", "system"), 256).alias("sealed"), "system").distinct()
    a, b = sh.where("judge = 'x'").select("sealed", F.col("v").alias("vx")), sh.where("judge = 'y'").select("sealed", F.col("v").alias("vy"))
    return a.join(b, "sealed").join(key, "sealed").groupBy("system").agg(F.count("*").alias("items"), F.avg(F.when(F.col("vx") == F.col("vy"), 1.0).otherwise(0.0)).alias("agreement"), F.avg("vx").alias("mean_x"))


@query("WITH r AS " + _RATED + ", au AS (SELECT " + S_KEY.format("english") + " AS unit, arg_min(source, seq) AS author FROM raw_records JOIN pipeline_runs USING (run_id) GROUP BY 1) SELECT rater AS judge, count(*) AS items, avg(CASE WHEN v >= 4 THEN 1.0 ELSE 0.0 END) AS accepted, avg(CASE WHEN rater = author THEN CASE WHEN v >= 4 THEN 1.0 ELSE 0.0 END END) AS own, avg(CASE WHEN rater <> author THEN CASE WHEN v >= 4 THEN 1.0 ELSE 0.0 END END) AS others FROM r JOIN au USING (unit) GROUP BY rater")
def acceptability(s, d):
    """Accepted share by judge, of what is the judge's own and of what is not."""
    r = _raw(s, d).join(F.broadcast(_runs(s, d).select("run_id", "source")), "run_id")
    au = r.groupBy(F.md5(T.dedup_key("english")).alias("unit")).agg(F.min_by("source", "seq").alias("author"))
    ok = F.when(F.col("v") >= 4, 1.0).otherwise(0.0)
    x = _ratings(s, d).join(au, "unit")
    return x.groupBy(F.col("rater").alias("judge")).agg(F.count("*").alias("items"), F.avg(ok).alias("accepted"), F.avg(F.when(F.col("rater") == F.col("author"), ok)).alias("own"), F.avg(F.when(F.col("rater") != F.col("author"), ok)).alias("others"))


@query("SELECT seq FROM prepared_records WHERE lower(trim(split)) = 'train' AND coalesce(trim(english, ' '), '') <> '' AND coalesce(trim(hinglish, ' '), '') <> '' ORDER BY sha256('5|' || seq::VARCHAR) LIMIT 5")
def few_shot(s, d):
    """Five seeded examples from train only, blank sides left out."""
    ok = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return _prep(s, d).where((F.col("split") == "train") & ok("english") & ok("hinglish")).select("seq").orderBy(F.sha2(F.concat(F.lit("5|"), F.col("seq").cast("string")), 256)).limit(5)


@query("WITH " + _LATEST + ", " + S_ROUTED.replace("FROM raw_records", "FROM raw_records WHERE run_id = (SELECT run_id FROM latest)") + ", n AS (SELECT reason, count(*) AS c FROM r GROUP BY reason), s AS (SELECT * FROM (VALUES (1, 'missing_field'), (2, 'not_romanized'), (3, 'untranslated'), (4, 'length_bounds'), (5, 'length_ratio'), (6, 'exact_duplicate')) v(step, filter_name)), "
       "x AS (SELECT step, filter_name, coalesce(c, 0) AS removed, (SELECT count(*) FROM r) - sum(coalesce(c, 0)) OVER (ORDER BY step) AS rows_out FROM s LEFT JOIN n ON s.filter_name = n.reason) "
       "SELECT step, filter_name, (rows_out + removed)::BIGINT AS rows_in, removed::BIGINT AS removed, rows_out::BIGINT AS rows_out, CASE WHEN rows_out + removed > 0 THEN 100.0::DOUBLE * removed::DOUBLE / (rows_out + removed)::DOUBLE ELSE 0.0 END AS pct_removed FROM x")  # fmt: skip
def latest_attrition(s, d):
    """Q2: the cleaning filters' account of the latest run."""
    return clean.attrition(clean.route(_raw(s, d).join(_latest(s, d), "run_id", "left_semi")))


@query("WITH " + S_PREP + ", latest AS (SELECT run_id, gate_passed FROM pipeline_runs ORDER BY loaded_at DESC, run_id LIMIT 1), p AS (SELECT * FROM prep WHERE run_id = (SELECT run_id FROM latest)), z AS (SELECT split, count(*) AS rows, count(DISTINCT group_id) AS groups FROM p GROUP BY split), t AS (SELECT count(*) AS kept, count(DISTINCT " + S_KEY.format("english") + ") AS unique_sources, count(DISTINCT group_id) AS near_dup_groups FROM p) SELECT split, rows, round(100.0 * rows / kept, 2)::DOUBLE AS pct_of_kept, groups, CASE WHEN gate_passed = 1 THEN 'passed' ELSE 'FAILED' END AS leakage_gate, unique_sources, near_dup_groups FROM z, t, latest")
def latest_splits(s, d):
    """Splits of the latest run with its gate."""
    p = materialise(_prep(s, d).join(_latest(s, d), "run_id", "left_semi").select("split", "group_id", F.md5(T.dedup_key("english")).alias("k")), "latest")
    t = p.agg(F.count("*").alias("kept"), F.countDistinct("k").alias("unique_sources"), F.countDistinct("group_id").alias("near_dup_groups"))
    gate = _runs(s, d).orderBy(F.desc("loaded_at"), "run_id").limit(1).select(F.when(F.col("gate_passed") == 1, "passed").otherwise("FAILED").alias("leakage_gate"))
    z = p.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups")).crossJoin(F.broadcast(t)).crossJoin(F.broadcast(gate))  # one row each
    return z.select("split", "rows", F.round(100.0 * F.col("rows") / F.col("kept"), 2).alias("pct_of_kept"), "groups", "leakage_gate", "unique_sources", "near_dup_groups")


@query("WITH " + _LATEST + ", lt AS (SELECT run_id AS latest_run FROM latest), " + S_LANG.replace("FROM transformed_records", "FROM transformed_records WHERE run_id = (SELECT latest_run FROM lt)") + ", " + S_SPANS + ", tg AS (SELECT sum(len(list_filter(tags, lambda x: x <> 'other')))::DOUBLE AS part FROM g), z AS (SELECT stddev_pop(n) AS sd, avg(n) AS mu FROM sp) "
       "SELECT count(*) AS n_sentences, round(sum(a + b) / any_value(part), 4) AS tagger_coverage, round(avg(cmi), 2) AS cmi_mean_all, round(avg(cmi) FILTER (WHERE cmi > 0), 2) AS cmi_mean_mixed_only, round(avg(CASE WHEN cmi > 0 THEN 1.0 ELSE 0.0 END), 4) AS frac_sentences_mixed, round(sum(sw)::DOUBLE / sum(greatest(nl - 1, 0)), 4) AS switch_point_fraction, "
       "round((1 - (sum(a)::DOUBLE * sum(a) + sum(b)::DOUBLE * sum(b)) / (sum(nl)::DOUBLE * sum(nl))) / ((sum(a)::DOUBLE * sum(a) + sum(b)::DOUBLE * sum(b)) / (sum(nl)::DOUBLE * sum(nl))), 3) AS m_index, round(any_value((sd - mu) / (sd + mu)), 4) AS burstiness, round(any_value(mu), 2) AS mean_span_length FROM g, tg, z")  # fmt: skip
def latest_codemix(s, d):
    """Q4: nine figures of code mixing of the latest run."""
    x = codemix.corpus_summary(_tagged(s, d).join(_latest(s, d), "run_id", "left_semi"), "tags")
    return x.drop("spf_mean_per_sentence", "n_switch_points", "spf_over_sentences")


@query("WITH latest AS (SELECT * FROM pipeline_runs ORDER BY loaded_at DESC, run_id LIMIT 1) SELECT run_id, source, seed, CASE WHEN synthetic = 1 THEN 'synthetic' ELSE 'corpus' END AS kind, (SELECT count(*) FROM raw_records r WHERE r.run_id = latest.run_id) AS records_ingested, (SELECT count(*) FROM prepared_records p WHERE p.run_id = latest.run_id) AS records_kept, CASE WHEN gate_passed = 1 THEN 'passed' ELSE 'FAILED' END AS leakage_gate, elapsed_seconds, loaded_at FROM latest")
def latest_latency(s, d):
    """Q6: the latest run's kind, counts, gate and time; the tables hold no times by stage."""
    one = _latest(s, d)
    n = lambda t, c: table(s, d, t).join(one, "run_id", "left_semi").agg(F.count("*").alias(c))
    r = _runs(s, d).join(one, "run_id", "left_semi").crossJoin(n("raw_records", "records_ingested")).crossJoin(n("prepared_records", "records_kept"))  # one row each
    return r.select("run_id", "source", "seed", F.when(F.col("synthetic") == 1, "synthetic").otherwise("corpus").alias("kind"), "records_ingested", "records_kept", F.when(F.col("gate_passed") == 1, "passed").otherwise("FAILED").alias("leakage_gate"), "elapsed_seconds", "loaded_at")


@query("WITH pl(source, planned) AS (VALUES ('hinge_like', 500.0), ('forum_pairs', 90.0), ('never_run', 40.0)), r AS (SELECT source, sum(elapsed_seconds) AS spent, sum(CASE WHEN gate_passed = 0 THEN elapsed_seconds ELSE 0 END) AS failed_time, count(*) FILTER (WHERE gate_passed = 1) AS ok, count(*) FILTER (WHERE gate_passed = 0) AS failed, count(*) FILTER (WHERE gate_passed IS NULL) AS running, count(DISTINCT seed) AS seeds, sum(elapsed_seconds) / nullif(count(DISTINCT seed), 0) AS each FROM pipeline_runs GROUP BY source) "
       "SELECT source, planned, coalesce(spent, 0) AS spent, coalesce(failed_time, 0) AS failed_time, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed, coalesce(running, 0) AS running, round(CASE WHEN seeds > 0 THEN each * 3 ELSE greatest(planned, coalesce(spent, 0)) END, 6) AS projected FROM pl FULL JOIN r USING (source)")  # fmt: skip
def ledger_plan(s, d):
    """Time spent, lost and planned by line; three times a seed's time where seeds are known, else the plan or what is spent."""
    c = F.col
    n = lambda v: F.count(F.when(v, 1))
    r = _runs(s, d).groupBy("source").agg(F.sum("elapsed_seconds").alias("spent"), F.sum(F.when(c("gate_passed") == 0, c("elapsed_seconds")).otherwise(0.0)).alias("failed_time"), n(c("gate_passed") == 1).alias("ok"), n(c("gate_passed") == 0).alias("failed"), n(c("gate_passed").isNull()).alias("running"), F.countDistinct("seed").alias("seeds"))
    p = s.createDataFrame([("hinge_like", 500.0), ("forum_pairs", 90.0), ("never_run", 40.0)], "source string, planned double")
    zero = lambda v: F.coalesce(v, F.lit(0)).alias(v)
    projected = F.when(c("seeds") > 0, c("spent") / c("seeds") * 3).otherwise(F.greatest("planned", F.coalesce("spent", F.lit(0.0))))
    return p.join(r, "source", "full_outer").select("source", "planned", F.coalesce("spent", F.lit(0.0)).alias("spent"), F.coalesce("failed_time", F.lit(0.0)).alias("failed_time"), zero("ok"), zero("failed"), zero("running"), F.round(projected, 6).alias("projected"))


@query("WITH " + S_ITEMS + ", b AS (SELECT system, edits::DOUBLE / chars AS rate FROM best), m AS (SELECT system, round(median(rate), 9) AS med FROM b GROUP BY system) SELECT system, med, count(*) AS items, avg(CASE WHEN rate <= 0.6 THEN 1.0 ELSE 0.0 END) AS acceptable, count(*) FILTER (WHERE rate <= 0.6 AND round(rate, 9) > med) AS artifacts FROM b JOIN m USING (system) GROUP BY system, med")
def artifact_rates(s, d):
    """Acceptable outputs that nevertheless score worse than their system's median: likely faults of the references."""
    b = materialise(_best(s, d).select("system", (F.col("edits") / F.col("chars")).alias("rate")), "rates")
    m = b.groupBy("system").agg(F.round(F.median("rate"), 9).alias("med"))
    ok = F.col("rate") <= 0.6
    return b.join(F.broadcast(m), "system").groupBy("system", "med").agg(F.count("*").alias("items"), F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("acceptable"), F.count(F.when(ok & (F.round("rate", 9) > F.col("med")), 1)).alias("artifacts"))


@query("WITH e AS (SELECT event_type, from_json(props, '{\"k\": \"BIGINT\"}') AS m FROM events WHERE json_valid(props)), k AS (SELECT event_type, unnest(json_keys(props)) AS key FROM events WHERE json_valid(props)) SELECT event_type, key, count(*) AS n FROM k GROUP BY ALL".replace("e AS (SELECT event_type, from_json(props, '{\"k\": \"BIGINT\"}') AS m FROM events WHERE json_valid(props)), ", ""))
def monitor_maps(s, d):
    """Keys of the nested maps of monitor records, rolled up by type."""
    m = F.from_json("props", "map<string,string>")
    e = table(s, d, "events").select("event_type", F.explode(F.map_keys(m)).alias("key"))
    return e.groupBy("event_type", "key").agg(F.count("*").alias("n"))
