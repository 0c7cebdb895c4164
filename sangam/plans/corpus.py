"""Queries over texts: scalars, cleaning, tags, vocabulary, overlaps, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sangam.functions import text as T
from sangam.operators import clean, codemix, neardup
from sangam.session import materialise, table

# Spelling variants of frequent words, our own lexicon: label and forms.
LEXICON = {
    "nahi": "nahi nahin nai nahee nhi", "mein": "mein me mai mn", "hai": "hai hy he hae", "kar": "kar kr", "se": "se sey", "ke": "ke kay",
    "ki": "ki kee", "ne": "ne nay", "aur": "aur aor", "paas": "paas pas", "bhi": "bhi bi", "liye": "liye lie liyee", "wala": "wala waala vala", "baad": "baad bad",
}

TOK = r"[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s]"
S_TOKENS = "regexp_extract_all(coalesce({0}, ''), '" + TOK + "')"
S_WORDS = "list_filter(" + S_TOKENS + r", lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))".replace("{{", "{").replace("}}", "}")
S_TOKENS, S_WORDS = (s.replace("{L}", "{{L}}").replace("{N}", "{{N}}") for s in (S_TOKENS, S_WORDS))
S_KEY = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
S_NORM = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x1c-\x1f\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
S_SCRIPT = (
    r"(CASE WHEN length(regexp_replace(coalesce({0}, ''), '\s', '', 'g')) = 0 THEN 0.0 ELSE "
    r"length(regexp_replace(coalesce({0}, ''), '[^\x{{0900}}-\x{{097F}}]', '', 'g'))::DOUBLE / length(regexp_replace(coalesce({0}, ''), '\s', '', 'g')) END)"
)

S_ROUTED = (
    "p AS (SELECT *, " + S_NORM.format("english") + " AS ne, " + S_NORM.format("hinglish") + " AS nh, " + S_KEY.format("english") + " AS k1, " + S_KEY.format("hinglish") + " AS k2, "
    "len(" + S_WORDS.format("english") + ") AS e, len(" + S_WORDS.format("hinglish") + ") AS h, " + S_SCRIPT.format("hinglish") + " AS sf FROM raw_records), "
    "q AS (SELECT *, CASE WHEN ne = '' OR nh = '' THEN 'missing_field' WHEN sf > 0.2 THEN 'not_romanized' WHEN k1 = k2 THEN 'untranslated' "
    "WHEN least(e, h) < 2 OR greatest(e, h) > 60 THEN 'length_bounds' WHEN h::DOUBLE / e > 3.0 OR h::DOUBLE / e < 1 / 3.0::DOUBLE THEN 'length_ratio' END AS r0 FROM p), "
    "r AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN r0 WHEN row_number() OVER (PARTITION BY r0 IS NULL, k1, k2 ORDER BY seq) > 1 THEN 'exact_duplicate' END AS reason FROM q)"
)
S_TAGS = "t AS (SELECT run_id, record_id, loaded_at, CASE WHEN json_valid(tags_json) THEN from_json(tags_json, '[\"VARCHAR\"]') END AS tags FROM transformed_records), "
S_LANG = S_TAGS + (
    "l AS (SELECT row_number() OVER () AS rid, run_id, record_id, loaded_at, tags, list_filter(tags, lambda x: x IN ('lang1', 'lang2')) AS lang FROM t WHERE tags IS NOT NULL), "
    "f AS (SELECT *, len(lang) AS nl, len(list_filter(lang, lambda x: x = 'lang1')) AS a, len(list_filter(lang, lambda x: x = 'lang2')) AS b, "
    "CASE WHEN len(lang) < 2 THEN 0 ELSE len(list_filter(range(2, len(lang) + 1), lambda i: lang[i] <> lang[i - 1])) END AS sw FROM l), "
    "g AS (SELECT *, CASE WHEN nl = 0 THEN 0.0 ELSE 100.0 * (1 - greatest(a, b)::DOUBLE / nl) END AS cmi, CASE WHEN nl >= 2 THEN sw::DOUBLE / (nl - 1) END AS spf, "
    "CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE (1 - (a * a + b * b)::DOUBLE / (nl * nl)) / ((a * a + b * b)::DOUBLE / (nl * nl)) END AS m FROM f)"
)
S_SPANS = (
    "e AS (SELECT run_id, rid, unnest(lang) AS tag, unnest(range(1, len(lang) + 1)) AS pos FROM f), "
    "c AS (SELECT *, CASE WHEN tag = lag(tag) OVER (PARTITION BY rid ORDER BY pos) THEN 0 ELSE 1 END AS new FROM e), "
    "i AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS island FROM c), "
    "sp AS (SELECT run_id, rid, island, count(*) AS n FROM i GROUP BY ALL)"
)

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _raw(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_records")


def _prep(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "prepared_records")
    return p.withColumn("split", F.lower(F.trim("split"))).withColumn("group_id", F.lower(F.trim("group_id")))


def _exploded(df: DataFrame, text: str, name: str, *keep: str, lower: bool = True) -> DataFrame:
    """One row per word."""
    w = df.select(*keep, F.explode(T.word_tokens(text)).alias(name))
    return w.withColumn(name, F.lower(name)) if lower else w


S_PREP = "prep AS (SELECT * REPLACE (lower(trim(split)) AS split, lower(trim(group_id)) AS group_id) FROM prepared_records)"


@query("SELECT seq, md5(" + S_NORM.format("english") + ") AS norm_md5, md5(" + S_KEY.format("english") + ") AS key_md5, substr(sha256(" + S_KEY.format("english") + " || chr(9) || " + S_KEY.format("hinglish") + "), 1, 16) AS content_id FROM raw_records")
def text_keys(s, d):
    """P1, P2, P6, P7."""
    return _raw(s, d).select("seq", F.md5(T.normalise("english")).alias("norm_md5"), F.md5(T.dedup_key("english")).alias("key_md5"), T.content_id("english", "hinglish").alias("content_id"))


@query("SELECT doc_id, len(" + S_TOKENS.format("text") + ") AS n_tokens, len(" + S_WORDS.format("text") + ") AS n_words FROM documents")
def token_counts(s, d):
    """P3, P4."""
    return table(s, d, "documents").select("doc_id", F.size(T.tokens("text")).alias("n_tokens"), F.size(T.word_tokens("text")).alias("n_words"))


@query("SELECT doc_id, " + S_SCRIPT.format("text") + " AS devanagari FROM documents")
def script_fraction(s, d):
    """P5."""
    return table(s, d, "documents").select("doc_id", T.script_fraction("text").alias("devanagari"))


@query("SELECT lang, sum(length(regexp_replace(coalesce(text, ''), '[^\\x{0900}-\\x{097F}]', '', 'g')))::DOUBLE / nullif(sum(length(regexp_replace(coalesce(text, ''), '\\s', '', 'g'))), 0) AS share FROM (SELECT lower(trim(lang)) AS lang, text FROM documents) GROUP BY lang")
def script_guard(s, d):
    """Script share of whole slices."""
    v = F.coalesce("text", F.lit(""))
    n, m = F.sum(F.length(F.regexp_replace(v, T.DEVANAGARI, ""))), F.sum(F.length(F.regexp_replace(v, r"\s", "")))
    return table(s, d, "documents").groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.when(m > 0, n / m).alias("share"))


@query(
    "SELECT seq, md5(trim(regexp_replace(regexp_replace(lower(coalesce(hinglish, '')), '[^\\p{L}\\p{N}_\\s\\x{0900}-\\x{097F}]', ' ', 'g'), '\\s+', ' ', 'g'))) AS folded, "
    "md5(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(hinglish, '')), 'aa+', 'a', 'g'), 'ee+|ii+', 'i', 'g'), 'oo+|uu+', 'u', 'g')) AS vowels FROM raw_records"
)
def eval_folds(s, d):
    """P9, P11."""
    return _raw(s, d).select("seq", F.md5(T.fold_eval("hinglish")).alias("folded"), F.md5(T.fold_vowels(F.lower(F.coalesce("hinglish", F.lit(""))))).alias("vowels"))


def _squashed(x: str, letters: str) -> str:
    """SQL for runs of three or more of one letter made one: there are no back-references there."""
    for c in letters:
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}', 'g')"
    return x


_AZ = "abcdefghijklmnopqrstuvwxyz"


@query("WITH s AS (SELECT seq, hinglish AS h, " + _squashed("hinglish", _AZ + _AZ.upper()) + " AS q FROM raw_records WHERE hinglish IS NOT NULL) SELECT seq, (length(h) - length(q))::INT AS cut FROM s WHERE h <> q")
def letter_runs(s, d):
    """P10: texts with a letter three or more times in a row, and how many characters go."""
    t = _raw(s, d).select("seq", "hinglish", T.squash_runs(F.coalesce("hinglish", F.lit(""))).alias("squashed"))
    return t.where("hinglish <> squashed").select("seq", (F.length("hinglish") - F.length("squashed")).alias("cut"))


_L0 = "regexp_replace(lower(coalesce(hinglish, '')), '[^\\p{L}\\p{N}_\\s\\x{0900}-\\x{097F}]', ' ', 'g')"


@query("WITH a AS (SELECT seq, " + _squashed(_L0, _AZ + "0123456789_ ") + " AS v FROM raw_records WHERE hinglish IS NULL OR NOT regexp_matches(hinglish, '[^\\x00-\\x7F]')), b AS (SELECT seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, 'aa+', 'a', 'g'), 'ee+', 'i', 'g'), 'ii+', 'i', 'g'), 'oo+', 'u', 'g'), 'uu+', 'u', 'g') AS v FROM a) SELECT seq, md5(trim(regexp_replace(regexp_replace(regexp_replace(v, 'n([^\\p{L}\\p{N}_]|$)', '\\1', 'g'), 'h([bcdfgjklmnpqrstvwxyz])', '\\1', 'g'), '\\s+', ' ', 'g'), ' ')) AS legacy_md5 FROM b")
def legacy_normal(s, d):
    """The older normaliser over ASCII texts."""
    t = _raw(s, d).where("hinglish is null or not hinglish rlike '[^\\\\x00-\\\\x7F]'")
    return t.select("seq", F.md5(T.legacy_normal("hinglish")).alias("legacy_md5"))


@query("WITH " + S_ROUTED + ", n AS (SELECT reason, count(*) AS c FROM r GROUP BY reason), s AS (SELECT * FROM (VALUES (1, 'missing_field'), (2, 'not_romanized'), (3, 'untranslated'), (4, 'length_bounds'), (5, 'length_ratio'), (6, 'exact_duplicate')) v(step, filter_name)), "
       "x AS (SELECT step, filter_name, coalesce(c, 0) AS removed, (SELECT count(*) FROM r) - sum(coalesce(c, 0)) OVER (ORDER BY step) AS rows_out FROM s LEFT JOIN n ON s.filter_name = n.reason) "
       "SELECT step, filter_name, (rows_out + removed)::BIGINT AS rows_in, removed::BIGINT AS removed, rows_out::BIGINT AS rows_out, CASE WHEN rows_out + removed > 0 THEN 100.0::DOUBLE * removed::DOUBLE / (rows_out + removed)::DOUBLE ELSE 0.0 END AS pct_removed FROM x")  # fmt: skip
def attrition(s, d):
    """F1 to F7, A1, W1, W4."""
    return clean.attrition(clean.route(_raw(s, d)))


@query("WITH " + S_ROUTED + " SELECT seq, record_id FROM r WHERE reason IS NULL")
def clean_kept(s, d):
    """the survivors."""
    return clean.route(_raw(s, d), keep=("record_id",)).where("reason is null").select("seq", "record_id")


@query("WITH " + S_ROUTED + ", o AS (SELECT reason, seq, row_number() OVER (PARTITION BY reason ORDER BY seq) AS n FROM r WHERE reason IS NOT NULL) SELECT reason, n, seq FROM o WHERE n <= 3")
def attrition_examples(s, d):
    """T5: the first three rows each filter removed, by a bounded aggregate instead of a sort of all rows."""
    r = clean.route(_raw(s, d)).where("reason is not null").withColumn("b", F.pmod(F.xxhash64("seq"), F.lit(64)))
    w = W.partitionBy("reason", "b").orderBy("seq")
    few = r.withColumn("n", F.row_number().over(w)).where("n <= 3")
    return few.withColumn("n", F.row_number().over(W.partitionBy("reason").orderBy("seq"))).where("n <= 3").select("reason", "n", "seq")


def _tagged(s, d):
    return table(s, d, "transformed_records").withColumn("tags", codemix.parse_tags(F.col("tags_json"))).where("tags is not null")


@query("WITH " + S_LANG + " SELECT record_id, loaded_at, cmi, spf, m AS m_index, sw::INT AS switches FROM g")
def cmi_sentences(s, d):
    """P19, P20, P21, W3."""
    t = F.col("tags")
    return _tagged(s, d).select("record_id", "loaded_at", codemix.cmi(t).alias("cmi"), codemix.spf(t).alias("spf"), codemix.m_index(t).alias("m_index"), codemix.switches(t).alias("switches"))


@query("WITH " + S_LANG + ", " + S_SPANS + ", z AS (SELECT run_id, count(*) AS k, stddev_pop(n) AS sd, avg(n) AS mu FROM sp GROUP BY run_id), "
       "y AS (SELECT run_id, count(*) AS n_sentences, avg(cmi) AS mean_cmi, avg(spf) AS mean_spf, sum(sw)::DOUBLE / nullif(sum(greatest(nl - 1, 0)), 0)::DOUBLE AS corpus_spf, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(len(list_filter(tags, lambda x: x <> 'other')))::DOUBLE AS part FROM g GROUP BY run_id) "
       "SELECT y.run_id, n_sentences, round(mean_cmi, 6) AS mean_cmi, round(mean_spf, 6) AS mean_spf, round(corpus_spf, 6) AS corpus_spf, round(CASE WHEN a > 0 AND b > 0 THEN (1 - (a*a+b*b)/((a+b)*(a+b))) / ((a*a+b*b)/((a+b)*(a+b))) ELSE 0.0 END, 6) AS m_index, "
       "round(CASE WHEN k >= 2 THEN (sd - mu) / (sd + mu) END, 6) AS burstiness, round((a + b) / part, 6) AS coverage FROM y LEFT JOIN z ON y.run_id IS NOT DISTINCT FROM z.run_id")  # fmt: skip
def cmi_by_run(s, d):
    """Code-mixing figures of each run."""
    g = codemix.summary(_tagged(s, d), "tags", "run_id")
    return g.select("run_id", "n_sentences", *[F.round(c, 6).alias(c) for c in g.columns[2:]])


@query("WITH " + S_LANG + ", " + S_SPANS + " SELECT n::INT AS span, count(*) AS spans FROM sp GROUP BY n")
def span_histogram(s, d):
    """P22, W2."""
    return _tagged(s, d).select(F.explode(codemix.span_lengths(F.col("tags"))).alias("span")).groupBy("span").agg(F.count("*").alias("spans"))


_M = ", ".join(f"'{w}'" for w in codemix.MARKERS)


_LEX = [(i, k, f) for i, (k, v) in enumerate(LEXICON.items()) for f in v.split()]
S_LEX = "lex(label, form) AS (VALUES " + ", ".join(f"('{k}', '{f}')" for _, k, f in _LEX) + ")"


def _lexicon(s):
    return s.createDataFrame(_LEX, "grp_order int, label string, form string").groupBy("form").agg(F.min_by("label", "grp_order").alias("label"))


_E = ", ".join(f"'{w}'" for w in codemix.ENGLISH_WORDS)
S_TAGGED = (
    S_LEX + ", mk AS (SELECT list(DISTINCT f) AS mk FROM (SELECT unnest([" + _M + "]) AS f UNION ALL SELECT lower(form) FROM lex)), "
    "w AS (SELECT seq, " + S_TOKENS.format("hinglish") + " AS tk, list_transform(" + S_WORDS.format("english") + ", lambda x: lower(x)) AS src FROM raw_records), "
    "u AS (SELECT seq, src, unnest(tk) AS t, unnest(range(0, len(tk))) AS i FROM w), "
    "tagged AS (SELECT seq, i, t, CASE WHEN NOT regexp_matches(t, '[\\p{L}\\p{N}]') OR regexp_matches(t, '^\\p{Nd}+$') THEN 'other' WHEN list_contains(mk, lower(t)) AND list_contains(src, lower(t)) THEN 'ambiguous' WHEN list_contains(mk, lower(t)) THEN 'lang2' "
    "WHEN list_contains(src, lower(t)) OR lower(t) IN (" + _E + ") THEN 'lang1' WHEN i > 0 AND regexp_matches(t, '^\\p{Lu}') THEN 'ne' ELSE 'unk' END AS tag FROM u, mk)"
)


def _markers(s) -> list[str]:
    """Built-in markers and every form of the lexicon: a few hundred words."""
    return sorted(r.form for r in codemix.markers(_lexicon(s)).collect())


@query("WITH " + S_TAGGED + " SELECT tag, count(*) AS n FROM tagged GROUP BY 1")
def tag_histogram(s, d):
    """Tags made by the seven rules, markers united with the lexicon."""
    return codemix.tag_rows(_raw(s, d), "hinglish", "english", _markers(s)).groupBy("tag").agg(F.count("*").alias("n"))


@query("WITH " + S_TAGGED + " SELECT tag, count(DISTINCT lower(t)) AS types, min(lower(t)) AS first FROM tagged WHERE tag IN ('ambiguous', 'ne') GROUP BY 1")
def tag_types(s, d):
    """Distinct words under the two tags that depend on the source and on capitals."""
    t = codemix.tag_rows(_raw(s, d), "hinglish", "english", _markers(s)).where(F.col("tag").isin("ambiguous", "ne")).groupBy("tag", F.lower("token").alias("w")).agg(F.count("*").alias("n"))
    return t.groupBy("tag").agg(F.count("*").alias("types"), F.min("w").alias("first"))


@query("WITH " + S_PREP + ", c AS (SELECT split, len(" + S_WORDS.format("english") + ") AS e, len(" + S_WORDS.format("hinglish") + ") AS h FROM prep) SELECT split, count(*) AS n, avg(h) AS mean, median(h)::DOUBLE AS median, quantile_disc(h, 0.95)::DOUBLE AS p95, min(h)::INT AS least, max(h)::INT AS most, round(avg(h::DOUBLE / greatest(e, 1)), 9) AS mean_ratio FROM c GROUP BY split")
def lengths(s, d):
    """A5, A9, A13."""
    c = _prep(s, d).select("split", F.size(T.word_tokens("english")).alias("e"), F.size(T.word_tokens("hinglish")).alias("h"))
    return c.groupBy("split").agg(F.count("*").alias("n"), F.avg("h").alias("mean"), F.median("h").alias("median"), F.expr("percentile_disc(0.95) within group (order by h)").cast("double").alias("p95"), F.min("h").alias("least"), F.max("h").alias("most"), F.round(F.avg(F.col("h") / F.greatest("e", F.lit(1))), 9).alias("mean_ratio"))


@query("WITH w AS (SELECT lower(unnest(" + S_WORDS.format("hinglish") + ")) AS word FROM prepared_records), c AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT count(*) AS types, sum(n)::BIGINT AS tokens, count(*)::DOUBLE / greatest(sum(n), 1)::DOUBLE AS ttr, -sum(n::DOUBLE / t * log2(n::DOUBLE / t)) AS entropy FROM c, (SELECT sum(n)::DOUBLE AS t FROM c)")
def vocabulary(s, d):
    """A6, A10."""
    c = _exploded(_prep(s, d), "hinglish", "word").groupBy("word").agg(F.count("*").alias("n"))
    # entropy of counts: log2 N - sum(n log2 n) / N, one pass
    return c.agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.sum(F.col("n") * F.log2("n")).alias("x")).select("types", "tokens", (F.col("types") / F.greatest("tokens", F.lit(1))).alias("ttr"), (F.log2(F.col("tokens").cast("double")) - F.col("x") / F.col("tokens")).alias("entropy"))


@query("WITH w AS (SELECT lower(unnest(" + S_WORDS.format("hinglish") + ")) AS word FROM prepared_records) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20")
def top_words(s, d):
    """Ties by word."""
    c = _exploded(_prep(s, d), "hinglish", "word").groupBy("word").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "word").limit(20)


@query("WITH c AS (SELECT " + S_KEY.format("english") + " AS k, count(*) AS n_refs FROM prepared_records GROUP BY 1) SELECT n_refs, count(*) AS n_sources FROM c GROUP BY n_refs")
def references_per_source(s, d):
    """A11."""
    c = _prep(s, d).groupBy(F.md5(T.dedup_key("english")).alias("k")).agg(F.count("*").alias("n_refs"))
    return c.groupBy("n_refs").agg(F.count("*").alias("n_sources"))


@query("WITH c AS (SELECT " + S_KEY.format("english") + " AS k, count(*) AS n FROM prepared_records GROUP BY 1), h AS (SELECT n, count(*) AS m FROM c GROUP BY n) SELECT (SELECT n FROM h ORDER BY m DESC, n LIMIT 1) AS mode, max(m)::DOUBLE / sum(m)::DOUBLE AS modal_share, sum(CASE WHEN n >= 4 THEN m ELSE 0 END)::DOUBLE / sum(m)::DOUBLE AS four_or_more FROM h")
def reference_imbalance(s, d):
    """A22."""
    h = references_per_source(s, d)
    return h.agg(F.max_by("n_refs", F.struct("n_sources", -F.col("n_refs"))).alias("mode"), (F.max("n_sources") / F.sum("n_sources")).alias("modal_share"), (F.sum(F.when(F.col("n_refs") >= 4, F.col("n_sources")).otherwise(0)) / F.sum("n_sources")).alias("four_or_more"))


@query("WITH " + S_LEX + ", w AS (SELECT lower(unnest(" + S_WORDS.format("hinglish") + ")) AS form FROM transformed_records), c AS (SELECT label, form, count(*) AS n FROM w JOIN lex USING (form) GROUP BY label, form), t AS (SELECT label, sum(n)::DOUBLE AS tot FROM c GROUP BY label) "
       "SELECT label, sum(n)::BIGINT AS occurrences, count(*) AS forms, 1 - sum(CASE WHEN form = label THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS non_canonical, round(-sum(n / tot * log2(n / tot)), 9) AS entropy FROM c JOIN t USING (label) GROUP BY label")  # fmt: skip
def spelling_variance(s, d):
    """A6, A7, J2, D6; the lexicon is a constant of some dozens of forms."""
    w = _exploded(table(s, d, "transformed_records"), "hinglish", "form")
    c = w.join(F.broadcast(_lexicon(s)), "form").groupBy("label", "form").agg(F.count("*").alias("n"))
    t = c.groupBy("label").agg(F.sum("n").alias("occurrences"), F.count("*").alias("forms"), F.sum(F.when(F.col("form") == F.col("label"), F.col("n")).otherwise(0)).alias("own"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    return t.select("label", "occurrences", "forms", (1 - F.col("own") / F.col("occurrences")).alias("non_canonical"), F.round(F.log2(F.col("occurrences").cast("double")) - F.col("x") / F.col("occurrences"), 9).alias("entropy"))


@query("WITH " + S_LEX + ", w AS (SELECT lower(unnest(" + S_WORDS.format("hinglish") + ")) AS form FROM raw_records), m AS (SELECT form, coalesce(label, regexp_replace(regexp_replace(regexp_replace(form, 'aa+', 'a', 'g'), 'ee+|ii+', 'i', 'g'), 'oo+|uu+', 'u', 'g')) AS norm, label FROM w LEFT JOIN lex USING (form)) "
       "SELECT count(*) AS tokens, count(label) AS mapped, count(*) FILTER (WHERE norm <> form) AS changed, count(DISTINCT form) AS forms, count(DISTINCT norm) AS norms FROM m")  # fmt: skip
def normaliser_coverage(s, d):
    """What lexicon and vowel folding change; distinct forms are joined, not tokens."""
    w = _exploded(_raw(s, d), "hinglish", "form").groupBy("form").agg(F.count("*").alias("n"))
    m = w.join(F.broadcast(_lexicon(s)), "form", "left").withColumn("norm", F.coalesce("label", T.fold_vowels("form")))
    one = m.groupBy("norm").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("mp"), F.sum(F.when(F.col("norm") != F.col("form"), F.col("n")).otherwise(0)).alias("ch"), F.count("*").alias("f"))
    return one.agg(F.sum("n").alias("tokens"), F.sum("mp").alias("mapped"), F.sum("ch").alias("changed"), F.sum("f").alias("forms"), F.count("*").alias("norms"))


@query("WITH " + S_PREP + " SELECT split, count(*) AS records, count(DISTINCT " + S_KEY.format("english") + ") AS sources, count(DISTINCT group_id) AS groups FROM prep GROUP BY split")
def split_counts(s, d):
    """A8."""
    return _prep(s, d).groupBy("split").agg(F.count("*").alias("records"), F.countDistinct(F.md5(T.dedup_key("english"))).alias("sources"), F.countDistinct("group_id").alias("groups"))


@query("WITH " + S_PREP + " SELECT split, group_id, count(DISTINCT " + S_KEY.format("english") + ") AS sources FROM prep GROUP BY ALL HAVING count(DISTINCT " + S_KEY.format("english") + ") > 1")
def merged_groups(s, d):
    """A14."""
    k = _prep(s, d).select("split", "group_id", F.md5(T.dedup_key("english")).alias("k")).distinct()
    return k.groupBy("split", "group_id").agg(F.count("*").alias("sources")).where("sources > 1")


@query("WITH " + S_PREP + " SELECT md5(" + S_KEY.format("english") + ") AS key_md5, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS records FROM prep GROUP BY 1 HAVING count(DISTINCT split) > 1")
def exact_overlap(s, d):
    """Source keys in more than one split."""
    g = _prep(s, d).groupBy(F.md5(T.dedup_key("english")).alias("key_md5")).agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"), F.count("*").alias("records"), F.min("split").alias("a"), F.max("split").alias("b"))
    return g.where("a <> b").drop("a", "b")


@query("WITH " + S_PREP + ", k AS (SELECT DISTINCT split, " + S_KEY.format("hinglish") + " AS k FROM prep), n AS (SELECT split, count(*) AS c FROM k GROUP BY split) SELECT x.split AS a, y.split AS b, count(*) AS shared, count(*)::DOUBLE / any_value(n.c) AS share FROM k x JOIN k y ON x.k = y.k AND x.split <> y.split JOIN n ON n.split = x.split GROUP BY 1, 2")
def split_overlap_shares(s, d):
    """Targets two splits have in common; a key has at most three rows here."""
    k = materialise(_prep(s, d).select("split", F.md5(T.dedup_key("hinglish")).alias("k")).distinct(), "keys")
    n = k.groupBy("split").agg(F.count("*").alias("c"))
    x = k.alias("x").join(k.alias("y"), "k").where("x.split <> y.split").groupBy(F.col("x.split").alias("a"), F.col("y.split").alias("b")).agg(F.count("*").alias("shared"))
    return x.join(F.broadcast(n.withColumnRenamed("split", "a")), "a").select("a", "b", "shared", (F.col("shared") / F.col("c")).alias("share"))


@query("WITH " + S_PREP + ", p AS (SELECT split, " + S_KEY.format("english") + " AS e, " + S_KEY.format("hinglish") + " AS h FROM prep), r AS (SELECT " + S_KEY.format("english") + " AS e, " + S_KEY.format("hinglish") + " AS h FROM raw_records) "
       "SELECT s.split, (SELECT count(*) FROM r WHERE e IN (SELECT e FROM p WHERE p.split = s.split)) AS english_hits, (SELECT count(*) FROM r WHERE h IN (SELECT h FROM p WHERE p.split = s.split)) AS hinglish_hits FROM (SELECT DISTINCT split FROM p) s")  # fmt: skip
def contamination_scan(s, d):
    """Rows of the outside corpus whose either side stands in each split; the exact part of J6."""
    out = None
    for side, col in (("english", "english_hits"), ("hinglish", "hinglish_hits")):
        p = _prep(s, d).select("split", F.md5(T.dedup_key(side)).alias("k")).distinct()
        r = _raw(s, d).groupBy(F.md5(T.dedup_key(side)).alias("k")).agg(F.count("*").alias("n"))
        x = p.join(r, "k", "left").groupBy("split").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(col))
        out = x if out is None else out.join(x, "split")
    return out


@query("WITH " + S_PREP + ", p AS (SELECT " + S_KEY.format("english") + " AS e FROM prep WHERE split IN ('dev', 'test')) SELECT seq FROM raw_records WHERE " + S_KEY.format("english") + " NOT IN (SELECT e FROM p)")
def contamination_clean(s, d):
    """U4: rows left when protected sources are taken out by English key, the exact part of F9 and G7."""
    p = _prep(s, d).where(F.col("split").isin("dev", "test")).select(F.md5(T.dedup_key("english")).alias("k")).distinct()
    return _raw(s, d).select("seq", F.md5(T.dedup_key("english")).alias("k")).join(p, "k", "left_anti").select("seq")


def _keys(s, d):
    k = _prep(s, d).select("seq", T.dedup_key("english").alias("key")).groupBy("key").agg(F.min("seq").alias("id"))
    return materialise(k.select("id", "key"), "keys")


_S_NEAR = ("k AS (SELECT min(seq) AS id, " + S_KEY.format("english") + " AS key FROM prepared_records GROUP BY 2), g AS (SELECT DISTINCT id, substr(key, i::INT, 4) AS g FROM k, range(1, greatest(length(key) - 3, 1) + 1) r(i) WHERE key <> ''), "
           "n AS (SELECT id, count(*) AS n FROM g GROUP BY id), near AS (SELECT a.id AS a, b.id AS b, count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS jaccard FROM g a JOIN g b ON a.g = b.g AND a.id < b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY 1, 2 HAVING count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.7)")  # fmt: skip


@query("WITH " + _S_NEAR + " SELECT a, b, jaccard FROM near")
def near_dup_pairs(s, d):
    """P14, P15, P16, J3, J4, J5, G1."""
    return neardup.near_pairs(_keys(s, d))


@query("WITH RECURSIVE " + _S_NEAR + ", e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach(x, y) AS (SELECT a, b FROM e UNION SELECT x, e.b FROM reach JOIN e ON y = e.a), l AS (SELECT x AS id, least(x, min(y)) AS label FROM reach GROUP BY x) SELECT k.id, coalesce(l.label, k.id) AS group_label FROM k LEFT JOIN l ON l.id = k.id")
def dup_groups(s, d):
    """Group label of every source key."""
    k = _keys(s, d)
    lab = neardup.group_labels(neardup.near_pairs(k))
    return k.join(lab, "id", "left").select("id", F.coalesce("label", "id").alias("group_label"))


@query("WITH c AS (SELECT source, length(regexp_replace(coalesce(english, ''), '[^0-9]', '', 'g')) AS dg, len(" + S_WORDS.format("english") + ")::DOUBLE AS x, len(" + S_WORDS.format("hinglish") + ")::DOUBLE AS y, "
       "list_distinct(regexp_extract_all(coalesce(english, ''), '[0-9]+')) AS a, list_distinct(regexp_extract_all(coalesce(hinglish, ''), '[0-9]+')) AS b FROM raw_records JOIN pipeline_runs USING (run_id)) "
       "SELECT source, count(*) AS rows, round(avg(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda v: list_contains(b, v)))::DOUBLE / len(a) END), 9) AS digits_kept, count(CASE WHEN len(a) > 0 THEN 1 END) AS with_digits, avg(CASE WHEN len(list_filter(b, lambda v: NOT list_contains(a, v))) > 0 THEN 1.0 ELSE 0.0 END) AS invented, round(corr(x, y), 6) AS length_corr FROM c GROUP BY source")  # fmt: skip
def alignment_probe(s, d):
    """A18, A20, P32, P33."""
    runs = F.broadcast(table(s, d, "pipeline_runs").select("run_id", "source"))  # a row per run
    digits = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0)))
    c = _raw(s, d).join(runs, "run_id").select("source", digits("english").alias("a"), digits("hinglish").alias("b"), F.size(T.word_tokens("english")).cast("double").alias("x"), F.size(T.word_tokens("hinglish")).cast("double").alias("y"))
    return c.groupBy("source").agg(
        F.count("*").alias("rows"), F.round(F.avg(F.when(F.size("a") > 0, F.size(F.array_intersect("a", "b")) / F.size("a"))), 9).alias("digits_kept"), F.count(F.when(F.size("a") > 0, 1)).alias("with_digits"),
        F.avg(F.when(F.size(F.array_except("b", "a")) > 0, 1.0).otherwise(0.0)).alias("invented"), F.round(F.corr("x", "y"), 6).alias("length_corr"),
    )


@query("WITH c AS (SELECT len(" + S_WORDS.format("english") + ")::DOUBLE AS x, len(" + S_WORDS.format("hinglish") + ")::DOUBLE AS y FROM raw_records), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM c) SELECT round((SELECT corr(x, y) FROM c), 6) AS pearson, round((SELECT corr(rx, ry) FROM r), 6) AS spearman")
def correlations(s, d):
    """Average ranks come from the table of distinct lengths, never a sort of all rows."""
    c = _raw(s, d).select(F.size(T.word_tokens("english")).alias("x"), F.size(T.word_tokens("hinglish")).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    c = materialise(c, "lengths")

    def ranks(v):  # one row per distinct length
        t = c.groupBy(v).agg(F.sum("n").alias("m"))
        return t.select(v, (F.sum("m").over(W.orderBy(v)) - F.col("m") + (F.col("m") + 1) / 2).alias("r" + v))

    j = c.join(F.broadcast(ranks("x")), "x").join(F.broadcast(ranks("y")), "y")

    def weighted(a, b):
        n, sa, sb = F.sum("n"), F.sum(F.col("n") * F.col(a)), F.sum(F.col("n") * F.col(b))
        cov = F.sum(F.col("n") * F.col(a) * F.col(b)) - sa * sb / n
        va, vb = F.sum(F.col("n") * F.col(a) * F.col(a)) - sa * sa / n, F.sum(F.col("n") * F.col(b) * F.col(b)) - sb * sb / n
        return F.round(cov / F.sqrt(va * vb), 6)

    return j.agg(weighted("x", "y").alias("pearson"), weighted("rx", "ry").alias("spearman"))


@query("WITH p AS (SELECT seq, list_concat(" + S_TOKENS.format("english") + ", " + S_TOKENS.format("hindi") + ") AS e, " + S_TOKENS.format("hinglish") + " AS h FROM prepared_records), w AS (SELECT seq, lower(unnest(h)) AS t FROM p), a AS (SELECT seq, t, count(*) AS n FROM w GROUP BY ALL), v AS (SELECT seq, lower(unnest(e)) AS t FROM p), b AS (SELECT seq, t, count(*) AS m FROM v GROUP BY ALL) "
       "SELECT a.seq, sum(greatest(n - greatest(coalesce(m, 0), 1), 0))::BIGINT AS excess FROM a LEFT JOIN b ON a.seq = b.seq AND a.t = b.t GROUP BY a.seq HAVING sum(greatest(n - greatest(coalesce(m, 0), 1), 0)) > 0")  # fmt: skip
def repeated_tokens(s, d):
    """Tokens repeated beyond both sources together, counted within the row, no shuffle."""
    low = lambda c: F.transform(T.tokens(c), F.lower)
    n = lambda a, t: F.size(F.filter(a, lambda x: x == t))

    def excess(v):
        over = F.transform(F.array_distinct(v["h"]), lambda t: F.greatest(n(v["h"], t) - F.greatest(n(v["e"], t), F.lit(1)), F.lit(0)))
        return F.aggregate(over, F.lit(0), lambda a, x: a + x)

    p = _prep(s, d).select("seq", T.let(F.struct(F.concat(low("english"), low("hindi")).alias("e"), low("hinglish").alias("h")), excess).cast("long").alias("excess"))
    return p.where("excess > 0")


@query("WITH p AS (SELECT seq, list_transform(" + S_WORDS.format("english") + ", lambda x: lower(x)) AS e, list_transform(" + S_WORDS.format("hinglish") + ", lambda x: lower(x)) AS h FROM prepared_records), u AS (SELECT seq, e, h, list_filter(list_distinct(e), lambda t: len(list_filter(e, lambda z: z = t)) = 1 AND len(list_filter(h, lambda z: z = t)) = 1) AS s FROM p), "
       "x AS (SELECT seq, unnest(s) AS t, e, h FROM u), y AS (SELECT seq, list_position(e, t) AS i, list_position(h, t) AS j FROM x) SELECT a.seq, count(*) AS pairs, count(*) FILTER (WHERE a.j > b.j) AS inversions FROM y a JOIN y b ON a.seq = b.seq AND a.i < b.i GROUP BY a.seq")  # fmt: skip
def order_inversions(s, d):
    """Shared words in another order, counted within the row."""
    low = lambda c: F.transform(T.word_tokens(c), F.lower)
    once = lambda a, t: F.size(F.filter(a, lambda x: x == t)) == 1

    def positions(v):
        return F.transform(F.filter(v["e"], lambda t: once(v["e"], t) & once(v["h"], t)), lambda t: F.array_position(v["h"], t))

    def inversions(j):
        each = F.transform(j, lambda x, i: F.size(F.filter(j, lambda y, k: (k > i) & (y < x))))
        return F.struct(F.size(j).alias("n"), F.aggregate(each, F.lit(0), lambda a, x: a + x).alias("inv"))

    v = F.struct(low("english").alias("e"), low("hinglish").alias("h"))
    p = _prep(s, d).select("seq", T.let(v, lambda w: T.let(positions(w), inversions)).alias("x"))
    return p.select("seq", F.expr("1L * x.n * (x.n - 1) div 2").alias("pairs"), F.col("x.inv").cast("long").alias("inversions")).where("pairs > 0")


@query("WITH w AS (SELECT unnest(" + S_WORDS.format("text") + ") AS w, source FROM (SELECT text, lower(trim(source)) AS source FROM documents)) SELECT source, count(*) AS words, sum(strlen(w))::DOUBLE / count(*)::DOUBLE AS bytes_per_word, avg(CASE WHEN strlen(w) > 4 THEN 1.0 ELSE 0.0 END) AS long_share, count(DISTINCT w) AS types FROM w GROUP BY source")
def fertility(s, d):
    """Cost of words in bytes per source; words collapse before any costing."""
    w = table(s, d, "documents").select(F.lower(F.trim("source")).alias("source"), F.explode(T.word_tokens("text")).alias("w")).groupBy("source", "w").agg(F.count("*").alias("n"))
    b = F.octet_length("w")
    return w.groupBy("source").agg(F.sum("n").alias("words"), (F.sum(F.col("n") * b) / F.sum("n")).alias("bytes_per_word"), (F.sum(F.when(b > 4, F.col("n")).otherwise(0)) / F.sum("n")).alias("long_share"), F.count("*").alias("types"))


def _ascii(c):
    """Characters outside ASCII to one stand-in, as the SQL side counts bytes."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


@query("WITH r AS (SELECT " + S_KEY.format("english") + " AS k, min(seq) AS lead FROM prepared_records GROUP BY 1), x AS (SELECT p.seq, r.lead, p.hinglish AS ref, q.hinglish AS hyp FROM prepared_records p JOIN r ON " + S_KEY.format("p.english") + " = r.k JOIN prepared_records q ON q.seq = r.lead WHERE p.seq <> r.lead) SELECT lead, seq, levenshtein(regexp_replace(coalesce(hyp, ''), '[^\x00-\x7F]', '?', 'g'), regexp_replace(coalesce(ref, ''), '[^\x00-\x7F]', '?', 'g'))::INT AS edits, length(coalesce(ref, '')) AS chars FROM x")
def rendering_edits(s, d):
    """Character edits between a source's first rendering and each other one."""
    p = _prep(s, d).select("seq", F.md5(T.dedup_key("english")).alias("k"), F.coalesce("hinglish", F.lit("")).alias("h"))
    lead = p.groupBy("k").agg(F.min("seq").alias("lead"), F.min_by("h", "seq").alias("hyp"))
    return p.join(lead, "k").where("seq <> lead").select("lead", "seq", F.levenshtein(_ascii("hyp"), _ascii("h")).alias("edits"), F.length("h").alias("chars"))


@query("SELECT english, len(list(h ORDER BY seq)) AS n_refs, md5(array_to_string(list(h ORDER BY seq), chr(10))) AS refs_md5 FROM (SELECT " + S_KEY.format("english") + " AS english, coalesce(hinglish, '') AS h, seq FROM prepared_records WHERE lower(trim(split)) = 'test') GROUP BY english")
def reference_sets(s, d):
    """Ordered references of every test source."""
    t = _prep(s, d).where("split = 'test'").select(T.dedup_key("english").alias("english"), F.struct("seq", F.coalesce("hinglish", F.lit("")).alias("h")).alias("x"))
    g = t.groupBy("english").agg(F.sort_array(F.collect_list("x")).alias("r"))
    return g.select("english", F.size("r").alias("n_refs"), F.md5(F.array_join(F.transform("r", lambda x: x["h"]), "\n")).alias("refs_md5"))


@query("SELECT seq FROM raw_records ORDER BY sha256('42|' || seq::VARCHAR) LIMIT 100")
def hash_sample(s, d):
    """A seeded sample of 100, the feature of a sampling operator."""
    return _raw(s, d).select("seq").orderBy(F.sha2(F.concat(F.lit("42|"), F.col("seq").cast("string")), 256)).limit(100)


@query("SELECT column_name, missing, missing::DOUBLE / n AS share FROM (SELECT count(*) AS n, count(*) FILTER (WHERE english IS NULL OR regexp_matches(english, '^\\s*$')) AS english, count(*) FILTER (WHERE hindi IS NULL OR regexp_matches(hindi, '^\\s*$')) AS hindi, count(*) FILTER (WHERE hinglish IS NULL OR regexp_matches(hinglish, '^\\s*$')) AS hinglish FROM raw_records) UNPIVOT (missing FOR column_name IN (english, hindi, hinglish))")
def missing_profile(s, d):
    """A41."""
    cols = ["english", "hindi", "hinglish"]
    a = _raw(s, d).agg(F.count("*").alias("n"), *[F.count(F.when(F.col(c).isNull() | F.col(c).rlike(r"\A\s*\z"), 1)).alias(c) for c in cols])
    return a.select("n", F.expr("stack(3, 'english', english, 'hindi', hindi, 'hinglish', hinglish) as (column_name, missing)")).select("column_name", "missing", (F.col("missing") / F.col("n")).alias("share"))
