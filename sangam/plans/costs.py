"""Tokenizer panels: cost of words, of spelling variants, and spread over tokenizers.

A tokenizer here is a function from a word Column to its number of tokens, so the panel runs in
the JVM over distinct words; :func:`counted` takes any Python tokenizer instead.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sangam.functions import text as T
from sangam.plans.corpus import S_LEX, S_WORDS, _lexicon
from sangam.session import materialise, table

Q: dict = {}
SQL: dict[str, str] = {}

#: Tokenizers of the panel: pieces of three characters, of two bytes, and vowel groups.
PANEL: dict[str, Callable[[Column], Column]] = {
    "chars3": lambda w: F.ceil(F.length(w) / 3),
    "bytes2": lambda w: F.ceil(F.octet_length(w) / 2),
    "vowels": lambda w: F.greatest(F.regexp_count(w, F.lit("[aeiou]+")), F.lit(1)),
}
S_PANEL = (
    "(SELECT *, unnest(['chars3', 'bytes2', 'vowels']) AS tok, unnest([least(ceil(length(w) / 3.0), ceil((length(w) + 1) / 3.0)), least(ceil(strlen(w) / 2.0), ceil((strlen(w) + 1) / 2.0)), greatest(len(regexp_extract_all(w, '[aeiou]+')), 1)])::BIGINT AS cost FROM {0})"
)


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def word_cost(tokenizer: Callable[[Column], Column], word: Column) -> Column:
    """Tokens of a word: the cheaper of bare and after a blank, as it stands in running text."""
    return F.least(tokenizer(word), tokenizer(F.concat(F.lit(" "), word))).cast("long")


def counted(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """A panel tokenizer of any Python function from text to tokens, over Arrow batches of distinct words."""

    @F.pandas_udf("long")
    def count(words: pd.Series) -> pd.Series:
        return words.map(lambda w: len(encode(w)))

    return count


def costed(words: DataFrame, panel: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """words (…, w) times the panel: with ``tok`` and ``cost``.  One expression for each tokenizer, no join."""
    each = F.array(*[F.struct(F.lit(k).alias("tok"), word_cost(f, F.col("w")).alias("cost")) for k, f in (panel or PANEL).items()])
    return words.select("*", F.explode(each).alias("_x")).select(*words.columns, "_x.tok", "_x.cost")


def fertility_stats(words: DataFrame, by: str) -> DataFrame:
    """Per tokenizer and ``by``, of distinct words (by, w, n): cost per word and byte, and shares.

    ``word_level``, ``continued`` and ``severe``: shares of occurrences of one, two or more, and
    four or more tokens; ``fallback``: of words with a letter outside ASCII; ``coverage``: of
    types that are one token.
    """
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    c = F.col("cost")
    return costed(words).groupBy("tok", by).agg(
        F.sum("n").alias("words"), (F.sum(F.col("n") * c) / F.sum("n")).alias("tokens_per_word"), (F.sum(F.col("n") * F.octet_length("w")) / F.sum(F.col("n") * c)).alias("bytes_per_token"),
        share(c == 1).alias("word_level"), share(c >= 2).alias("continued"), share(c >= 4).alias("severe"), share(F.col("w").rlike(r"[^\x00-\x7F]")).alias("fallback"), (F.sum(F.when(c == 1, 1).otherwise(0)) / F.count("*")).alias("coverage"),
    )


_DOCS = "(SELECT slice, w, count(*) AS n FROM (SELECT lower(trim(source)) AS slice, lower(unnest(" + S_WORDS.format("text") + ")) AS w FROM documents) GROUP BY ALL)"
_STATS = (
    "SELECT tok, slice, sum(n)::BIGINT AS words, sum(n * cost)::DOUBLE / sum(n) AS tokens_per_word, sum(n * strlen(w))::DOUBLE / sum(n * cost) AS bytes_per_token, sum(CASE WHEN cost = 1 THEN n ELSE 0 END)::DOUBLE / sum(n) AS word_level, "
    "sum(CASE WHEN cost >= 2 THEN n ELSE 0 END)::DOUBLE / sum(n) AS continued, sum(CASE WHEN cost >= 4 THEN n ELSE 0 END)::DOUBLE / sum(n) AS severe, sum(CASE WHEN regexp_matches(w, '[^\\x00-\\x7F]') THEN n ELSE 0 END)::DOUBLE / sum(n) AS fallback, sum(CASE WHEN cost = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS coverage FROM "
    + S_PANEL.format(_DOCS) + " GROUP BY tok, slice"
)


def _slices(s, d):
    w = table(s, d, "documents").select(F.lower(F.trim("source")).alias("slice"), F.explode(T.word_tokens("text")).alias("w"))
    return w.groupBy("slice", F.lower("w").alias("w")).agg(F.count("*").alias("n"))


@query(_STATS)
def fertility_panel(s, d):
    """Cost of running text on each tokenizer, words collapsed before they are costed."""
    return fertility_stats(_slices(s, d), "slice")


@query("WITH st AS (" + _STATS + ") SELECT tok, max(tokens_per_word) / min(tokens_per_word) AS ratio, arg_min(coalesce(slice, ''), (round(tokens_per_word, 9), coalesce(slice, ''))) AS cheapest, arg_max(coalesce(slice, ''), (round(tokens_per_word, 9), coalesce(slice, ''))) AS dearest, count(*) AS slices FROM st GROUP BY tok")
def panel_spread(s, d):
    """How unequal each tokenizer is over the slices."""
    f = fertility_stats(_slices(s, d), "slice").withColumn("slice", F.coalesce("slice", F.lit("")))
    f = f.withColumn("k", F.struct(F.round("tokens_per_word", 9), "slice"))
    return f.groupBy("tok").agg((F.max("tokens_per_word") / F.min("tokens_per_word")).alias("ratio"), F.min_by("slice", "k").alias("cheapest"), F.max_by("slice", "k").alias("dearest"), F.count("*").alias("slices"))


@query("WITH st AS (" + _STATS + ") SELECT slice, max(CASE WHEN tok = 'chars3' THEN tokens_per_word END) AS chars3, max(CASE WHEN tok = 'bytes2' THEN tokens_per_word END) AS bytes2, max(CASE WHEN tok = 'vowels' THEN tokens_per_word END) AS vowels FROM st GROUP BY slice")
def panel_pivot(s, d):
    """Tokens per word by slice, a column for each tokenizer."""
    f = fertility_stats(_slices(s, d), "slice")
    return f.groupBy("slice").pivot("tok", list(PANEL)).agg(F.max("tokens_per_word"))


_BURDEN = S_LEX + ", c AS (SELECT * FROM " + S_PANEL.format("(SELECT label, form AS w FROM lex)") + "), g AS (SELECT tok, label, count(*) AS n_variants, avg(cost) AS mean_tokens, min(cost) AS min_tokens, max(cost) AS max_tokens, max(cost) - min(cost) AS spread, count(*) FILTER (WHERE cost = 1) AS single FROM c GROUP BY ALL)"


def _variants(s):
    c = costed(_lexicon(s).select("label", F.col("form").alias("w")))
    return c, c.groupBy("tok", "label").agg(F.count("*").alias("n_variants"), F.avg("cost").alias("mean_tokens"), F.min("cost").alias("min_tokens"), F.max("cost").alias("max_tokens"), (F.max("cost") - F.min("cost")).alias("spread"), F.count(F.when(F.col("cost") == 1, 1)).alias("single"))


@query("WITH " + _BURDEN + " SELECT * FROM g")
def variant_costs(s, d):
    """Tokens of every spelling of each group."""
    return _variants(s)[1]


@query("WITH " + _BURDEN + " SELECT tok, avg(mean_tokens) AS burden, sum(single)::DOUBLE / sum(n_variants) AS single_rate, max(spread) AS widest FROM g GROUP BY tok")
def variant_burden(s, d):
    """The mean of the groups' means, and how many spellings are one token."""
    return _variants(s)[1].groupBy("tok").agg(F.avg("mean_tokens").alias("burden"), (F.sum("single") / F.sum("n_variants")).alias("single_rate"), F.max("spread").alias("widest"))


@query("WITH " + _BURDEN + " SELECT label, count(*) AS toks, min(mean_tokens) AS least, avg(mean_tokens) AS mean FROM g GROUP BY label HAVING count(*) = 3 AND min(mean_tokens) > 1.01")
def paid_everywhere(s, d):
    """Groups that cost more than one token on every tokenizer."""
    g = _variants(s)[1].groupBy("label").agg(F.count("*").alias("toks"), F.min("mean_tokens").alias("least"), F.avg("mean_tokens").alias("mean"))
    return g.where((F.col("toks") == len(PANEL)) & (F.col("least") > 1.01))


@query("WITH " + _BURDEN + ", o AS (SELECT label, form, count(*) AS n FROM (SELECT lower(unnest(" + S_WORDS.format("hinglish") + ")) AS form FROM transformed_records) JOIN lex USING (form) GROUP BY ALL), "
       "wt AS (SELECT tok, o.label, sum(n)::BIGINT AS occurrences, sum(n * cost)::DOUBLE / sum(n) AS weighted FROM o JOIN c ON c.label = o.label AND c.w = o.form GROUP BY ALL) SELECT tok, count(*) AS groups, sum(occurrences)::BIGINT AS occurrences, round(sum(occurrences * weighted) / sum(occurrences), 9) AS weighted_cost, round(avg(mean_tokens), 9) AS unweighted_cost FROM wt JOIN g USING (tok, label) GROUP BY tok")  # fmt: skip
def weighted_cost(s, d):
    """Cost weighted by what is written, beside the unweighted burden; a form without a cost is an error."""
    w = table(s, d, "transformed_records").select(F.explode(T.word_tokens("hinglish")).alias("f")).groupBy(F.lower("f").alias("w")).agg(F.count("*").alias("n"))
    o = materialise(w.join(F.broadcast(_lexicon(s).withColumnRenamed("form", "w")), "w"), "forms")
    c, g = _variants(s)
    j = o.join(F.broadcast(c), ["label", "w"], "left")
    j = j.where(F.when(F.col("cost").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("form without cost")).cast("boolean")))
    x = j.groupBy("tok", "label").agg(F.sum("n").alias("occurrences"), (F.sum(F.col("n") * F.col("cost")) / F.sum("n")).alias("weighted")).join(g, ["tok", "label"])
    return x.groupBy("tok").agg(F.count("*").alias("groups"), F.sum("occurrences").alias("occurrences"), F.round(F.sum(F.col("occurrences") * F.col("weighted")) / F.sum("occurrences"), 9).alias("weighted_cost"), F.round(F.avg("mean_tokens"), 9).alias("unweighted_cost"))
