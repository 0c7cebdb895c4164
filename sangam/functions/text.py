"""Text scalars as Column expressions: everything stays in the JVM.

Each function accepts a column name or Column.  Nulls count as the empty text unless
a docstring says otherwise.  The word class is ``[\\p{L}\\p{N}_]``, spelled out, as
Java's own ``\\w`` differs from it on combining marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
TOKEN = rf"{WORD}+(?:'{WORD}+)?|[^\p{{L}}\p{{N}}_\s]"
# Fixed value: the white space of Python's str.split, which normalisation collapses.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
DEVANAGARI = r"[^\x{0900}-\x{097F}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once: an expression used inside a lambda is else evaluated per element."""
    return F.transform(F.array(value), body)[0]


def normalise(x: Column | str) -> Column:
    """Collapse white space and trim; the input is taken to be NFC already."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), SPACE, " "))


def dedup_key(x: Column | str) -> Column:
    """Lower-cased words joined by single blanks; the key exact duplicates share."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), rf"[^\p{{L}}\p{{N}}_]+", " "))


def folded(x: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits made one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def tokens(x: Column | str) -> Column:
    """Words (with one inner apostrophe part) and single symbols, in order."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(TOKEN), F.lit(0))


def is_word(t: Column) -> Column:
    """A token with a letter or digit; a lone underscore is none."""
    return t.rlike(r"[\p{L}\p{N}]")


def word_tokens(x: Column | str) -> Column:
    return F.filter(tokens(x), is_word)


def script_fraction(x: Column | str, outside: str = DEVANAGARI) -> Column:
    """Share of non-space characters that are not matched by ``outside``; 0 for empty texts."""
    v = F.coalesce(_c(x), F.lit(""))
    n = F.length(F.regexp_replace(v, r"\s", ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(v, outside, "")) / n)


def content_id(english: Column | str, other: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of both keys, tab-joined."""
    return F.substring(F.sha2(F.concat_ws("\t", dedup_key(english), dedup_key(other)), 256), 1, 16)


def shingles(key: Column, k: int = 4) -> Column:
    """Distinct k-character substrings; a shorter key is its own shingle, an empty one has none."""
    n = F.length(key)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(key, i, F.lit(k)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays; 1 when both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def fold_eval(x: Column | str) -> Column:
    """Evaluation fold: lower case, punctuation outside the Devanagari block to blanks, collapsed."""
    v = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^\p{L}\p{N}_\s\x{0900}-\x{097F}]", " ")
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def squash_runs(x: Column | str) -> Column:
    """Three or more of one letter become one; decimal digits stay."""
    return F.regexp_replace(_c(x), r"([\p{L}\p{Nl}\p{No}])\1{2,}", "$1")


def fold_vowels(x: Column | str) -> Column:
    """Long vowels to short ones: aa to a, ee and ii to i, oo and uu to u."""
    v = F.regexp_replace(_c(x), "aa+", "a")
    v = F.regexp_replace(v, "ee+|ii+", "i")
    return F.regexp_replace(v, "oo+|uu+", "u")


def lexicon_normal(x: Column, forms: dict[str, str]) -> Column:
    """Each blank-separated word to its label: by its form, else by its folded form, else just folded.

    ``forms``: form to label, a constant of some hundreds, tried in a literal map.
    """
    m = F.create_map(*[F.lit(v) for kv in forms.items() for v in kv])

    def one(t: Column) -> Column:
        return F.coalesce(F.try_element_at(m, t), F.try_element_at(m, fold_vowels(t)), fold_vowels(t))

    return F.array_join(F.transform(F.split(x, " "), one), " ")


def clean_output(x: Column | str) -> Column:
    """A model's answer: chat prefixes off, then the first line that is not blank; null or none gives the empty text."""
    v = F.coalesce(_c(x), F.lit(""))
    for _ in range(3):  # prefixes may be nested
        v = F.regexp_replace(v, r"(?i)^\s*(?:assistant|hinglish|translation|output|answer)\s*:\s*", "")
    return F.coalesce(F.get(F.filter(F.transform(F.split(v, "\n"), lambda v: F.trim(v)), lambda t: t != ""), F.lit(0)), F.lit(""))


def build_source(english: Column, hindi: Column, condition: str, separator: str = " | ") -> Column:
    """A model's input: english alone, or english and hindi; a missing Hindi side is an error there."""
    if condition == "english":
        return english
    blank = F.coalesce(F.trim(hindi), F.lit("")) == ""
    return F.when(blank, F.raise_error(F.lit("no Hindi side")).cast("string")).otherwise(F.concat(english, F.lit(separator), hindi))


def parse_codes(x: Column | str, codes: list[str]) -> Column:
    """Upper-cased codes of a cell, split at ; or ,: an error if one is unknown or OK stands with others."""
    c = F.array_distinct(F.filter(F.transform(F.split(F.upper(F.coalesce(_c(x), F.lit(""))), "[;,]"), lambda v: F.trim(v)), lambda v: v != ""))
    known = F.array(*[F.lit(v) for v in codes])
    bad = (F.size(F.array_except(c, known)) > 0) | (F.array_contains(c, "OK") & (F.size(c) > 1))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad codes: "), F.array_join(c, ","))).cast("array<string>")).otherwise(c)


# The rules of the older normaliser, in order.
LEGACY_RULES = (
    (r"(.)\1{2,}", "$1"), ("aa+", "a"), ("ee+", "i"), ("ii+", "i"), ("oo+", "u"), ("uu+", "u"),
    (r"n(?![\p{L}\p{N}_])", ""), ("h(?=[bcdfgjklmnpqrstvwxyz])", ""), (r"\s+", " "),
)


def legacy_normal(x: Column | str) -> Column:
    """The older nine-rule normaliser, kept to audit what it damaged."""
    v = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^\p{L}\p{N}_\s\x{0900}-\x{097F}]", " ")
    for pattern, by in LEGACY_RULES:
        v = F.regexp_replace(v, pattern, by)
    return F.trim(v)
