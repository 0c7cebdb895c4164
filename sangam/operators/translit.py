"""Devanagari to Roman letters, word by word."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Consonants, independent vowels and vowel signs in code-point order; letters changed by a dot below.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h".split()))
VOWELS = dict(zip("अआइईउऊऋएऐओऔ", "a aa i ee u oo ri e ai o au".split()))
SIGNS = dict(zip("ािीुूृेैोौ", "aa i ee u oo ri e ai o au".split()))
DOTTED = {"क": "q", "ख": "kh", "ग": "gh", "ज": "z", "ड": "d", "ढ": "dh", "फ": "f", "य": "y"}
DIGITS = {chr(0x966 + i): str(i) for i in range(10)}
# Long vowels are written short at a word's end.
ENDINGS = {"aa": "a", "ee": "i", "oo": "u"}

# One written syllable: a cluster of consonants, the last with a vowel, or a vowel alone; then nasal or breath.
_C = "[क-ह]़?"
_SYLLABLE = re.compile(rf"(?P<head>(?:{_C}्)*)(?P<last>{_C})(?P<sign>[ा-ौ]|्)?(?P<tail>[ंँः]*)|(?P<vowel>[अ-औ])(?P<close>[ंँः]*)|(?P<other>.)", re.S)
_TAIL = str.maketrans({"ं": "n", "ँ": "n", "ः": "h"})


def _cluster(letters: str) -> str:
    """Roman letters of joined consonants."""
    return "".join(DOTTED.get(c, CONSONANTS.get(c, c)) if dot else CONSONANTS.get(c, c) for c, dot in re.findall("([क-ह])(़?)", letters))


def syllables(word: str) -> list[tuple[str, str, str]]:
    """(consonants, vowel, close) of each written syllable; '?' is the vowel that is spoken but not written."""
    out = []
    for m in _SYLLABLE.finditer(unicodedata.normalize("NFC", word)):  # dotted letters as letter and dot
        if m["last"]:
            vowel = "" if m["sign"] == "्" else SIGNS.get(m["sign"], "a") if m["sign"] else "?"
            out.append((_cluster(m["head"] + m["last"]), vowel, m["tail"].translate(_TAIL)))
        elif m["vowel"]:
            out.append(("", VOWELS.get(m["vowel"], "a"), m["close"].translate(_TAIL)))
        else:
            c = m["other"]
            out.append((DIGITS.get(c, "." if c == "।" else "" if c in "़्" else SIGNS.get(c, c)), "", ""))
    return out


# What becomes of the unwritten vowel '?', on the word's syllables spelt one letter each:
# V a vowel that is spoken, ? one that is not written, x one without a vowel, or no syllable, . one that is closed.
_SILENT = re.compile(r"(?<=[V?.])\?$|(?<=[V?.])\?(?=V)")


def romanise_word(word: str) -> str:
    """Syllables joined; the unwritten vowel is silent at the end of a word and between a vowel and a written one."""
    s = syllables(word)
    shape = "".join("." if close else "x" if not vowel else "?" if vowel == "?" else "V" for _, vowel, close in s)
    silent = {m.start() for m in _SILENT.finditer(shape) if m.start()}
    out = [on + ("" if i in silent else "a" if v == "?" else v) + close for i, (on, v, close) in enumerate(s)]
    if s and not s[-1][2] and len(s) > 1 and s[-1][1] in ENDINGS:
        out[-1] = s[-1][0] + ENDINGS[s[-1][1]]
    return "".join(out)


@F.pandas_udf(StringType())
def romanise_udf(words: pd.Series) -> pd.Series:
    return words.map(romanise_word)


def vote_lexicon(votes: DataFrame) -> DataFrame:
    """(native, latin) most attested of votes (native, latin, n); ties alphabetical."""
    g = votes.groupBy("native", "latin").agg(F.sum("n").alias("n"))
    return g.groupBy("native").agg(F.min_by("latin", F.struct(-F.col("n"), F.col("latin"))).alias("latin"))


def romanise(df: DataFrame, id_col: str, text: str, lexicon: DataFrame | None = None) -> DataFrame:
    """(id_col, romanised, from_lexicon, from_rules): lexicon first, then rules, else as it is.

    The rules run once per distinct word, which is joined back, so a frequent word costs one
    call; blanks and punctuation stay where they stand.  Null texts are left out.
    """
    cut = F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+"), F.lit(0))  # words, and what stands between them as it is
    toks = df.where(F.col(text).isNotNull()).select(id_col, F.posexplode_outer(cut).alias("pos", "w")).na.fill("", ["w"]).na.fill(0, ["pos"])
    native = F.col("w").rlike(r"[\x{0900}-\x{097F}]")
    dist = toks.select("w").distinct()
    if lexicon is not None:
        dist = dist.join(lexicon.withColumnRenamed("native", "w"), "w", "left")
    else:
        dist = dist.withColumn("latin", F.lit(None).cast("string"))
    dist = dist.withColumn("out", F.coalesce("latin", F.when(native, romanise_udf("w")).otherwise(F.col("w"))))
    path = F.when(F.col("latin").isNotNull(), "lexicon").when(native, "rules").otherwise("kept")
    j = toks.join(dist.select("w", "out", path.alias("path")), "w")
    n = lambda p: F.count(F.when(F.col("path") == p, 1))
    g = j.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "out"))).alias("s"), n("lexicon").alias("from_lexicon"), n("rules").alias("from_rules"))
    return g.select(id_col, F.array_join(F.transform("s", lambda x: x["out"]), "").alias("romanised"), "from_lexicon", "from_rules")
