"""Translation metrics as additive statistics, and decision rules on scores."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS, WORDS, BETA = 6, 2, 2.0
SLOTS = (
    [f"chrf_{w}_{k}{n}" for k, top in (("c", CHARS), ("w", WORDS)) for n in range(1, top + 1) for w in ("hyp", "ref", "hit")]
    + ["bleu_len_hyp", "bleu_len_ref"] + [f"bleu_{w}{n}" for n in range(1, 5) for w in ("hit", "all")] + ["rouge", "edits", "ref_words", "n"]
)
_PUNCT = re.compile(r"([^\w\s])")


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def edit_distance(a: list[str], b: list[str]) -> int:
    """Token edits turning a into b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of tokens."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def statistics(hyp: str, ref: str) -> list[float]:
    """The additive slots of one sentence against one reference."""
    out: list[float] = []
    views = [(re.sub(r"\s", "", hyp), re.sub(r"\s", "", ref), CHARS), (_PUNCT.sub(r" \1 ", hyp).split(), _PUNCT.sub(r" \1 ", ref).split(), WORDS)]
    for h, r, top in views:
        for n in range(1, top + 1):
            x, y = _grams(h, n), _grams(r, n)
            out += [sum(x.values()), sum(y.values()), sum((x & y).values())]
    h, r = views[1][0], views[1][1]
    out += [len(h), len(r)]
    for n in range(1, 5):
        x, y = _grams(h, n), _grams(r, n)
        out += [sum((x & y).values()), sum(x.values())]
    hw, rw = hyp.lower().split(), ref.lower().split()
    common = lcs(hw, rw)
    out += [2 * common / (len(hw) + len(rw)) if common else 0.0, edit_distance(hw, rw), len(rw), 1]
    return out


def best_statistics(hyp: str, refs: list[str]) -> list[float]:
    """Statistics against the reference with the best chrF++; ties go to the first, empty references are skipped."""
    rows = [statistics(hyp, r) for r in refs if r.strip()] or [statistics(hyp, "")]
    return max(rows, key=chrf)


def chrf(s) -> float:
    """chrF++ of summed slots."""
    p, r, k = 0.0, 0.0, 0
    for i in range(CHARS + WORDS):
        h, f, m = s[3 * i : 3 * i + 3]
        if h > 0 and f > 0:
            p, r, k = p + m / h, r + m / f, k + 1
    if not k or p + r == 0:
        return 0.0
    p, r = p / k, r / k
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r) if p and r else 0.0


def bleu(s) -> float:
    """BLEU of summed slots: orders 1 to 4, brevity penalty, zero matches smoothed by halving."""
    at = 3 * (CHARS + WORDS)
    lh, lr, rest = s[at], s[at + 1], s[at + 2 : at + 10]
    logs, smooth = 0.0, 1.0
    for n in range(4):
        hit, total = rest[2 * n], rest[2 * n + 1]
        if total == 0:
            return 0.0
        if hit == 0:
            smooth *= 2
            hit = 1 / smooth
        logs += math.log(hit / total)
    return 100 * math.exp(min(0.0, 1 - lr / lh) if lh else -100.0) * math.exp(logs / 4) if lh else 0.0


def corpus_scores(df: DataFrame, by: str) -> DataFrame:
    """(by, sentences, chrf, bleu, rouge_l, wer) of pairs (hyp, ref): slots are summed, then scored.

    Slots come from one Arrow pass; sums combine on the map side.  Null texts count as
    empty; a group without reference words has a null error rate.
    """
    schema = f"`{by}` string, " + ", ".join(f"`{c}` double" for c in SLOTS)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = np.array([statistics(h or "", r or "") for h, r in zip(pdf["hyp"], pdf["ref"])], dtype=float).reshape(-1, len(SLOTS))
            out = pd.DataFrame(rows, columns=SLOTS)
            out.insert(0, by, pdf[by].to_numpy())
            yield out

    @F.pandas_udf("double")
    def f_chrf(x: pd.Series) -> pd.Series:
        return x.map(chrf)

    @F.pandas_udf("double")
    def f_bleu(x: pd.Series) -> pd.Series:
        return x.map(bleu)

    g = df.select(F.col(by).cast("string"), "hyp", "ref").mapInPandas(run, schema).groupBy(by).agg(*[F.sum(c).alias(c) for c in SLOTS])
    all_ = F.array(*SLOTS)
    return g.select(by, F.col("n").cast("long").alias("sentences"), f_chrf(all_).alias("chrf"), f_bleu(all_).alias("bleu"), (F.col("rouge") / F.col("n")).alias("rouge_l"), F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")).alias("wer"))


def null_threshold(std: Column) -> Column:
    """Twice the seed deviation, at least 1; 1 where it is unknown."""
    return F.when(std.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), 2 * std))


def verdict(gain: Column, threshold: Column) -> Column:
    return F.when(gain > threshold, "improvement").when(-gain > threshold, "worse").otherwise("null")


def multi_reference_scores(pairs: DataFrame, by: str, item: str) -> DataFrame:
    """(by, sentences, chrf, rouge_l, wer) of pairs (by, item, pos, hyp, ref), a row per reference.

    Every metric takes the reference its own sentence score likes best, the first by ``pos`` of
    equals; empty references are skipped where there are others.  Each pair is scored once, in one
    Arrow pass, and the best is an aggregate that combines on the map side, so references are
    never gathered.  Null texts count as empty.
    """
    schema = f"`{by}` string, `{item}` string, pos long, blank boolean, rate double, top double, " + ", ".join(f"`{c}` double" for c in SLOTS)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = np.array([statistics(h or "", r or "") for h, r in zip(pdf["hyp"], pdf["ref"])], dtype=float).reshape(-1, len(SLOTS))
            out = pd.DataFrame(rows, columns=SLOTS)
            out.insert(0, "top", [-chrf(r) for r in rows])
            out.insert(0, "rate", out["edits"] / out["ref_words"].clip(lower=1))
            out.insert(0, "blank", [not (r or "").strip() for r in pdf["ref"]])
            for n, c in enumerate((by, item, "pos")):
                out.insert(n, c, pdf[c].to_numpy())
            yield out

    @F.pandas_udf("double")
    def f_chrf(x: pd.Series) -> pd.Series:
        return x.map(chrf)

    x = pairs.select(F.col(by).cast("string"), F.col(item).cast("string"), F.col("pos").cast("long"), "hyp", "ref").mapInPandas(run, schema)
    chars = [c for c in SLOTS if c.startswith("chrf")]
    best = x.groupBy(by, item).agg(
        F.min_by(F.struct(*chars), F.struct("blank", "top", "pos")).alias("c"), F.min(F.struct("blank", (-F.col("rouge")).alias("f")))["f"].alias("rouge"),
        F.min_by(F.struct("edits", "ref_words"), F.struct("blank", "rate", "pos")).alias("w"),
    )
    g = best.groupBy(by).agg(F.count("*").alias("sentences"), *[F.sum(F.col("c")[c]).alias(c) for c in chars], F.avg(-F.col("rouge")).alias("rouge_l"), F.sum(F.col("w")["edits"]).alias("e"), F.sum(F.col("w")["ref_words"]).alias("n"))
    return g.select(by, "sentences", f_chrf(F.array(*chars)).alias("chrf"), "rouge_l", F.when(F.col("n") > 0, F.col("e") / F.col("n")).alias("wer"))


def word_grams(words: Column, top: int = 4) -> Column:
    """Structs (n, gram) of all runs of 1 to ``top`` words of an array, joined by blanks."""
    size = F.size(words)

    def of(n: int) -> Column:
        at = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("gram")))

    return F.concat(*[of(n) for n in range(1, top + 1)])


def multi_reference_bleu(pairs: DataFrame, by: str, item: str) -> DataFrame:
    """(by, hyp_words, ref_words, hit1.., all1.., bleu) of pairs (by, item, pos, hyp, ref): BLEU against several references.

    Counts of an item's n-grams are clipped by the most any of its references has, the
    reference length is the closest, the shorter of equals, and orders without a hit are smoothed by
    halving.  All in the JVM: n-grams are counted, joined and summed, none gathered.
    """
    words = lambda c: F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), " +"), lambda w: w != "")
    p = pairs.select(by, item, "pos", words("hyp").alias("h"), words("ref").alias("r"))
    one = p.groupBy(by, item).agg(F.min_by("h", "pos").alias("h"), F.min(F.struct(F.abs(F.size("h") - F.size("r")).alias("d"), F.size("r").alias("l")))["l"].alias("l"))
    lengths = one.groupBy(by).agg(F.sum(F.size("h")).alias("hyp_words"), F.sum("l").alias("ref_words"))
    hc = one.select(by, item, F.explode(word_grams(F.col("h"))).alias("g")).groupBy(by, item, "g.n", "g.gram").agg(F.count("*").alias("c"))
    rc = p.select(item, "pos", "r").distinct().select(item, "pos", F.explode(word_grams(F.col("r"))).alias("g")).groupBy(item, "pos", "g.n", "g.gram").agg(F.count("*").alias("c")).groupBy(item, "n", "gram").agg(F.max("c").alias("m"))
    s = hc.join(rc, [item, "n", "gram"], "left").groupBy(by).agg(
        *[F.sum(F.when(F.col("n") == n, F.least("c", F.coalesce("m", F.lit(0)))).otherwise(0)).alias(f"hit{n}") for n in range(1, 5)], *[F.sum(F.when(F.col("n") == n, F.col("c")).otherwise(0)).alias(f"all{n}") for n in range(1, 5)]
    )
    x = lengths.join(s, by)
    logs, halves = F.lit(0.0), F.lit(0.0)
    for n in range(1, 5):
        hit, all_ = F.col(f"hit{n}"), F.col(f"all{n}")
        halves = halves + F.when(hit == 0, 1.0).otherwise(0.0)
        logs = logs + F.when(hit > 0, F.ln(hit / all_)).otherwise(-halves * F.ln(F.lit(2.0)) - F.ln(all_.cast("double")))
    short = F.least(F.lit(0.0), 1 - F.col("ref_words") / F.col("hyp_words"))
    full = F.least(*[F.col(f"all{n}") for n in range(1, 5)]) > 0
    return x.withColumn("bleu", F.when(full, 100 * F.exp(short + logs / 4)).otherwise(0.0))
