from pyspark.sql import functions as F

from sangam.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x")).first()[0]


def test_keys(spark):
    assert one(spark, "  Hello,\tWORLD !! ", T.dedup_key) == "hello world"
    assert one(spark, " a  \n b ", T.normalise) == "a b"
    assert one(spark, None, T.dedup_key) == "" and one(spark, None, T.normalise) == ""
    assert one(spark, "a_b-c", T.folded) == "a b c"


def test_tokens(spark):
    assert one(spark, "don't go_1 !", T.tokens) == ["don't", "go_1", "!"]
    assert one(spark, "_ a 1", T.word_tokens) == ["a", "1"]
    assert one(spark, None, T.tokens) == []


def test_script_and_shingles(spark):
    assert one(spark, "कa", T.script_fraction) == 0.5
    assert one(spark, " ", T.script_fraction) == 0.0
    assert one(spark, "abcde", lambda c: T.shingles(F.col(c))) == ["abcd", "bcde"]
    assert one(spark, "ab", lambda c: T.shingles(F.col(c))) == ["ab"]
    assert one(spark, "", lambda c: T.shingles(F.col(c))) == []


def test_eval_normaliser(spark):
    assert one(spark, "Nahiiii!!  main", lambda c: T.squash_runs(T.fold_eval(c))) == "nahi main"
    assert one(spark, "1000", T.squash_runs) == "1000"
    assert one(spark, "keenaa", T.fold_vowels) == "kina"


def test_long_text(spark):
    assert one(spark, "ab " * 200_000, lambda c: F.size(T.tokens(c))) == 200_000
