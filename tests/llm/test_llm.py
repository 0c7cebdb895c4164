"""The training-data operators against brute force, round trips and odd inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sangam.llm import boosting, cross_split, format_duplicates, grouped_splits, mixing, near_duplicates, packing, pair_defects, pii, term_counts, tokens
from sangam.operators import buckets, components, shingles, similar

RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 9))) for _ in range(300)]


def sentences(n, k=25):
    return [" ".join(RNG.choices(VOCAB, k=k)) for _ in range(n)]


def edited(t, n=1):
    w = t.split()
    for _ in range(n):
        w[RNG.randrange(len(w))] = "qqqq"
    return " ".join(w)


def brute(texts, t=0.7):
    return {(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b] and shingles.likeness(texts[a], texts[b]) >= t}


def test_checker_agrees_with_likeness():
    base = sentences(40) + ["", "ab", "abcd", "aaaaaaa"]
    every = base + [edited(t, k) for t in base[:40] for k in (1, 3, 6)]
    check = shingles.Checker(0.7)
    for _ in range(3000):
        x, y = RNG.choice(every), RNG.choice(every)
        v = shingles.likeness(x, y)
        assert check(x, y) == (v if v >= 0.7 else 0.0)


def test_winnow_does_not_depend_on_neighbours():
    texts = sentences(20) + ["", "short", "x" * 19, "y" * 20, "z" * 200]
    own, h, pos = shingles.winnow(texts)
    for i, t in enumerate(texts):
        o, h1, p1 = shingles.winnow([t])
        assert sorted(h[own == i]) == sorted(h1) and sorted(pos[own == i]) == sorted(p1)
    a = texts[0]
    b = "prefix " + a[10:80] + " suffix"
    assert set(shingles.winnow([a])[1]) & set(shingles.winnow([b])[1])


def test_hot_keys_come_back_as_members(spark):
    rows = [(7, i, 10, 3) for i in range(30)] + [(8, 1, 10, 1), (8, 2, 10, 2), (8, 3, 100, 2)]

    def run(it):
        for b in it:
            yield buckets.keyed_batch(*[np.array(c.to_pylist()) for c in b.columns], 4)

    k = spark.createDataFrame(rows, "key long, id long, n int, side int").repartition(3).mapInArrow(run, buckets.KEYED)
    out = buckets.bucket_pairs(k, 4, 0.7).collect()
    assert {r.a for r in out if r.b == buckets.HOT} == set(range(30))
    assert {(r.a, r.b) for r in out if r.b != buckets.HOT} == {(1, 2)}


@pytest.mark.parametrize("cap", [64, 2])
def test_near_duplicates(spark, cap):
    base = sentences(40)
    texts = dict(enumerate(base + [edited(t) for t in base[:15]] + [edited(base[0]) for _ in range(12)] + ["", "abc"]))
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {(r.a, r.b) for r in similar.similar_pairs(df.dropDuplicates(["text"]), 0.7, cap=cap).collect()}
    kept = {r.id: r.text for r in df.dropDuplicates(["text"]).collect()}
    want = {(a, b) for a in kept for b in kept if a < b and shingles.likeness(kept[a], kept[b]) >= 0.7}
    assert len(want) > 20 and len(got - want) == 0 and len(want - got) <= 0.02 * len(want)


def test_near_duplicate_groups(spark):
    a, b = sentences(2)
    rows = [(1, a), (2, a.upper() + "!"), (3, edited(a)), (4, b), (5, None), (6, ""), (7, "?")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "seq long, english string, class_id string")
    got = {r.seq: (r.class_id, r.links) for r in near_duplicates.near_duplicate_groups(df, "english", "seq", 0.7).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0), 5: (5, 0), 6: (5, 0), 7: (5, 0)}
    assert near_duplicates.near_duplicate_groups(df.limit(0), "english", "seq").count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (None, 3)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got[200] == 0 and got[501] == 500 and len(got) == 203


def test_cross_split(spark):
    base = sentences(30)
    rows = [(i, "Train ", t, None) for i, t in enumerate(base)]
    rows += [(100 + i, " dev", edited(t), "zz") for i, t in enumerate(base[:10])] + [(200, "test", base[3].upper(), ""), (201, None, base[4], ""), (202, "other", base[5], ""), (203, "test", None, base[6])]
    rows += [(300, "train", "abcdefghij klmno", base[20]), (301, "test", "abcdefghij klmn", edited(base[20]))]
    df = spark.createDataFrame(rows, "seq long, split string, english string, hinglish string").withColumn("side", F.lit("x"))
    got = {(r.train, r.evaluated) for r in cross_split.overlaps(df, "seq", "split", ["english", "hinglish"]).collect()}
    f = lambda t: " ".join((t or "").lower().split())
    tr = [r for r in rows if (r[1] or "").strip().lower() == "train"]
    ev = [r for r in rows if (r[1] or "").strip().lower() in ("dev", "test")]
    want = {(x[0], y[0]) for x in tr for y in ev if any(shingles.likeness(f(x[c]), f(y[c])) >= 0.7 for c in (2, 3))}
    assert got == want and len(want) >= 12
    assert cross_split.overlaps(df.limit(0), "seq", "split", ["english", "hinglish"]).count() == 0


def test_cross_split_boilerplate(spark):
    head = sentences(1, 30)[0]
    rows = [(i, "train" if i % 2 else "test", head + " " + sentences(1, 6)[0]) for i in range(160)]
    df = spark.createDataFrame(rows, "seq long, split string, english string")
    got = {(r.train, r.evaluated) for r in cross_split.overlaps(df, "seq", "split", ["english"]).collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[1] == "train" and y[1] == "test" and shingles.likeness(x[2], y[2]) >= 0.7}
    assert got <= want and len(got) >= 0.99 * len(want) > 0


def test_cross_split_partly_boilerplate(spark):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    head, rows = letters(60), []
    for f in range(10):  # long words in another order: like in 4-grams, sharing little but the hot head, a quarter of the text
        words = [letters(19) for _ in range(10)]
        for side in (1, 2):
            rows.append((len(rows), " ".join([head, *rng.sample(words, 10)]), side))
    df = spark.createDataFrame(rows, "id long, text string, side int")
    got = {(r.a, r.b) for r in cross_split.text_pairs(df, cap=2).collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[2] != y[2] and shingles.likeness(x[1], y[1]) >= 0.7}
    assert got == want and len(want) == 10


def test_coverage():
    a = sentences(1)[0]
    assert cross_split.coverage(a, a) == 1.0 and cross_split.coverage("", a) == 0.0 and cross_split.coverage(a, "zz") == 0.0
    assert 0.3 < cross_split.coverage(a[:60] + "#" * 60, a) < 0.6


def test_coverage_of_repeated_passages():
    a, b, c = (t[:60] for t in sentences(3))
    assert cross_split.coverage(a + b + c, b + "#" + a + "#" + b + "#" + c) == 1.0
    assert cross_split.coverage("ab" * 40, "ab" * 40) == 1.0


def test_report_measures_the_field_that_matched(spark):
    a, b, c = sentences(3)
    rows = [(1, "train", a, c, "r"), (2, "test", b, c, "r"), (3, "dev", sentences(1)[0], "zz", "r"), (4, "test", a, "yy", None)]
    df = spark.createDataFrame(rows, "seq long, split string, english string, hinglish string, run_id string")
    runs = spark.createDataFrame([("r", "chat")], "run_id string, source string")
    got = {r.evaluated: (r.split, r.source, r.found, r.exact, r.coverage) for r in cross_split.record_coverage(df, "seq", "split", ["english", "hinglish"], runs).collect()}
    assert got == {2: ("test", "chat", True, True, 1.0), 3: ("dev", "chat", False, False, None), 4: ("test", None, True, True, 1.0)}
    rep = {(r.split, r.source): (r.records, r.found, r.exact, r.coverage) for r in cross_split.report(df, "seq", "split", ["english", "hinglish"], runs).collect()}
    assert rep == {("test", "chat"): (1, 1, 1, 1.0), ("dev", "chat"): (1, 0, 0, None), ("test", None): (1, 1, 1, 1.0)}


@pytest.mark.parametrize("block", [30, 10_000])
def test_ngrams_against_counting(spark, block):
    texts = ["a b a b c", "a a a", "", None, "b c b c b c", "É é-É"] + sentences(20, 12)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("0", texts[0]), (None, "a b"), (None, "a b")], "record_id string, hinglish string").withColumn("term", F.lit("clash"))
    got = {(r.n, r.term): (r.occurrences, r.records) for r in term_counts.ngram_counts(df, "hinglish", "record_id", 3, block).collect()}
    occ, rec = Counter(), Counter()
    for t in texts + ["a b", "a b"]:
        w = " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()).split()
        grams = [(n, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        occ.update(grams)
        rec.update(set(grams))
    assert got == {k: (occ[k], rec[k]) for k in occ}
    marks = {r.term: r.mark for r in term_counts.marked_terms(df, "hinglish", "record_id").collect()}
    assert marks["c"] == "rare" and marks[VOCAB[0]] is None if VOCAB[0] in marks and rec[(1, VOCAB[0])] > 2 else marks["c"] == "rare"
    assert term_counts.ngram_counts(df.limit(0), "hinglish", "record_id").count() == 0


def test_bundles_and_splits(spark):
    rows = [(1, "G1", "x"), (2, " g1 ", "y"), (3, None, "Y!"), (4, None, "z"), (5, None, None), (6, None, ""), (7, "g2", "w"), (8, "g2", "w")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "seq long, group_id string, english string, lead int")
    got = {r.id: r.lead for r in grouped_splits.bundles(df, "seq", grouped_splits.clean_key("group_id"), "english").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7}
    many = [(i, RNG.choice([i, i // 5 * 5]), RNG.choice(["a", "a", "b", None])) for i in range(3000)] + [(10_000 + i, 10_000, "a") for i in range(1000)]
    big = spark.createDataFrame(many, "id long, lead long, label string")
    out = grouped_splits.assign_splits(big, {"train": 0.8, "dev": 0.1, "test": 0.1}).toPandas()
    assert len(out) == 4000 and out.groupby("lead").split.nunique().max() == 1
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.002 and abs(share["dev"] - 0.1) < 0.002
    assert grouped_splits.assign_splits(big.limit(0), {"train": 0.8, "dev": 0.2}).count() == 0
    # one outsized bundle of one label, and labels of very uneven size: the same shares of each label
    rows = [(i, 0, "a") for i in range(2000)] + [(i, i // 3, RNG.choice(["a", "a", "a", "b", "b", "c"])) for i in range(2001, 10_000)]
    rows = spark.createDataFrame(rows, "id long, lead long, label string")
    d = grouped_splits.assign_splits(rows, {"train": 0.8, "dev": 0.1, "test": 0.1}).join(rows.select("id", "label"), "id")
    rep = grouped_splits.split_report(d, {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()
    assert len(rep) == 12 and max(abs(r.deviation) for r in rep) < 0.02
    assert max(abs(r.deviation) for r in rep if r.label is None) < 0.001


def test_format_copies(spark):
    rows = [(3, "Hello, World", "Namaste"), (1, "namaste!", "HELLO world"), (2, "x", None), (5, None, "X"), (6, "", "x "), (7, "y", "y"), (9, None, None), (8, "--", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "seq long, english string, hinglish string, root string")
    got = {(r["keep"], r["copy"]) for r in format_duplicates.copies(df, ["english", "hinglish"], "seq").collect()}
    assert got == {(1, 3), (2, 5), (2, 6), (8, 9)}
    assert {(r["keep"], r.copies) for r in format_duplicates.collapse(df, ["english", "hinglish"], "seq").collect()} == {(1, 2), (2, 3), (7, 1), (8, 2)}
    nested = spark.createDataFrame([(1, [("A", ["x", "Y"])]), (2, [("a!", ["y", " X"])]), (3, [("a", ["x", "z"])]), (4, [("a", ["X.", "y"])])], "id long, rec array<struct<k:string,v:array<string>>>")
    assert [(r["keep"], r["copy"]) for r in format_duplicates.copies(nested, ["rec"], "id").collect()] == [(1, 4)]  # arrays are ordered
    assert {(r["keep"], r["copy"]) for r in format_duplicates.copies(nested, ["rec"], "id", unordered=True).collect()} == {(1, 2), (1, 4)}
    maps = spark.createDataFrame([(1, {"a": "x", "b": "Y"}), (2, {"b": "y!", "a": "X"}), (3, {"a": "y", "b": "x"})], "id long, rec map<string,string>")
    assert [(r["keep"], r["copy"]) for r in format_duplicates.copies(maps, ["rec"], "id").collect()] == [(1, 2)]
    assert format_duplicates.copies(df.limit(0), ["english", "hinglish"], "seq").count() == 0


def test_packing(spark):
    rng = np.random.default_rng(1)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(0, 900, 800))] + [(9001, 5000), (9002, 512), (9003, 1024), (9004, 0)]
    df = spark.createDataFrame(sizes, "id long, n long")
    specs = spark.createDataFrame([(1, 512), (2, 2048), (3, 0)], "spec_id int, capacity_tokens int")
    out = packing.pack(df, specs, block_items=200).toPandas()
    for spec, cap in ((1, 512), (2, 2048)):
        o = out[out.spec_id == spec]
        assert o.groupby("container").n_tokens.sum().max() <= cap
        assert o.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in sizes if n}
        whole = [i for i, n in sizes if 0 < n <= cap]
        assert (o[o.doc_id.isin(whole)].groupby("doc_id").size() == 1).all()
        assert o.container.nunique() <= 1.01 * (o.n_tokens.sum() // cap) + 2
    assert packing.complete_bins([6, 5, 5, 4, 4, 3, 3], 10) and len(packing.complete_bins([6, 5, 5, 4, 4, 3, 3], 10)) == 3
    assert packing.pack(df.limit(0), specs).count() == 0


def test_bin_completion_against_brute_force():
    def fewest(items, cap):
        best = [(99, 0)] * (1 << len(items))  # by set of items: containers, fill of the last
        best[0] = (1, 0)
        for m, (b, fill) in ((m, best[m]) for m in range(1 << len(items))):
            for i, x in enumerate(items):
                if not m >> i & 1:
                    best[m | 1 << i] = min(best[m | 1 << i], (b, fill + x) if fill + x <= cap else (b + 1, x))
        return best[-1][0]

    rng = random.Random(2)
    for _ in range(300):
        items = [rng.randint(5, 70) for _ in range(rng.randint(1, 10))]
        got = packing.complete_bins(items, 100)
        assert sorted(x for b in got for x in b) == sorted(items) and max(map(sum, got)) <= 100
        want = fewest(items, 100)
        assert packing.lower_bound(items, 100) <= want == len(got)
    assert len(packing.complete_bins([55, 49, 46, 32, 30, 25, 23, 22, 15], 100)) == 3
    assert len(packing.complete_bins([3] * 4000, 4000)) == 4 and packing.complete_bins([], 10) == []
    assert len(packing.complete_bins([1] * 5000, 5000)) == 1 and len(packing.complete_bins([7] * 9, 7)) == 9


def test_mixing(spark):
    for _ in range(50):
        counts = {RNG.randint(1, 40): RNG.randint(1, 5) for _ in range(6)}
        budget = RNG.randint(0, sum(n * c for n, c in counts.items()))
        take = mixing.fit_budget(counts, budget)
        assert all(0 <= take[n] <= counts[n] for n in take)
        reach = {0}
        for n, c in counts.items():
            reach = {r + k * n for r in reach for k in range(c + 1)}
        assert sum(n * c for n, c in take.items()) >= max(r for r in reach if r <= budget) - max(counts)
    rows = [(i, RNG.randint(1, 300), RNG.choice(["A", "a ", "b"])) for i in range(2000)] + [(5000, 9, None), (5001, 9, "zz"), (5002, 0, "a")]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3), ("c", 0.0, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(spark.createDataFrame(rows, "id long, n long, source string"), targets)
    got = {r.source: r for r in mixing.shares(out, targets).collect()}
    assert abs(got["a"].actual_share - 0.5) < 1e-4 and got["a"].most_repeats <= 2 and got["b"].most_repeats <= 3 and got["c"].tokens == 0
    assert out.groupBy("doc_id").count().where("count > 1").count() == 0
    few = mixing.mix(spark.createDataFrame(rows, "id long, n long, source string"), targets, fitted=20)
    got = {r.source: r for r in mixing.shares(few, targets).collect()}
    assert abs(got["a"].actual_share - 0.5) < 1e-3 and got["a"].most_repeats <= 2 and got["b"].most_repeats <= 3
    part = mixing.mix(spark.createDataFrame(rows, "id long, n long, source string"), targets, total=20_000)
    assert abs(part.selectExpr("sum(n_tokens * uses)").first()[0] - 20_000) <= 2
    assert mixing.mix(spark.createDataFrame([], "id long, n long, source string"), targets).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, None), (3, "", "x")], "doc_id long, text string, source string")
    assert {r.id: (r.n, r.source) for r in tokens.token_sizes(df, "doc_id", "text", ["source"]).collect()} == {1: (2, "s"), 2: (0, None), 3: (0, "x")}


def test_boosting():
    X = np.random.default_rng(2).random((600, 3))
    y = ((X[:, 0] > 0.5) ^ (X[:, 1] > 0.5)).astype(float)
    m = boosting.Boosted().fit(X[:400], y[:400])
    assert ((m.predict(X[400:]) >= m.threshold) == y[400:]).mean() > 0.9
    assert boosting.Boosted().fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).max() < 0.5


def test_pair_rules():
    m = pair_defects.fit([])
    e = "Row 12 of the sheet misses its steel router and the road to Lokmora Gali is blocked."
    ok = "Sheet ki row 12 mein steel router gayab hai aur Lokmora Gali ka raasta band pada hai."
    for a in (None, "", " ​", "N/A", "[no translation]", "...", "null"):
        assert m.label(e, a) == "empty"
    assert m.label(e, "Sorry, I am unable to translate that sentence.") == "refusal"
    assert m.label(e, "main is vaakya ka anuvaad nahi kar sakta") == "refusal"
    assert m.label(e, "Answer: " + e.upper()) == "copy" and m.label(e, e + " " + e) == "copy"
    assert m.label(e, "सड़क पर दीवार नहीं मिली थी और बच्चे गाँव गए") == "other_language"
    assert m.label(e, ok) is None and m.label(ok, e) is None and m.label(None, ok) is None
    assert m.label(e, "Maaf karna, Lokmora Gali mein row 12 ka router repair nahi hoga aur raasta band hai") is None
    assert m.label(e, ok * 2000) is None


def test_defects_find_cut_answers(spark):
    import duckdb

    rows = duckdb.connect().execute("select seq, english, hinglish from '/root/testdata/sf0.001/raw_records.parquet' order by seq").fetchall()
    m = pair_defects.fit([(r[1], r[2]) for r in rows])
    sound = [(e, h) for _, e, h in rows if m.label(e, h) is None and pair_defects.words(h or "")[10:]]
    cut = [m.label(e, h[: int(len(h) * 0.5)].rsplit(" ", 1)[0]) for e, h in sound]
    assert sum(c == "truncated" for c in cut) >= 0.9 * len(cut)
    df = spark.createDataFrame([(1, None, None), (1, None, None)], "seq long, english string, hinglish string").withColumn("defect", F.lit("x"))
    assert [r.defect for r in pair_defects.defects(df, "english", "hinglish", "seq").collect()] == ["empty", "empty"]
    assert pair_defects.defects(df.limit(0), "english", "hinglish", "seq").count() == 0


def test_case_is_that_of_the_whole_text():
    names = lambda t: {s.x[6] for s in pii.Model().spans(t) if s.kind == "name"}
    low = "all of this stands in lower case " * 15
    assert names(low) == {1.0} and names(low + "and Rutik Golamovar writes Thus") == {0.0}


def test_pii(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    own = "Mera naam Rutik Golamovar hai. mail r.golamo@tinforge.example pe. tracking number 5123 5719 6457, kal tak aayega. passport: Q7464833\nGhar: Flat 12B, Talura Lane, Tirvel, PIN 081544. Call me on +91-5155972331 after six."
    rows = spark.createDataFrame([(10**6, own), (10**6 + 1, None), (10**6 + 2, " "), (10**6 + 3, "kuch nahi " * 20_000)], "doc_id long, text string")
    full = df.unionAll(rows).withColumn("pii_type", F.lit("clash"))
    m = pii.find_mentions(full, "doc_id", "text").where(F.col("id") >= 10**6).orderBy("start_char").collect()
    at = [(k, own.index(v)) for k, v in (("name", "Rutik"), ("email", "r.golamo"), ("id_number", "Q7464833"), ("address", "Flat 12B"), ("phone", "91-5155"))]
    assert [(r.pii_type, r.start_char) for r in m] == at
    marks = spark.createDataFrame([(t, f"[{t.upper()}]") for t in pii.TYPES], "pii_type string, placeholder string")
    red = {r.id: r for r in pii.redact(full, "doc_id", "text", marks).where(F.col("id") >= 10**6).collect()}
    assert "[EMAIL]" in red[10**6].text and "Golamovar" not in red[10**6].text and "5123 5719 6457" in red[10**6].text
    assert red[10**6 + 1].text is None and red[10**6 + 2].text == " " and red[10**6 + 3].mentions == 0
    assert pii.find_mentions(full.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("even", [False, True])
def test_cross_split_recall_by_length(spark, even):
    """Spread one-character edits and changed words at likeness 0.70 to 0.78, texts of 61 to 400 characters."""
    rng = random.Random(5)
    rows, n = [], 0
    while n < 400:
        t = "".join(rng.choice("etaoinshrdlu  ") for _ in range(rng.choice([65, 75, 90, 105, 120, 150, 170, 200, 300, 400]))).split()
        t = " ".join(t)
        u = list(t)
        if n % 3:
            k = max(1, int(len(t) * rng.uniform(0.02, 0.07)))
            for p in [int((i + 0.5) * len(t) / k) for i in range(k)] if even else rng.sample(range(len(t)), k):
                u[p] = rng.choice(["q", "z", "", u[p] + "x"])
        else:
            p = rng.randrange(len(t) * 3 // 4)
            u[p : p + rng.randint(3, len(t) // 5)] = "qzx"
        u = "".join(u)
        if 0.70 <= shingles.likeness(t, u) <= 0.78:
            rows += [(2 * n, t, 1), (2 * n + 1, u, 2)]
            n += 1
    df = spark.createDataFrame(rows, "id long, text string, side int")
    got = {(r.a, r.b) for r in cross_split.text_pairs(df).collect()}
    assert len(got & {(2 * i, 2 * i + 1) for i in range(n)}) >= 0.99 * n


def test_cross_split_hot_fingerprint_of_few_pairs(spark):
    """Many train texts and one evaluation text with the same passage are joined in the first pass."""
    head = sentences(1, 30)[0]
    rows = [(i, head + " " + sentences(1, 3)[0], 2 if i == 7 else 1) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, side int")
    got = {(r.a, r.b) for r in cross_split.text_pairs(df, few=0).collect()}
    assert got == {(min(i, 7), max(i, 7)) for i in range(80) if i != 7 and shingles.likeness(rows[i][1], rows[7][1]) >= 0.7}


def test_copies_of_every_length():
    rng = random.Random(3)
    for n in range(3, 25):
        for _ in range(40):
            p = "".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(n))
            assert pair_defects.is_copy(p, p) and pair_defects.is_copy(p, p * 2)
            assert n < 8 or pair_defects.is_copy(p, "translation" + p)
            assert not pair_defects.is_copy(p, "".join(rng.choice("xyzqvk") for _ in range(n)))
    m = pair_defects.fit([])
    assert m.label("I am at home.", "i am at home") == "copy" and m.label("", "x y z") != "copy"


def test_refusals_of_other_wording():
    for t in ("As an AI language model, I can't do that", "I'd rather not translate this", "this goes against my guidelines", "Yeh anuvad mujhse nahi hoga", "I cannot translate this sentence."):
        assert pair_defects.is_refusal(t), t
    for t in ("He said he can't help her with the question of the day", "main aaj market nahi ja sakta", "sorry, Raju cannot repair the drum", "mera number yeh hai", "woh team ke rules ke khilaaf khela"):
        assert not pair_defects.is_refusal(t), t


def test_case_that_changes_late():
    m = pii.fit(["My name is Ramesh Gupta."])
    text = "lower case only here. " * 40 + "Then Kavita Sharma came"
    assert all(s.x[6] == 0.0 for s in m.spans(text) if s.kind == "name")
    assert [s.kind for s in m.spans("45, MG Road, Pune 411001")][:1] == ["address"]


def test_pii_is_fitted_on_all_texts(spark):
    spark_rows = spark.range(4600).select("id", (F.abs(F.xxhash64("id", F.lit(9)) / F.lit(2.0**63)) > 0.9).alias("far"))
    rows, far = [], 0
    for r in spark_rows.orderBy("id").collect():
        far += r.far  # a city told by its pin in the texts a sample of 4,000 would leave out
        pin = ", Zorgarh 411001" if r.far and far < 4 else ""
        rows.append((r.id, f"House No. {r.id % 90 + 1}, Lake Road{pin} and call me on 98{r.id % 97:02d}0{r.id:05d} or note order {r.id:08d}. My name is Ravi Kumar."))
    rows += [(4600, "Please come to House No. 7, Lake Road, Zorgarh"), (4601, None), (4602, " ")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    got = sorted(map(tuple, pii.find_mentions(df, "id", "t").where("id >= 4500").collect()))
    m = pii.fit([t for _, t in rows])
    late = rows[4500:]
    assert got == sorted((i, s.kind, pii._first(t, s), s.end) for (i, t), f in zip(late, m.mentions([t for _, t in late])) for s in f)
    assert max(e for i, k, _, e in got if i == 4600 and k == "address") == len(rows[4600][1])


def test_boosting_of_repeated_rows():
    rng = np.random.default_rng(4)
    x, n = rng.random(50), rng.integers(0, 6, 50)
    q = np.linspace(0, 1, 25)[1:-1]
    assert np.allclose(boosting._quantiles(x, n, q), np.quantile(np.repeat(x, n), q))


def test_defects_are_fitted_on_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/raw_records.parquet").select("seq", "english", "hinglish")
    df = df.unionAll(df.select(F.col("seq") + 10**6, "english", "hinglish").where("seq % 3 = 0"))  # more rows than a sample of 6,000
    rows = df.orderBy("seq").collect()
    m = pair_defects.fit([(r.english, r.hinglish) for r in rows])
    got = sorted(map(tuple, pair_defects.defects(df.repartition(5), "english", "hinglish", "seq").collect()))
    some = [r for r in rows if r.seq % 8 == 0]
    assert [g for g in got if g[0] % 8 == 0] == sorted((r.seq, v) for r in some if (v := m.label(r.english, r.hinglish)))
    assert m.copied_rare == pytest.approx(sum(_both(rows, 4, True)) / sum(_both(rows, 4, False)))


def _both(rows, most, out):
    n_in, n_out = Counter(), Counter()
    into = {g: Counter() for g in pair_defects._GROUPS}
    for r in rows:
        if pair_defects._tally(r.english, r.hinglish, pair_defects._early(r.hinglish), into):
            p, a = set(pair_defects.words(r.english)), set(pair_defects.words(r.hinglish))
            for x, y in ((p, a), (a, p)):
                n_in.update(x)
                n_out.update(x & y)
    return [(n_out if out else n_in)[w] for w in n_in if n_in[w] <= most]


def _odd_pairs(n):
    rng = random.Random(8)
    stems = "main nahi kar sakta translate help the of is ghar re-work o'clock x_y n/a null ² café नहीं है। K ’ - _ . … ?".split() + VOCAB[:40]
    texts = [None, "", " "] + [rng.choice(" _-’\n").join(rng.choices(stems, k=rng.randint(1, 25))) for _ in range(n)]
    return [(rng.choice(texts), rng.choice(texts)) for _ in range(n)] + [(t, t) for t in texts[:20]]


def test_texts_cut_together_are_cut_as_one_by_one():
    texts = [x or "" for r in _odd_pairs(500) for x in r]
    t = pair_defects._Texts(texts)
    for i, x in enumerate(texts):
        at = slice(t.last[i] - t.lens[i], t.last[i])
        assert [t.own[k] for k in t.code[at]] == pair_defects.words(x) and t.bare(i) == pair_defects.bare(x)
        pattern = pair_defects._ASCII_WORDS if x.lower().isascii() else pair_defects._WORDS
        closes = [any(c in ".!?।;" for c in gap) for gap in pattern.split(x.lower())[1:]]
        assert t.closes[at].tolist() == [*closes[:-1], True][: t.lens[i]]
    assert pair_defects._earlies(t, np.arange(len(texts))) == [pair_defects._early(x) for x in texts]
    assert not len(pair_defects._Texts([]).code) and not len(pair_defects._Texts(["", " "]).own)


def test_pair_words_are_counted_as_pair_by_pair(monkeypatch):
    import pyarrow as pa

    P, plain, sound = pair_defects, {g: Counter() for g in pair_defects._GROUPS}, []
    pairs = _odd_pairs(400) + [(f"the red drum of {k} is on the road", f"laal drum {k} ki sadak par hai") for k in range(60)]
    for p, a in pairs:
        pw, w = P.words(p or ""), P.words(a or "")
        ok = False
        if p and w and not P._early(a) and P.latin_share(a) >= 0.5:
            have, asked = set(w), set(pw)
            hi, en = (sum(x in d for x in w) / len(w) for d in (P.HINGLISH, P.ENGLISH))
            if hi >= 0.15 and hi > en:
                plain["hi"].update(have - asked)
                ok = P.bare(p) != P.bare(a)
            elif en < 0.15 and hi < 0.1 and len(w) >= 6:
                plain["other"].update(have - asked)
            if sum(x in P.ENGLISH for x in pw) > 0.15 * len(pw):
                plain["en"].update(asked - have)
            for _ in range(ok):
                plain["n_in"].update([*asked, *have])
                plain["n_out"].update([*(asked & have)] * 2)
        sound.append(ok)
    assert sum(sound) >= 60 and all(plain.values())
    monkeypatch.setattr(P, "CHUNK", 7)
    monkeypatch.setattr(P, "FLUSH", 90)
    monkeypatch.setattr(P, "BYTES", 400)
    cells = [pa.array(range(len(pairs)), pa.int64()), *(pa.array([r[k] for r in pairs], pa.string()) for k in (0, 1))]
    got, met = {g: Counter() for g in P._GROUPS}, []
    for b in P._read(pa.RecordBatch.from_arrays([c.slice(at, 100) for c in cells], names=["id", "p", "a"]) for at in range(0, len(pairs), 100)):
        for r in b.to_pylist():
            if r["w"] is None:
                met.append((r["id"], r["p"], r["a"], r["early"], r["sound"]))
            for g in P._GROUPS if r["w"] is not None else ():
                got[g].update({r["w"]: r[g]} if r[g] else {})
    assert met == [(i, p, a, P._early(a), ok) for i, ((p, a), ok) in enumerate(zip(pairs, sound))]
    assert got == plain


def test_no_pair_is_cut_by_a_pattern(monkeypatch):
    """The texts of many pairs are cut into words together; once it was a pattern's run a text and step."""
    import duckdb

    rows = duckdb.connect().execute("select english, hinglish from '/root/testdata/sf0.001/raw_records.parquet' order by seq").fetchall()
    rows = [r for r in rows if all(x and x.isascii() for x in r)]
    m = pair_defects.fit(rows)
    before = [m.label(*r) for r in rows]
    monkeypatch.setattr(pair_defects, "_ASCII_WORDS", None)
    m = pair_defects.fit(rows)
    assert [m.label(*r) for r in rows] == before and len(rows) > 300
