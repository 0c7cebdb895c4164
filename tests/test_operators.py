import datetime as dt
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from sangam.operators import align, buckets, clean, codemix, metrics, neardup, shingles, similar, translit
from sangam.plans import reports
from sangam.session import drop, materialise
from sangam.sources import readers, sinks
from sangam.streaming.monitor import daily_counts


def test_one_defect_per_filter(spark):
    good = ("the red lamp is here", "lal lamp yahan hai")
    rows = [good, ("", "x y"), ("a lamp is here", "लाल दीपक यहाँ है"), ("Same text, here", "same TEXT here!"), ("hello", "namaste"), ("a b", "c d e f g h i j"), good]
    df = spark.createDataFrame([(i, e, h) for i, (e, h) in enumerate(rows)], "seq long, english string, hinglish string")
    got = {r.seq: r.reason for r in clean.route(df).collect()}
    assert got == {0: None, 1: "missing_field", 2: "not_romanized", 3: "untranslated", 4: "length_bounds", 5: "length_ratio", 6: "exact_duplicate"}
    table = clean.attrition(clean.route(df)).orderBy("step").collect()
    assert [r.removed for r in table] == [1] * 6 and table[0].rows_in == 7 and table[-1].rows_out == 1
    empty = clean.attrition(clean.route(df.limit(0))).collect()
    assert len(empty) == 6 and all(r.rows_in == 0 and r.pct_removed == 0 for r in empty)


@pytest.mark.parametrize(
    "tags, cmi, spf, m",
    [(["lang1", "lang2", "other", "lang2", "lang1"], 50.0, 2 / 3, 1.0), (["lang2", "lang2", "unk"], 0.0, 0.0, 0.0), (["lang2"], 0.0, None, 0.0), ([], 0.0, None, 0.0)],
)
def test_code_mixing(spark, tags, cmi, spf, m):
    t = F.col("t")
    r = spark.createDataFrame([(tags,)], "t array<string>").select(codemix.cmi(t), codemix.spf(t), codemix.m_index(t), codemix.span_lengths(t)).first()
    assert r[0] == pytest.approx(cmi) and (r[1] is None if spf is None else r[1] == pytest.approx(spf)) and r[2] == pytest.approx(m)
    assert sum(r[3]) == sum(x.startswith("lang") for x in tags)


def test_cut_tags_are_null(spark):
    df = spark.createDataFrame([('["lang1"]',), ('["lang1", "la',), (None,)], "j string")
    assert [r[0] for r in df.select(codemix.parse_tags(F.col("j"))).collect()] == [["lang1"], None, None]


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(60)]
    texts += [t.replace(t.split()[0], "zzzz", 1) for t in texts[:20]] + ["", "ab"]
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "id long, key string")
    sets = {r.id: {r.key[i : i + 4] for i in range(max(len(r.key) - 3, 1))} for r in df.collect() if r.key}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    got = neardup.near_pairs(df).collect()
    assert {(r.a, r.b) for r in got} == want and len(want) >= 10
    labels = {r.id: r.label for r in neardup.group_labels(spark.createDataFrame([(3, 2), (2, 1), (9, 8), (9, 8)], "a long, b long")).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    with pytest.raises(ValueError):
        neardup.check_degenerate(40, 100)


def test_near_pairs_of_a_template(spark):
    rng = random.Random(3)
    word = lambda n=6: "".join(rng.choice("abcdefgh") for _ in range(n))
    base = [word() for _ in range(30)]
    texts = [" ".join(base[:i] + [word(), word(), word()] + base[i + 3 :]) for i in (rng.randrange(27) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "id long, key string")
    sets = {r.id: {r.key[i : i + 4] for i in range(len(r.key) - 3)} for r in df.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    got = {(r.a, r.b) for r in neardup.near_pairs(df).collect()}
    texts = df.withColumnRenamed("key", "text")
    hot = buckets.bucket_pairs(similar.band_keys(texts, shingles.MinHasher(0.7), 16), 16, 0.7).where(F.col("b") == buckets.HOT)
    assert hot.count() > 0 and len(want) > 300
    assert got <= want and len(got) >= 0.99 * len(want)
    assert {(r.a, r.b) for r in similar.similar_pairs(texts, cap=16).collect()} == want


def test_every_pair_of_many_variants(spark):
    """120 variants of one key are 7,140 pairs, though every band bucket is above its cap."""
    rng = random.Random(8)
    base = "the red lamp stands on the old table near the window of the house by the river and nobody minds it at all in the long winter"
    keys = list(dict.fromkeys(base + " " + "".join(rng.choice("qxzv") for _ in range(5)) for _ in range(200)))[:120]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    got = {(r.a, r.b) for r in neardup.near_pairs(df).collect()}
    assert got == {(a, b) for a in range(120) for b in range(a + 1, 120)}


def test_contamination_by_key_other_side_and_nearness(spark):
    long = "the red lamp stands on the old table near the window"
    splits = [(1, "train", "a train row of its own here", "train wala"), (2, "test", long, "lal lamp"), (3, "dev", "second protected row", " ")]
    rows = [(1, long.upper() + "!", "x"), (2, "nothing alike", "LAL lamp!"), (3, long + " now", "y"), (4, "a train row of its own here", "z"), (5, "free", ""), (6, long + " today", "train wala")]
    c = spark.createDataFrame(rows, "id long, english string, other string")
    p = spark.createDataFrame(splits, "id long, split string, english string, other string")
    got = {tuple(r) for r in neardup.contamination(c, p).collect()}
    # row 6 meets train by its other side, so it is not looked at for nearness
    assert got == {(1, "exact", "test"), (2, "other_exact", "test"), (3, "near", "test"), (4, "exact", "train"), (6, "other_exact", "train")}


def test_all_rounds_of_the_alignment(spark, tmp_path):
    pairs = [("red lamp", "lal deepak"), ("red red door", "lal darwaza"), ("lamp is red", "deepak lal lal hai"), ("door is old", "purana hai darwaza"), ("old lamp", "purana deepak"), ("", "akela"), ("x", "")]
    df = spark.createDataFrame([(i, "train", "g", e, h) for i, (e, h) in enumerate(pairs)], "seq long, split string, group_id string, english string, hinglish string")
    df.write.parquet(str(tmp_path / "prepared_records.parquet"))
    t = {}
    for _ in range(12):
        c, tot = {}, {}
        for e, h in pairs:
            for w in h.split():
                z = sum(t.get((w, v), 0.0) if t else 1.0 for v in ["", *e.split()])
                for v in ["", *e.split()]:
                    q = (t.get((w, v), 0.0) if t else 1.0) / z
                    c[w, v], tot[v] = c.get((w, v), 0.0) + q, tot.get(v, 0.0) + q
        t = {k: v / tot[k[1]] for k, v in c.items()}
    got = {(r.h, r.e): r.p for r in reports._em(spark, str(tmp_path), 12).collect()}
    assert got == pytest.approx(t)
    full = {r.seq: (r.words, r.linked, r.blocks) for r in reports.link_blocks_full(spark, str(tmp_path)).collect()}
    want = {}
    for n, (e, h) in enumerate(pairs):
        links = [max(range(len(e.split()) + 1), key=lambda i: (round(t[w, ["", *e.split()][i]], 12), -i)) for w in h.split()]
        on = [i for i in links if i]
        if links:
            want[n] = (len(links), len(on), (1 + sum(a > b for a, b in zip(on, on[1:]))) if on else 0)
    assert full == want
    rows = reports.codemix_candidates(spark, str(tmp_path)).collect()
    per = {n: sum(r.seq == n for r in rows) for n in want}
    assert per == {n: 2**b - 2 if b > 1 else 0 for n, (_, _, b) in want.items()} and sum(per.values()) > 0


def test_packed_links_equal_the_rounds_as_tables(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [f"e{int(rng.random() ** 3 * 30)}" for _ in range(rng.randrange(9))], [f"h{int(rng.random() ** 3 * 40)}" for _ in range(rng.randrange(9))]) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, e array<string>, h array<string>")
    for name, value in (("BLOCK", 50), ("BUCKET_WORDS", 40), ("CELLS", 64)):  # many blocks, buckets and passes
        monkeypatch.setattr(align, name, value)
    t = {}
    for rounds in (1, 2):
        c, tot = {}, {}
        for _, e, h in rows:
            for w in h:
                z = sum(t.get((w, v), 0.0) if t else 1.0 for v in ["", *e])
                for v in ["", *e]:
                    q = (t.get((w, v), 0.0) if t else 1.0) / z
                    c[w, v], tot[v] = c.get((w, v), 0.0) + q, tot.get(v, 0.0) + q
        t = {k: v / tot[k[1]] for k, v in c.items()}
        want = {q: [max(range(len(e) + 1), key=lambda i: (round(t[w, ["", *e][i]], 9), -i)) for w in h] for q, e, h in rows if h}
        assert {r.seq: r.links for r in align.links(df, rounds).collect()} == want
    assert align.links(df.where("size(h) = 0"), 2).collect() == []


def test_link_blocks_make_no_row_a_word_pair(spark, tmp_path):
    rows = [(0, "red lamp", "lal deepak"), (1, "red door", "lal darwaza"), (2, "lamp is red", "lal deepak lal"), (3, "", "akela"), (4, "x", None), (5, None, "lal")]
    spark.createDataFrame([(q, "train", "g", e, h) for q, e, h in rows], "seq long, split string, group_id string, english string, hinglish string").coalesce(1).write.parquet(str(tmp_path / "prepared_records.parquet"))
    df = reports.link_blocks(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW prepared_records AS SELECT * FROM '{tmp_path}/prepared_records.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(reports.SQL["link_blocks"]).fetchall())
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, reports.candidate_totals(spark, str(tmp_path)).collect())) == sorted(c.execute(reports.SQL["candidate_totals"]).fetchall())


def test_realisations():
    e, h, links = "a b c d".split(), "w x y z".split(), [3, 0, 1, 2]  # c . | a b, and d goes to c
    assert codemix.spans(4, links) == [([2, 3], [0, 1]), ([0, 1], [2, 3])]
    assert list(codemix.mixed(e, h, links)) == [(1, "c d y z", 1, 1 / 3), (2, "w x a b", 1, 1 / 3)]
    down = list(range(13, 0, -1))
    assert not list(codemix.mixed(["s"] * 13, ["t"] * 13, down)) and len(list(codemix.mixed(["s"] * 12, ["t"] * 12, down[1:]))) == 2**12 - 2


def test_realisations_are_built_by_doubling():
    rng = random.Random(8)
    for _ in range(200):
        e, h = [f"s{i}" for i in range(rng.randrange(12))], [f"t{i}" for i in range(rng.randrange(14))]
        blocks = codemix.spans(len(e), [rng.randrange(len(e) + 1) for _ in h])
        want = []
        for mask in range(1, 2 ** len(blocks) - 1) if 2 <= len(blocks) <= 12 else ():
            side = [mask >> k & 1 for k in range(len(blocks))]
            words = [w for on, (a, b) in zip(side, blocks) for w in ([e[i] for i in a] if on else [h[j] for j in b])]
            turns = sum(x != y for x, y in zip(side, side[1:]))
            if words:
                want.append((mask, " ".join(words), turns, turns / (len(words) - 1) if len(words) > 1 else 0.0))
        assert list(zip(*codemix._mixed(blocks, e, h, 12))) == want


def test_metrics(spark):
    a, b = "wo nahi aaya".split(), "wo nahin aaya".split()
    assert metrics.edit_distance(a, b) == 1 and metrics.lcs(a, b) == 2
    same = metrics.statistics("ek do teen chaar paanch", "ek do teen chaar paanch")
    assert metrics.chrf(same) == pytest.approx(100) and metrics.bleu(same) == pytest.approx(100)
    assert metrics.chrf(metrics.statistics("aaa", "zzz")) == 0.0
    df = spark.createDataFrame([("x", "wo nahin aaya", "wo nahi aaya"), ("x", None, "a b"), ("y", "", "")], "g string, hyp string, ref string")
    got = {r.g: r for r in metrics.corpus_scores(df, "g").collect()}
    assert got["x"].wer == pytest.approx(3 / 5) and got["y"].wer is None and got["x"].sentences == 2
    assert metrics.best_statistics("a b", ["", "a b", "z"])[-1] == 1
    t = spark.createDataFrame([(None,), (0.3,), (0.8,)], "s double").select(metrics.null_threshold(F.col("s")))
    assert [r[0] for r in t.collect()] == [1.0, 1.0, 1.6]


def test_romaniser(spark):
    # long vowels are written long but at a word's end
    words = {"नमक": "namak", "राम": "raam", "समझना": "samajhna", "लड़की": "ladki", "हिन्दू": "hindu", "ज़मीन": "zameen", "ज़मीन": "zameen", "दुःख": "duhkh", "संगत": "sangat", "१२": "12", "": ""}
    assert {w: translit.romanise_word(w) for w in words} == words
    votes = spark.createDataFrame([("है", "hai", 3), ("है", "he", 3), ("है", "hay", 1)], "native string, latin string, n int")
    lex = translit.vote_lexicon(votes)
    df = spark.createDataFrame([(1, "राम है, ok!"), (2, None), (3, "")], "id long, t string")
    got = {r.id: (r.romanised, r.from_lexicon, r.from_rules) for r in translit.romanise(df, "id", "t", lex).collect()}
    assert got == {1: ("raam hai, ok!", 1, 1), 3: ("", 0, 0)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('english\thinglish\n"quoted\tx\n\t\nb\tc\n')
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "a.tsv")).collect()] == [('"quoted', "x"), ("b", "c")]
    (tmp_path / "b.csv").write_text("English,Hindi,Human-generated Hinglish (list)\nhi,,\"['a', 'b']\"\nyo,,[]\n")
    df = readers.read_delimited(spark, str(tmp_path / "b.csv"))
    roles = readers.detect_columns(df.columns)
    assert roles["hinglish"].startswith("Human") and readers.detect_columns(["a", "b"]) == {"english": "a", "hinglish": "b"}
    out = readers.explode_references(df.withColumnRenamed(roles["hinglish"], "cell"), "cell").orderBy("English", "ref")
    assert [(r.English, r.reference) for r in out.collect()] == [("hi", "a"), ("hi", "b"), ("yo", "")]
    with pytest.raises(ValueError):
        readers.read_delimited(spark, "x.pkl")
    (tmp_path / "lex.tsv").write_text("# c\nnahi\tnahin\tnai\nhai\thy\tnai\nshort\n")
    lex = readers.read_lexicon(spark, str(tmp_path / "lex.tsv"))
    assert {r.form: r.label for r in readers.form_index(lex).collect()}["nai"] == "nahi"
    lines = spark.createDataFrame([(["a en", "b hi", "", "# x", "c en"],)], "l array<string>").select(readers.conll_sentences(F.col("l"))).first()[0]
    assert [[(t.token, t.tag) for t in s] for s in lines] == [[("a", "en"), ("b", "hi")], [("c", "en")]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", "train", 1), ("r1", "dev", 2), ("r2", "train", 3)], "run_id string, split string, id long")
    a, b = sinks.manifest(df, "split", "id").collect(), sinks.manifest(df.repartition(3), "split", "id").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and sum(r.records for r in a) == 3
    for _ in range(2):
        sinks.load_run(df.where("run_id = 'r1'"), str(tmp_path / "w"))
    sinks.load_run(df.where("run_id = 'r2'"), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 3


def test_stream_equals_table(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 5), "click", float(d)) for d in (1, 1, 2, 3)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = daily_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.day, r.n, r.total) for r in d.collect())
    assert key(spark.table("daily")) == key(daily_counts(df))


def test_screen_leaves_no_pair_out():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    xs = [" ".join(word() for _ in range(rng.randint(0, 900 if i % 50 == 0 else 40))) for i in range(400)]
    ys = [" ".join(w for w in x.split() if rng.random() > 0.06) if i % 2 else rng.choice(xs) for i, x in enumerate(xs)]
    kept = shingles.screen(xs, ys, 0.7)
    alike = [shingles.likeness(x, y) >= 0.7 for x, y in zip(xs, ys)]
    assert all(k for k, a in zip(kept, alike) if a) and sum(alike) > 100 and sum(kept) < 1.2 * sum(alike) + 20


def test_multi_reference_metrics(spark):
    rows = [("s", "i1", 0, "a b c d e", "a b x d e"), ("s", "i1", 1, "a b c d e", "a b c d f g"), ("s", "i1", 2, "a b c d e", ""), ("s", "i2", 0, "p q r s", "p q r s"), ("s", "i3", 0, None, "z z")]
    df = spark.createDataFrame(rows, "system string, item string, pos long, hyp string, ref string")
    got = metrics.multi_reference_scores(df, "system", "item").first()
    assert got.sentences == 3
    # item 1: the first reference by error rate (1 of 5), the better one by chrF++
    assert got.wer == pytest.approx((1 + 0 + 2) / (5 + 4 + 2))
    f = lambda h, r: 2 * metrics.lcs(h.split(), r.split()) / (len(h.split()) + len(r.split()))
    assert got.rouge_l == pytest.approx((max(f("a b c d e", "a b x d e"), f("a b c d e", "a b c d f g")) + 1 + 0) / 3)
    b = metrics.multi_reference_bleu(df.where("item <> 'i3'"), "system", "item").first()
    assert (b.hyp_words, b.ref_words, b.hit1, b.all1, b.hit2, b.hit4) == (9, 9, 9, 9, 7, 2)  # clipped by the most any reference has
    same = df.where("item = 'i2'")
    assert metrics.multi_reference_bleu(same, "system", "item").first().bleu == pytest.approx(100)
    assert metrics.multi_reference_scores(df.limit(0), "system", "item").count() == 0


def test_dropped_tables_are_gone(spark):
    from sangam import session

    t = session.materialise(spark.range(3).toDF("id"), "gone")
    path = t._sangam_path.removeprefix("file://")
    assert os.path.isdir(path) and t.count() == 3
    session.drop(t)
    session.drop(t)
    assert not os.path.exists(path)


def test_matched_selection(spark):
    rng = random.Random(4)
    rows = [(q, m, f"t{q}-{m}", rng.random()) for q in range(300) for m in range(6)]
    pool = spark.createDataFrame(rows, "seq long, mask int, text string, spf double")
    got = codemix.select_matched(pool, 0.24, 2, sentences=100)
    r = got.agg(F.count("*").alias("n"), F.countDistinct("seq").alias("s"), F.avg("spf").alias("m")).first()
    assert (r.n, r.s) == (600, 300) and abs(r.m - 0.24) < 0.02
    assert codemix.select_matched(pool.limit(0), 0.24, 1).count() == 0


def test_shuffle_files_go_with_the_write(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    own = lambda: {str(f) for f in env.blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    before = own()
    t = materialise(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "kept")
    for _ in range(50):
        if own() <= before:
            break
        time.sleep(0.1)
    assert own() <= before
    assert sorted(r.n for r in t.collect()) == [714] * 5 + [715] * 2
    drop(t)
