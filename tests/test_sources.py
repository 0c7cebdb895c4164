"""Readers and sinks on hand-made files."""

import pytest
from pyspark.sql import functions as F

from sangam.functions import text as T
from sangam.sources import readers, sinks


def put(folder, name, text):
    p = folder / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_header_or_position(spark, tmp_path):
    a = readers.read_delimited(spark, put(tmp_path, "a.csv", 'English,Hinglish (list)\n"Hi, you","[\'x\', \'y\']"\n,\n'))
    assert a.columns == ["English", "Hinglish (list)"] and a.count() == 1
    b = readers.read_delimited(spark, put(tmp_path, "b.tsv", 'one "quoted\tek\n\t\ntwo\tdo\n'))
    assert b.columns == ["c0", "c1"] and {r.c0 for r in b.collect()} == {'one "quoted', "two"}
    with pytest.raises(ValueError):
        readers.read_delimited(spark, "x.pkl")
    got = readers.ingest(spark, str(tmp_path / "a.csv"), "chat").orderBy("ref").collect()
    assert [(r.english, r.hinglish, r.ref, r.source) for r in got] == [("Hi, you", "x", 0, "chat"), ("Hi, you", "y", 1, "chat")] and got[0].seq < got[1].seq
    assert readers.first_references(spark, str(tmp_path / "a.csv")).count() == 1


def test_conll(spark, tmp_path):
    text = "# a comment\nmain\tlang2\nhoon\tx\tlang2\n\n\n\nok lang1\n"
    got = readers.read_conll(spark, put(tmp_path, "c.txt", text)).orderBy("sentence", "pos").collect()
    assert [(r.token, r.tag) for r in got] == [("main", "lang2"), ("hoon", "lang2"), ("ok", "lang1")] and len({r.sentence for r in got}) == 2
    df = spark.createDataFrame([(text.split("\n"),), ([],)], "l array<string>")
    assert [[[tuple(t) for t in s] for s in r[0]] for r in df.select(readers.conll_sentences(F.col("l"))).collect()] == [[[("main", "lang2"), ("hoon", "lang2")], [("ok", "lang1")]], []]


def test_lexicons(spark, tmp_path):
    long = "\t".join(f"f{i}" for i in range(1500))
    got = readers.read_lexicon(spark, put(tmp_path, "l.tsv", f"# c\nNahi\t nahin \tnahin\tnhi\nbig\t{long}\nshort\tx\n"))
    assert got.where("label = 'nahi'").orderBy("pos").agg(F.collect_list("form")).first()[0] == ["nahi", "nahin", "nhi"] and got.where("label = 'big'").count() == 1501
    assert readers.read_strict_lexicon(spark, put(tmp_path, "s.tsv", "A\tb\tB\n")).count() == 2
    for bad in ("A\tb\tb\n", "A\tb\nC\tb\n"):
        with pytest.raises(ValueError):
            readers.read_strict_lexicon(spark, put(tmp_path, "t.tsv", bad))


def test_lines_and_pairs(spark, tmp_path):
    a, b = put(tmp_path, "a.txt", "".join(f"a{i}\n" for i in range(50))), put(tmp_path, "b.txt", "".join(f"b{i}\n" for i in range(50)))
    got = readers.read_aligned(spark, a, b).collect()
    assert len(got) == 50 and all(r.a == f"a{r.i}" and r.b == f"b{r.i}" for r in got)
    with pytest.raises(ValueError):
        readers.read_aligned(spark, a, put(tmp_path, "c.txt", "x\n"))
    p = readers.read_parallel(spark, put(tmp_path, "p.tsv", "# c\nenglish\thindi_roman\n\nhello\tnamaste\n"))
    assert [tuple(r) for r in p.collect()] == [("hello", "namaste")]
    with pytest.raises(Exception, match="not romanised"):
        readers.read_parallel(spark, put(tmp_path, "q.tsv", "hello\tनमस्ते\n")).collect()


def test_ledger_and_sinks(spark, tmp_path):
    runs = tmp_path / "runs"
    runs.mkdir()
    put(runs, "a.json", '{"name": "x", "seed": 1, "elapsed_seconds": 2.5, "status": "ok"}')
    put(runs, "b.json", '{"run": "y", "timing": {"seconds": 3.0}}')
    put(runs, "c.json", "no json")
    put(runs, "d.json", '{"seed": 4}')
    good, bad = readers.read_ledger(spark, str(runs))
    assert {(r.name, r.elapsed) for r in good.collect()} == {("x", 2.5), ("y", 3.0)} and {r.problem for r in bad.collect()} == {"not readable", "no name"}
    with pytest.raises(KeyError):
        with sinks.RunLedger(spark, str(tmp_path / "led"), "run", 7):
            raise KeyError("lost")
    assert [(r.name, r.status) for r in spark.read.json(str(tmp_path / "led")).collect()] == [("run", "failed")]
    df = spark.createDataFrame([(1, 'say "hi"\tnow', "bolo"), (2, "", "x"), (3, "y", None)], "seq long, english string, hinglish string")
    sinks.write_split_tsv(df, str(tmp_path / "s"), ["seq", "english", "hinglish"])
    assert [tuple(r) for r in readers.read_split(spark, str(tmp_path / "s")).collect()] == [('say "hi" now', "bolo")]
    sinks.write_chat(df, str(tmp_path / "chat"), "sys", "english", "hinglish")
    row = spark.read.json(str(tmp_path / "chat")).first()
    assert [m.role for m in row.messages] == ["system", "user", "assistant"]
    for _ in range(2):
        sinks.append_results(df, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 6
    sinks.write_statistics(df.agg(F.count("*").alias("n")), str(tmp_path / "st"))
    assert spark.read.json(str(tmp_path / "st")).first().n == 3


def test_small_texts(spark):
    df = spark.createDataFrame([("Assistant: Hinglish: \n haan ji \nx", "ok"), (None, "a;B, a"), ("  \n", "")], "o string, c string")
    assert [r[0] for r in df.select(T.clean_output("o")).collect()] == ["haan ji", "", ""]
    assert [r[0] for r in df.select(T.parse_codes("c", ["OK", "A", "B"])).collect()] == [["OK"], ["A", "B"], []]
    for bad in ("z", "OK;A"):
        with pytest.raises(Exception, match="bad codes"):
            spark.createDataFrame([(bad,)], "c string").select(T.parse_codes("c", ["OK", "A"])).collect()
    assert spark.createDataFrame([("a|b" + "x" * 200,)], "c string").select(sinks.markdown_cell(F.col("c"))).first()[0].startswith("a\\|b")
    with pytest.raises(Exception, match="no Hindi"):
        spark.createDataFrame([("e", " ")], "e string, h string").select(T.build_source(F.col("e"), F.col("h"), "both")).collect()
    shots = spark.range(1).select(sinks.chat_messages("s", F.lit("q"), [("a", "b")])).first()[0]
    assert [m.role for m in shots] == ["system", "user", "assistant", "user"]


def test_synthetic_corpus(spark):
    a, b = readers.synthetic(spark, 4000), readers.synthetic(spark.newSession(), 4000).repartition(3)
    assert a.exceptAll(b).count() == 0
    n = {r["kind"]: r["count"] / 4000 for r in a.groupBy("kind").count().collect()}
    assert len(n) == 9 and abs(n["base"] - 0.7) < 0.03 and abs(n["extra_ref"] - 0.17) < 0.02
    from sangam.operators import clean

    got = {r.filter_name: r.removed for r in clean.attrition(clean.route(a)).collect()}
    assert all(got[k] > 0 for k in clean.FILTERS)


def test_sql_folder(spark, tmp_path):
    from sangam.plans import runner

    put(tmp_path, "02_b.sql", "SELECT 2 AS n, CAST(NULL AS STRING) AS s;\n")
    put(tmp_path, "01_a.sql", "SELECT 1 AS n")
    put(tmp_path, "notes.txt", "no query")
    got = list(runner.run_folder(spark, str(tmp_path)))
    assert [n for n, _ in got] == ["01_a", "02_b"] and runner.shown(got[1][1]) == "n  s\n2"
