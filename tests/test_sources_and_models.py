import random

from pyspark.sql import functions as F

from umbra.operators import ner
from umbra.sources import formats, layout, text


def test_lines_and_back(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice(["a", "b", "\n", "\r\n", "\r", " "]) for _ in range(20))) for k in range(50)] + [(99, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    upper = text.lines(docs, ["id"]).withColumn("text", F.upper("text"))
    got = dict(text.rejoined(docs, upper, ["id"]).select("id", "written").collect())
    assert got == {k: t.upper() for k, t in rows}


def test_markdown(spark):
    md = "# T\n```\na@b.org\n~~~\n````  \nx [l](u(v)w) y ![i](\\)z) end\n  ~~~~\nno\n"
    got = [(r.line, r.start, r.text) for r in text.markdown_segments(spark.createDataFrame([(1, md)], "id int, text string"), ["id"]).orderBy("line", "start").collect()]
    assert got == [(0, 0, "# T"), (5, 0, "x [l]"), (5, 12, " y ![i]"), (5, 24, " end")]
    state = spark.createDataFrame([(md,)], "t string").select(text.fenced(text.lines_of(F.col("t"))).alias("f")).first().f
    assert state[-1] is True and state[0] is False


def test_formats(spark):
    rows = spark.createDataFrame([("a.b/c.DOCX",), ("x",), ("y.odt",), ("z.pdf",), ("q.zip",)], "n string")
    got = rows.select(formats.extension(F.col("n")).alias("e"), formats.adapter(F.col("n")).alias("a"), formats.refusal(F.col("n"), True).alias("r")).collect()
    assert [g.e for g in got] == ["docx", "", "odt", "pdf", "zip"]
    assert [g.a for g in got] == ["docx", None, None, "pdf", None]
    assert [g.r and g.r.reason for g in got] == [None, "notAccepted", "openDocument", "pdfRestore", "notAccepted"]


def test_letters(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (16383,)], "i long").select(formats.column_letters(F.col("i"))).collect()]
    assert got == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_windows_tile(spark):
    rows = [(n, "  " + " ".join(f"m{k}" for k in range(n)) + "\n") for n in (0, 1, 119, 120, 121, 210, 211, 500)]
    got = spark.createDataFrame(rows, "n int, t string").select("n", "t", ner.windows(F.col("t")).alias("w")).collect()
    for r in got:
        assert r.w[0].core_start == 0 and r.w[-1].core_end == len(r.t)
        assert all(a.core_end == b.core_start for a, b in zip(r.w, r.w[1:]))
        assert all(len(r.t[w.start : w.end].split()) <= 120 for w in r.w)
    assert len(got[-1].w) == 6


def test_labels(spark):
    rows = [(1, 1, "Jean", 0, 4, "B-PER", 0.9), (1, 2, "Du", 5, 7, "I-PER", 0.4), (1, 3, "##pont", 7, 11, "I-PER", 0.8), (1, 4, "a", 12, 13, "O", 0.9), (1, 5, "Paris", 14, 19, "I-LOC", 0.7), (1, 6, "[SEP]", None, None, "O", 1.0)]
    words = ner.word_labels(spark.createDataFrame(rows, "id int, k int, piece string, start int, end int, label string, score double"), ["id"])
    got = sorted((r.start, r.end, r.type, round(r.score, 3)) for r in ner.entities(words, ["id"]).collect())
    assert got == [(0, 11, "PERSON", 0.85), (14, 19, "LOCATION", 0.7)]


def test_alignment(spark):
    rows = spark.createDataFrame([("Jean-Luc  §x", ["[CLS]", "Jean", "-", "Luc", "[UNK]", "x", "nope"])], "t string, p array<string>")
    got = [s and (s.start, s.end) for s in rows.select(ner.aligned(F.col("t"), F.col("p")).alias("a")).first().a]
    assert got == [None, (0, 4), (4, 5), (5, 8), (10, 11), (11, 12), None]


def test_runs(spark):
    runs = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (1, 2, "ef")], "id int, run int, text string")
    edits = spark.createDataFrame([(1, 1, 5, "X"), (1, 5, 6, "Y")], "id int, start int, end int, replacement string")
    assert [r.merged for r in layout.merged_runs(runs, edits, ["id"]).orderBy("run").collect()] == ["aX", "", "Y"]
    assert [r.merged for r in layout.merged_runs(runs, edits.limit(0), ["id"]).orderBy("run").collect()] == ["ab", "cd", "ef"]
