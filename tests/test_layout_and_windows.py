import random
import re

import pytest
from pyspark.sql import functions as F

from umbra.functions.native import NATIVE
from umbra.operators import cells, detect, ner, report
from umbra.sources import layout

# ---------------------------------------------------------------- lines and paragraphs


def replay(items):
    """Lines gather what is near their first fragment, in the order in which fragments come."""
    lines = []
    for s, x, y, w, h in items:
        if not s.strip():
            continue
        line = next((z for z in lines if abs(z["y"] - y) <= max(z["h"], h) * 0.5), None)
        if line is None:
            lines.append({"y": y, "h": h, "items": [(s, x, w, h)]})
        else:
            line["items"].append((s, x, w, h))
            line["h"] = max(line["h"], h)
    paragraphs, before = [], None
    for line in sorted(lines, key=lambda z: -z["y"]):
        text, end = "", None
        for s, x, w, h in sorted(line["items"], key=lambda i: i[1]):
            if end is not None and x - end > h * 0.2 and not text.endswith(" ") and not s.startswith(" "):
                text += " "
            text, end = text + s, x + w
        text = " ".join(text.split())
        if before is not None and before["y"] - line["y"] > before["h"] * 1.5:
            paragraphs.append([])
        (paragraphs or paragraphs.append([]) or paragraphs)[-1].append(text)
        before = line
    return [" ".join(p) for p in paragraphs]


def test_paragraphs_match_replay(spark):
    rng = random.Random(11)
    pages = []
    for page in range(150):
        y, items = 100.0, []
        for _ in range(rng.randrange(14)):
            y -= rng.choice([0, 0, 1.5, 4, 4, 5, 8, 14, 30]) if rng.random() < 0.8 else -6.0
            items.append((rng.choice(["ab", "c ", " d", " ", "e f", "g"]), float(rng.randrange(60)), y, float(rng.randrange(1, 20)), rng.choice([8.0, 10.0, 12.0])))
        pages.append((page, items))
    rows = [(p, k, *i) for p, items in pages for k, i in enumerate(items)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "page int, k int, str string, x double, y double, w double, h double")
    got = {}
    for r in layout.paragraphs(frame, ["page"]).orderBy("page", "paragraph").collect():
        got.setdefault(r.page, []).append(r.text)
    for page, items in pages:
        assert got.get(page, []) == [t for t in replay(items) if t]


def test_pages_of_one_row_need_no_shuffle(spark):
    rng = random.Random(12)
    items = {p: [(rng.choice(["ab", "c ", " d", " ", "e f"]), float(rng.randrange(60)), float(rng.randrange(40)), float(rng.randrange(1, 20)), rng.choice([8.0, 12.0])) for _ in range(rng.randrange(12))] for p in range(100)}
    pages = spark.createDataFrame([(p, [(k, *i) for k, i in enumerate(x)][::-1]) for p, x in items.items()], "page int, items array<struct<k:int,str:string,x:double,y:double,w:double,h:double>>")
    found = layout.page_paragraphs(pages, ["page"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(found.collect()):
        got.setdefault(r.page, []).append(r.text)
    assert got == {p: want for p, x in items.items() if (want := [t for t in replay(x) if t])}


def test_runs_are_checked(spark):
    runs = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (2, 0, "x")], "id int, run int, text string")
    edits = spark.createDataFrame([(1, 1, 3, "ZZ")], "id int, start int, end int, replacement string")
    merged = layout.merged_runs(runs, edits, ["id"])
    assert layout.differing_runs(merged, edits, ["id"]).count() == 0
    wrong = merged.withColumn("merged", F.when(F.col("id") == 2, "y").otherwise(F.col("merged")))
    assert [tuple(r) for r in layout.differing_runs(wrong, edits, ["id"]).collect()] == [(2, "x", "y")]


# ---------------------------------------------------------------- windows


def cut(text, counts, size, overlap, budget):
    """The recursion that one pass stands for: (start, end, core_start, core_end) in the text."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if len(spans) <= size:
        windows = [(0, len(text), 0, len(text), 0, len(spans))]
    else:
        windows, i, step, half = [], 0, size - overlap, overlap // 2
        while True:
            last = i + size >= len(spans)
            windows.append((spans[i][0], spans[min(i + size, len(spans)) - 1][1], 0 if i == 0 else spans[i + half][0], len(text) if last else spans[i + step + half][0], i, min(i + size, len(spans))))
            if last:
                break
            i += step
    for start, end, core, until, p, q in windows:
        if sum(counts[p:q]) > budget and size > 8:
            for a, b, c, d in cut(text[start:end], counts[p:q], size // 2, overlap // 2, budget):
                c, d = max(core, start + c), min(until, start + d)
                if c < d:
                    yield start + a, start + b, c, d
        else:
            yield start, end, core, until


@pytest.mark.parametrize("size, overlap, budget", [(120, 30, 40), (20, 6, 15), (9, 2, 5)])
def test_split_windows_match_recursion(spark, size, overlap, budget):
    rng = random.Random(12)
    rows = [(k, " " * rng.randrange(3) + " ".join("w" * rng.randrange(1, 6) for _ in range(rng.randrange(90))) + "\n" * rng.randrange(2)) for k in range(60)] + [(98, None), (99, " ")]
    frame = spark.createDataFrame(rows, "id int, text string")
    counts = F.transform(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)), lambda w: F.length(w))
    got = {r.id: r.w for r in frame.select("id", ner.split_windows(F.col("text"), counts, budget, size, overlap).alias("w")).collect()}
    for k, t in rows:
        if t is None:
            assert got[k] is None
        else:
            each = [len(w) for w in t.split()]
            assert [tuple(w) for w in got[k]] == sorted(cut(t, each, size, overlap, budget), key=lambda w: (w[0], -w[1], w[2]))


def test_split_is_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "id int, text string").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").select(F.explode(ner.split_windows(F.col("text"), F.array(F.lit(1), F.lit(1)))).alias("w"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and rows.count() == 1


def test_output_order(spark):
    found = spark.createDataFrame([(1, 5, 9, "P", 0.5), (1, 5, 12, "P", 0.4), (1, 2, 3, "P", 0.9), (2, 0, 1, "L", 0.9)], "id int, start int, end int, type string, score double")
    assert {(r.id, r.start, r.end): r.place for r in ner.output_order(found, ["id"]).collect()} == {(1, 2, 3): 1, (1, 5, 12): 2, (1, 5, 9): 3, (2, 0, 1): 1}


# ---------------------------------------------------------------- native rules


def test_native_rules_find_what_the_scan_finds(spark):
    rng = random.Random(13)
    pieces = ["a.b@c.org", "@", "é@ü.de", "x@y", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", ".", "06 12 34 56 78", "0612345678", "06.12", " ", " ", "\n", "-", "z", "\x01", "\x02", "⟦P-ABCDE⟧", "9", "漢", "😀"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for k in range(800)] + [(9000, None), (9001, ""), (9002, "a.b@c.org " * 500)]
    frame = spark.createDataFrame(rows, "id int, text string")
    for name in NATIVE:
        native = frame.select("id", detect.native_detections(F.col("text"), (name,)).alias("d"))
        plan = native._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        assert {r.id: r.d for r in native.collect()} == {r.id: r.d for r in frame.select("id", detect.rule_detections(F.col("text"), only=[name]).alias("d")).collect()}


# ---------------------------------------------------------------- sheets and reports


def test_header_rows_are_found(spark):
    rows = [
        ("s", 1, "A", "  ", None, False), ("s", 3, "A", "Name", None, False), ("s", 3, "B", "Name", None, True), ("s", 4, "A", "x", 7, False), ("s", 4, "B", "y", 7, False), ("s", 5, "A", "f", None, True),
        ("t", 0, "A", "other", None, False), ("t", 1, "A", "Name", None, False), ("t", 2, "A", "z", 8, False), ("u", 0, "A", None, None, False),
    ]
    sheet = spark.createDataFrame(rows, "sheet string, row int, column string, text string, string long, formula boolean")
    found = cells.selected(sheet, [" NAME "], ["sheet"])
    assert found.count() == len(rows)
    assert [(r.sheet, r.row, r.column) for r in found.filter("whole").collect()] == [("s", 4, "A")]
    marked = cells.shared_beyond(found.withColumn("book", F.lit(1)), ["book"], ["sheet"])
    assert [(r.string, r["columns"]) for r in marked.collect()] == [(7, 2)]
    strings = spark.createDataFrame([(1, 7, "shared")], "book int, string long, text string")
    texts = cells.with_texts(sheet.withColumn("book", F.lit(1)), strings, ["book"])
    assert {r.text for r in texts.filter("string = 7").collect()} == {"shared"} and texts.filter("string IS NULL AND text = 'Name'").count() == 3


def test_reports_are_rendered(spark):
    docs = spark.createDataFrame([(1, "a|b.txt"), (2, "c.txt")], "id int, name string")
    rows = spark.createDataFrame([(1, "⟦E-AAAAA⟧", "EMAIL_ADDRESS", "regex", 2, ("x|", "m", "\n")), (1, "⟦P-BBBBB⟧", "PERSON", "names", 1, ("", "n", ""))], "id int, token string, type string, source string, occurrences long, context struct<before:string,match:string,after:string>")
    got = dict(report.anonymize_markdown(docs, rows, ["id"]).collect())
    assert got[1].splitlines() == [
        "# Anonymized: `a|b.txt`", "", "- entities: 2", "  - PERSON: 1", "  - EMAIL_ADDRESS: 1", "", "## Replacements", "", "| token | type | source | occurrences | first context |", "|---|---|---|---:|---|",
        "| ⟦P-BBBBB⟧ | PERSON | names | 1 | **n** |", "| ⟦E-AAAAA⟧ | EMAIL_ADDRESS | regex | 2 | x\\|**m**  |",
    ]
    assert got[2] == "# Anonymized: `c.txt`\n\n- entities: 0\n\n## Replacements\n\nnone\n"
    back = spark.createDataFrame([(1, "⟦P-BBBBB⟧", "restored", "PERSON", 3), (1, "⟦P-CCCCC⟧", "missing", "PERSON", 0), (2, "⟦P-ZZZZZ⟧", "unknown", None, 1)], "id int, token string, status string, type string, n long")
    got = dict(report.restore_markdown(docs, back, ["id"]).collect())
    assert "| ⟦P-BBBBB⟧ | PERSON | 3 |" in got[1] and "- ⟦P-CCCCC⟧ (PERSON)" in got[1] and "Unknown" not in got[1]
    assert got[2].splitlines()[2:6] == ["## Unknown tokens", "", "| token | occurrences |", "|---|---:|"] and got[2].endswith("## Missing tokens\n\nnone\n")


def test_split_windows_of_null_texts_and_counts(spark):
    rows = [(1, "a b", [1, 1]), (2, None, [1]), (3, "a", None), (4, "", [])]
    frame = spark.createDataFrame(rows, "id long, text string, counts array<int>").coalesce(1)
    got = {r.id: r.w and [tuple(x) for x in r.w] for r in frame.select("id", ner.split_windows(F.col("text"), F.col("counts")).alias("w")).collect()}
    assert got == {1: [(0, 3, 0, 3)], 2: None, 3: None, 4: [(0, 0, 0, 0)]}
