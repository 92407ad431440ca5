import random

from pyspark.sql import functions as F

from umbra.sources import files, text


def test_ranges_give_the_lines_of_one(spark, tmp_path):
    rng = random.Random(21)
    pieces = [b"a", b"bc", b"\n", b"\r\n", b"\r", b"\xc3\xa9", b"\xff", b"\xe2\x82", b"\xef\xbb\xbf", b" " * 9]
    whole = {}
    for k in range(12):
        data = (b"\xef\xbb\xbf" if k % 3 == 0 else b"") + b"".join(rng.choice(pieces) for _ in range(rng.randrange(60)))
        (tmp_path / f"f{k}.txt").write_bytes(data)
        whole[f"f{k}.txt"] = data
    (tmp_path / "_hidden").write_bytes(b"x")
    for part in (1, 2, 3, 7, 1000):
        rows = files.lines(spark, str(tmp_path), part).withColumn("name", F.regexp_extract("name", r"([^/]+)$", 1)).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.name, r.offset)):
            got.setdefault(r.name, []).append(r)
        for name, data in whole.items():
            decoded = data.decode("utf-8-sig" if data.startswith(b"\xef\xbb\xbf") else "utf-8", "replace")
            assert "".join(r.text + r.separator for r in got.get(name, [])) == decoded
            starts = [0, *(m.end() for m in files._BREAK.finditer(data) if m.end() < len(data))] if data else []
            assert [r.offset for r in got.get(name, [])] == starts
            assert [r.bom for r in got.get(name, [])] == [k == 0 and data.startswith(b"\xef\xbb\xbf") for k in range(len(starts))]


def test_long_lines_are_read_once(spark, tmp_path):
    (tmp_path / "long.txt").write_bytes(b"x" * (3 << 20) + b"\r\n" + b"y" * 10)
    rows = files.lines(spark, f"file:{tmp_path}/", 1 << 20).collect()
    assert [(r.offset, len(r.text), r.separator) for r in sorted(rows, key=lambda r: r.offset)] == [(0, 3 << 20, "\r\n"), ((3 << 20) + 2, 10, "")]


def test_markdown_over_ranges(spark, tmp_path):
    rng = random.Random(22)
    pieces = ["```", "~~~~", "````", "``` x", "text", "a [l](u(v)w) b", "", "    ```", "   ~~~", "~~~"]
    texts = {}
    for k in range(20):
        texts[f"m{k}.md"] = "\n".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        (tmp_path / f"m{k}.md").write_text(texts[f"m{k}.md"])
    docs = spark.createDataFrame(list(texts.items()), "name string, text string")
    want = sorted((r.name, r.line, r.start, r.text) for r in text.markdown_segments(docs, ["name"]).collect())
    for part in (5, 40, 10_000):
        rows = files.lines(spark, str(tmp_path), part)
        got = files.markdown_segments(rows, part).withColumn("name", F.regexp_extract("name", r"([^/]+)$", 1)).collect()
        number = {(n, len("\n".join(t.split("\n")[:k])) + (k > 0)): k for n, t in texts.items() for k in range(len(t.split("\n")))}
        assert sorted((r.name, number[r.name, r.offset], r.start, r.text) for r in got) == want


def test_whole_files_with_invalid_bytes(spark, tmp_path):
    rng = random.Random(23)
    pieces = [b"a", b"\n", b"\xc3\xa9", b"\xff", b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80"]
    whole = {}
    for k in range(30):
        data = (b"\xef\xbb\xbf" if k % 5 == 0 else b"") + b"".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        (tmp_path / f"f{k}.txt").write_bytes(data)
        whole[f"f{k}.txt"] = (k % 5 == 0, data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace"))
    rows = text.read_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("name", r"([^/]+)$", 1)).collect()
    assert {r.name: (r.bom, r.text) for r in rows} == {k: v for k, v in whole.items() if v != (False, "")}  # Spark passes over empty files
    segments = spark.createDataFrame([(1, "a"), (2, " \u3000\t"), (3, ""), (4, None)], "id int, text string")
    assert [r.id for r in text.with_text(segments).collect()] == [1]
