"""Whole mappings, check and restore reports, leak checks in NFKC, columns chosen whole, windows that are cut again."""

import json

from pyspark.sql import functions as F

from umbra.functions import checks
from umbra.operators import cells, detect, mapping, ner, report, rewrite
from umbra.sources import text


def test_written_mapping_is_valid_and_ordered(spark):
    entities = spark.createDataFrame([("a", "⟦P-ABCDE2⟧", 'x "y"\\z\n', "PERSON", 2, "names", True), ("a", "⟦P-ABCDE⟧", "Jean", "PERSON", 1, "names", False)], "k string, token string, original string, type string, occurrences long, source string, collision boolean")
    headers = spark.createDataFrame([("a", "2026-01-01T00:00:00+00:00", "a.txt", "0" * 64, "txt", mapping.salt_text(bytes(16)), False, None, None, ["w"]), ("b", "2026-01-01T00:00:00+00:00", "b.txt", "0" * 64, "txt", mapping.salt_text(bytes(16)), True, "p", "m", [])], "k string, created_at string, name string, sha256 string, format string, salt string, ner_enabled boolean, ner_provider string, ner_model string, warnings array<string>")
    done = mapping.written(headers, entities, "k").withColumn("problem", mapping.problem(F.col("json"))).collect()
    assert {r.k: r.problem for r in done} == {"a": None, "b": None}
    for r in done:
        value = json.loads(r.json)
        assert r.json == json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
        assert len(value["entities"]) == (2 if r.k == "a" else 0)
    assert len(mapping.new_salt()) == 16


def test_leaks_in_nfkc_and_claims(spark):
    texts = spark.createDataFrame([(1, "ｊean Dupont and Jean\u00a0Dupont"), (2, "JeanDupont"), (3, None), (4, "")], "id long, text string")
    values = spark.createDataFrame([("t1", "Jean Dupont"), ("t2", "Dupont"), ("t0", "Jean Dupont"), ("t3", "--")], "token string, original string")
    found = rewrite.leaks(texts, values, ["id"])
    assert {(r.id, r.value) for r in found.collect()} == {(1, "Jean Dupont"), (1, "Dupont"), (2, "Jean Dupont")}
    claims = rewrite.claimed(texts, values, ["id"]).collect()
    assert sorted((r.id, r.start, r.end, r.value, r.token) for r in claims) == [(1, 5, 11, "Dupont", "t2"), (1, 16, 27, "Jean Dupont", "t0"), (2, 0, 10, "Jean Dupont", "t0")]


def test_names_of_a_long_list(spark):
    texts = spark.createDataFrame([(1, "of JEAN \t dupont, Jeanne ⟦P-ABCDE⟧"), (2, "none"), (3, None)], "id long, text string")
    terms = spark.createDataFrame([("Jean Dupont",), ("Jean",), ("Jeanne",), *((f"of {k}",) for k in range(6000))], "term string")
    got = {r.id: r.names for r in detect.names_detections(texts, terms, ["id"]).collect()}
    assert [(d.start, d.end, d.text) for d in got[1]] == [(3, 16, "JEAN \t dupont"), (18, 24, "Jeanne")] and got[2] == [] and got[3] is None


def test_split_windows_and_recall(spark):
    words = " ".join(f"w{k}" for k in range(200))
    counts = F.transform(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)), lambda w: F.length(w) + 1)
    rows = spark.createDataFrame([(1, words), (2, "a " * 5)], "id long, text string").select("id", F.explode(ner.split_windows(F.col("text"), counts, budget=100)).alias("w")).select("id", "w.*")
    cut = rows.orderBy("id", "core_start").collect()
    own = [r for r in cut if r.id == 1]
    assert own[0].core_start == 0 and own[-1].core_end == len(words) and all(a.core_end == b.core_start for a, b in zip(own, own[1:], strict=False))
    assert all(r.end - r.start <= 100 for r in own) and sum(r.id == 2 for r in cut) == 1
    gold = spark.createDataFrame([(1, "fr", 0, 4, "PERSON"), (2, "fr", 0, 4, "PERSON"), (3, "de", 0, 4, "PERSON")], "id long, lang string, start int, end int, type string")
    found = spark.createDataFrame([(1, 0, 4, "PERSON"), (1, 0, 4, "PERSON"), (2, 0, 9, "PERSON"), (3, 0, 4, "LOCATION")], "id long, start int, end int, type string")
    assert {tuple(r) for r in ner.recall_by(found, gold, ["id"], "lang").collect()} == {("fr", 2, 2, 1), ("de", 1, 0, 0)}


def test_small_predicates(spark):
    rows = spark.createDataFrame([("de-AT",), ("DE",), ("den",), ("en",), (None,)], "tag string")
    assert [r[0] for r in rows.select(text.locale_of(F.col("tag"))).collect()] == ["de", "de", "fr", "fr", "fr"]
    one = spark.range(1)
    assert one.select(text.term_count(F.lit("a # x\n\n # y\r\n b "))).first()[0] == 2
    assert [r for r in one.select(report.is_clean(F.array(), F.lit(0)), report.is_clean(F.array(F.lit(1)), F.lit(0)), report.is_clean(F.lit(None).cast("array<int>"), F.lit(None).cast("int")), report.is_clean(F.array(), F.lit(2))).first()] == [True, False, True, False]
    assert [r[0] for r in spark.createDataFrame([("185057800608491",), ("185057800608492",), ("269052A12345688",), ("1850578",), ("x" * 15,)], "n string").select(checks.nir_valid(F.col("n"))).collect()] == [True, False, True, False, False]


def test_chosen_columns(spark):
    rows = spark.createDataFrame([("s", 0, "Name", "Name"), ("s", 1, " name ", " Jean "), ("s", 2, "Name", None), ("s", 1, "Other", "Jean")], "sheet string, row int, header string, text string")
    got = cells.whole_cells(cells.in_columns(rows, ["NAME"])).collect()
    assert [[d.text for d in r.detections] if r.detections is not None else None for r in got] == [None, ["Jean"], None, None]
    assert [r["column"] for r in cells.missing_columns(rows, ["name", "age"], ["sheet"]).collect()] == ["age"]
    assert cells.in_columns(rows, []).filter("whole").count() == 0
