import hashlib
import hmac
import random

from pyspark.sql import functions as F

from umbra.functions import tokens
from umbra.operators import detect, mapping, report, rewrite


def python_token(salt, letter, kind, value):
    n = int.from_bytes(hmac.new(salt, f"{kind}\0{value}".encode(), hashlib.sha256).digest()[:5], "big")
    return f"⟦{letter}-" + "".join(tokens.ALPHABET[n // 31**k % 31] for k in range(5)) + "⟧"


def test_golden_tokens(spark):
    rows = spark.createDataFrame([("PERSON", "Paulina Kowalski"), ("EMAIL_ADDRESS", "p.k@example.org")], "t string, v string")
    got = [r[0] for r in rows.select(tokens.derive_token(bytes(16), F.col("t"), F.col("v"))).collect()]
    assert got == ["⟦P-4WW4X⟧", "⟦E-8CPCA⟧"]


def test_tokens_match_hmac(spark):
    salt = b"another test key"
    values = [f"v{k} é漢😀" for k in range(200)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(tokens.derive_token(salt, F.lit("URL"), F.col("v"))).collect()]
    assert got == [python_token(salt, "U", "URL", v) for v in values]


def test_token_shape(spark):
    good = ["⟦P-ABCDE⟧", "⟦P-ABCDE2⟧", "⟦P-ABCDE12⟧"]
    bad = ["⟦P-ABCDE1⟧", "⟦P-ABCDE0⟧", "⟦P-ABCD⟧", "⟦P-ABCDEF⟧", "⟦X-ABCDE⟧", "⟦P-ABCD1⟧", "⟦p-abcde⟧", "[P-ABCDE]"]
    rows = spark.createDataFrame([(v, v in good) for v in good + bad], "v string, ok boolean")
    assert rows.filter(tokens.is_token(F.col("v")) != F.col("ok")).count() == 0


def test_round_trip(spark):
    rng = random.Random(42)
    pieces = ["06 12 34 56 78", "a.b@example.org", "FR76 3000 6000 0112 3456 7890 189", "10.0.0.1", "Jean Dupont", "https://x.example/a"]
    fill = ["word", "und", "é", "⟦P-ZZZZZ⟧", "12", "\t", ", "]
    rows = [(k, " ".join(rng.choice(pieces) if rng.random() < 0.4 else rng.choice(fill) for _ in range(12))) for k in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    found = detect.detected(docs, names=["Jean Dupont"]).cache()
    entities = mapping.allocated(mapping.occurrences(found, ["id"]), bytes(16)).cache()
    done = rewrite.with_tokens(found, ["id"], entities, bytes(16)).select("id", F.col("anonymized").alias("text")).cache()
    assert sorted(map(repr, done.collect())) == sorted(map(repr, rewrite.with_tokens(found, ["id"], entities).select("id", F.col("anonymized").alias("text")).collect()))
    numbered = entities.withColumn("token", F.when(F.col("original") == "10.0.0.1", "⟦A-ABCDE2⟧").otherwise(F.col("token")))
    assert sorted(map(repr, rewrite.with_tokens(found, ["id"], numbered, bytes(16)).select("anonymized").collect())) == sorted(map(repr, rewrite.with_tokens(found, ["id"], numbered).select("anonymized").collect()))
    back = dict(rewrite.restored(done, entities, ["id"]).select("id", "restored").collect())
    assert back == dict(rows)
    assert detect.detected(done, names=["Jean Dupont"]).filter(F.size("detections") > 0).count() == 0
    assert rewrite.leaks(done, entities, ["id"]).count() == 0
    assert {r.token for r in rewrite.unknown_tokens(done, entities).collect()} == {"⟦P-ZZZZZ⟧"}
    assert rewrite.missing_tokens(done, entities).count() == 0


def test_collisions_and_reuse(spark):
    values = spark.createDataFrame([("PERSON", n, 1, "names", k) for k, n in enumerate(["a", "b", "c"])], "type string, original string, occurrences long, source string, first int")
    same = F.lit("⟦P-ABCDE⟧")
    first = mapping.allocated(values, bytes(16), token_of=same)
    got = {r.original: (r.token, r.collision) for r in first.collect()}
    assert got == {"a": ("⟦P-ABCDE⟧", False), "b": ("⟦P-ABCDE2⟧", True), "c": ("⟦P-ABCDE3⟧", True)}
    existing = first.filter("original <> 'a'")
    more = spark.createDataFrame([("PERSON", "b", 7, "ner", 0), ("PERSON", "x", 2, "ner", 1), ("PERSON", "y", 2, "ner", 2)], values.schema)
    got = {r.original: (r.token, r.occurrences, r.source) for r in mapping.allocated(more, bytes(16), existing, same).collect()}
    assert got == {"b": ("⟦P-ABCDE2⟧", 7, "names"), "c": ("⟦P-ABCDE3⟧", 1, "names"), "x": ("⟦P-ABCDE⟧", 2, "ner"), "y": ("⟦P-ABCDE4⟧", 2, "ner")}


def test_edits_and_contexts(spark):
    row = spark.createDataFrame([("abc def ghi", [(0, 3, "X"), (8, 11, "YYYY")])], "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert row.select(rewrite.applied(F.col("t"), F.col("e"))).first()[0] == "X def YYYY"
    c = row.select(rewrite.context(F.lit("x" * 50 + " \n v " + "y" * 50), F.lit(53), F.lit(54)).alias("c")).first().c
    assert c.before == "…" + "x" * 37 + " " and c.match == "v" and c.after == " " + "y" * 39 + "…"
    assert row.select(report.cell(F.lit("a|b\\c\r\nd"))).first()[0] == "a\\|b\\\\c d"
