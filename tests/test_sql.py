import random

from pyspark.sql import functions as F

from umbra import sql
from umbra.functions import tokens
from umbra.functions.kinds import DETECTIONS
from umbra.operators import detect, overlaps


def test_functions_in_sql(spark):
    rng = random.Random(31)
    pieces = ["a.b@c.org", "10.0.0.1", "06 12 34 56 78", "Jean  Dupont", "(Jean Dupont.", "⟦P-ABCDE⟧", " ", "x", "\t", "+33 1 23 45 67 89", "https://x.example/a_(b)).", "jean dupont@x.org"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))) for k in range(300)] + [(900, None), (901, "")]
    texts = spark.createDataFrame(rows, "id int, text string")
    texts.createOrReplaceTempView("texts")
    sql.register(spark, bytes(16))
    names = ["Jean Dupont", "x."]
    for listed, call in ((None, "umbra_detect(t.text)"), (names, "umbra_detect(t.text, array('Jean Dupont', 'x.'))")):
        want = detect.detected(texts, names=listed).select("id", F.explode("detections").alias("d")).select("id", "d.*")
        got = spark.sql(f"SELECT t.id, x.* FROM texts t, LATERAL {call} x")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = spark.sql("SELECT umbra_token('PERSON', 'Paulina Kowalski') AS a, umbra_token('PERSON', NULL) AS b, umbra_is_token('⟦P-ABCDE1⟧') AS c, umbra_tokens('x ⟦P-ABCDE⟧⟦P-ABCDE2⟧') AS d").first()
    assert tuple(one) == ("⟦P-4WW4X⟧", None, False, ["⟦P-ABCDE⟧", "⟦P-ABCDE2⟧"])
    values = spark.createDataFrame([(f"v{k} é😀",) for k in range(50)], "v string")
    assert values.filter(F.expr("umbra_token('URL', v)") != tokens.derive_token(bytes(16), F.lit("URL"), F.col("v"))).count() == 0


def test_overlaps_in_rows_as_natively(spark):
    rng = random.Random(32)
    text = "abcdefghijklmnopqrstuvwxyz012345"
    rows = [(k, text, [(a := rng.randrange(20), a + rng.randrange(1, 9), "", rng.choice("PQR"), rng.choice(["regex", "ner"]), rng.choice([0.5, 0.9, 1.0])) for _ in range(rng.randrange(8))]) for k in range(300)]
    frame = spark.createDataFrame(rows, f"i int, t string, d {DETECTIONS.simpleString()}")
    got = {r.i: [tuple(d) for d in r.k] for r in frame.select("i", overlaps.resolved(F.col("d"), F.col("t")).alias("k")).collect()}
    assert got == {k: overlaps.resolved_rows(d, t) for k, t, d in rows}
