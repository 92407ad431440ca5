import itertools
import random

import pytest
import regex
from pyspark.sql import functions as F

from umbra.functions import checks, rules
from umbra.functions.kinds import DETECTIONS
from umbra.operators import detect, overlaps

BY_NAME = {r.name: r for r in rules.RULES}


def found(name, text):
    return [text[a:b] for a, b in rules.scan(BY_NAME[name], text)]


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("email", "p.kowalski@example.org", ["p.kowalski@example.org"]),
        ("email", "jean.dupont+test@sous.example.fr; zoë.müller@exämple.de", ["jean.dupont+test@sous.example.fr", "zoë.müller@exämple.de"]),
        ("email", "a@b @example.org user@localhost nom @ example.org", []),
        ("url", "see https://intranet.example.fr/profil/jdupont.", ["https://intranet.example.fr/profil/jdupont"]),
        ("url", "(www.example.org/a?b=c)", ["www.example.org/a?b=c"]),
        ("url", "https://fr.wikipedia.org/wiki/Paris_(France)), example.org", ["https://fr.wikipedia.org/wiki/Paris_(France)"]),
        ("ipv4", "192.168.12.34 10.0.0.1:8080", ["192.168.12.34", "10.0.0.1"]),
        ("ipv4", "256.1.1.1 1.2.3 1.2.3.4.5", []),
        ("ipv6", "2001:db8::8a2e:370:7334 fe80:0:0:0:200:f8ff:fe21:67cf ::ffff:192.0.2.128", ["2001:db8::8a2e:370:7334", "fe80:0:0:0:200:f8ff:fe21:67cf", "::ffff:192.0.2.128"]),
        ("ipv6", "10:30:45 std::vector ::", []),
        ("iban", "FR76 3000 6000 0112 3456 7890 189 ET AUTRE", ["FR76 3000 6000 0112 3456 7890 189"]),
        ("iban", "DE89370400440532013000 GB82 WEST 1234 5698 7654 32", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]),
        ("iban", "FR76 3000 6000 0112 3456 7890 188", []),
        ("card", "4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("card", "5555-5555-5555-4444, 378282246310005, 3782 822463 10005", ["5555-5555-5555-4444", "378282246310005", "3782 822463 10005"]),
        ("card", "4111 1111 1111 1112", []),
        ("phone_international", "+33 1 23 45 67 89, +33612345678", ["+33 1 23 45 67 89", "+33612345678"]),
        ("phone_international", "0033 6 98 76 54 32; +49 (0)30 1234567; +44 20 7946 0958", ["0033 6 98 76 54 32", "+49 (0)30 1234567", "+44 20 7946 0958"]),
        ("phone_international", "+33 12", []),
        ("phone_french", "06 12 34 56 78 01.23.45.67.89 0612345678", ["06 12 34 56 78", "01.23.45.67.89", "0612345678"]),
        ("phone_french", "12/03/2026 2026 06 12 34 56", []),
        ("nir", "1 85 05 78 006 084 91, 185057800608491, 2 69 05 2A 123 456 88", ["1 85 05 78 006 084 91", "185057800608491", "2 69 05 2A 123 456 88"]),
        ("nir", "185057800608492", []),
    ],
)
def test_rule(name, text, want):
    assert found(name, text) == want


def test_scan_gives_up_and_goes_on():
    rule = rules.Rule("x", "URL", "[0-9]{4}", lambda t: True, lambda m: 4 if m.endswith("9") else 0)
    assert [m for m in rules.scan(rule, "12349 0009")] == [(1, 5), (6, 10)]


def test_card_scan_is_linear_replay():
    rng = random.Random(2)
    pattern = regex.compile(rules.CARD)
    for _ in range(300):
        t = "".join(rng.choice("4111 1-5555") for _ in range(rng.randrange(60)))
        want, at = [], 0
        while (m := pattern.search(t, at)) is not None:
            n = next((k for k in range(len(m[0]), 0, -1) if (k == len(m[0]) or (m[0][k] in " -" and m[0][k - 1].isdigit())) and rules.card_ok(m[0][:k])), 0)
            want += [(m.start(), m.start() + n)] if n else []
            at = m.start() + (n or 1)
        assert list(rules.scan(BY_NAME["card"], t)) == want


def replay(spans, n):
    kept = []
    for d in sorted(spans, key=lambda d: (d[0] - d[1], -d[3], d[0])):
        hits = [k for k in kept if d[0] < k[1] and k[0] < d[1]]
        if not hits:
            kept.append(list(d))
        elif len(hits) > 1 or not (hits[0][0] <= d[0] and d[1] <= hits[0][1]):
            kept = [k for k in kept if k not in hits] + [[min(d[0], *(h[0] for h in hits)), max(d[1], *(h[1] for h in hits)), hits[0][2], hits[0][3]]]
    return sorted(map(tuple, kept))


def test_overlaps_match_replay(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        spans = [(a := rng.randrange(20), a + rng.randrange(1, 9), rng.choice("PQR"), rng.choice([0.5, 0.9, 1.0])) for _ in range(rng.randrange(8))]
        rows.append((i, "abcdefghijklmnopqrstuvwxyz012345", [(a, b, "", t, "regex", s) for a, b, t, s in spans], spans))
    frame = spark.createDataFrame([r[:3] for r in rows], f"i int, t string, d {DETECTIONS.simpleString()}")
    got = {r.i: r.k for r in frame.select("i", overlaps.resolved(F.col("d"), F.col("t")).alias("k")).collect()}
    for i, t, _, spans in rows:
        assert [(d.start, d.end, d.type, d.score) for d in got[i]] == replay(spans, len(t))
        assert all(t[d.start : d.end] == d.text for d in got[i])
        assert all(a.end <= b.start for a, b in itertools.pairwise(got[i]))


def test_detected_edges(spark):
    rows = [(1, None, False), (2, "", False), (3, "jean  dupont, JEAN DUPONT ⟦P-ABCDE⟧", False), (4, " Jean \n", True), (5, "⟦P-ABCDE⟧", True), (6, "a.b@c.org", None)]
    out = detect.detected(spark.createDataFrame(rows, "id int, text string, whole boolean"), names=["Jean Dupont"], whole_col="whole")
    got = {r.id: None if r.detections is None else [(d.text, d.type, d.source) for d in r.detections] for r in out.collect()}
    assert got[1] is None and got[2] == []
    assert got[3] == [("jean  dupont", "PERSON", "names"), ("JEAN DUPONT", "PERSON", "names")]
    assert got[4] == [("Jean", "PERSON", "columns")] and got[5] == [] and got[6] == [("a.b@c.org", "EMAIL_ADDRESS", "regex")]


def test_native_checks(spark):
    rows = [("DE89370400440532013000", True), ("DE89370400440532013001", False), ("x", False), ("", False)]
    got = spark.createDataFrame(rows, "v string, ok boolean").select(checks.iban_valid(F.col("v")).alias("g"), "ok").collect()
    assert all(r.g == r.ok for r in got)
    rows = [("185057800608491", True), ("269052A12345688", True), ("185057800608492", False), ("", False)]
    got = spark.createDataFrame(rows, "v string, ok boolean").select(checks.nir_valid(F.col("v")).alias("g"), "ok").collect()
    assert all(r.g == r.ok for r in got)


def test_long_lists_of_names_find_what_short_ones_do(spark):
    rng = random.Random(9)
    letters = ["a", "b", "B", " ", "  ", "*", "-", "é", "\u0301", "_", "\u24b6", "\u24d0", "\t", "1", "\u00a0", *"sſSσςΣkK\u212aßẞiIıİ"]
    terms = sorted({" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))).split()) for _ in range(90)} - {""} | {"***", "* *"})
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for k in range(400)] + [(900, None), (901, "a *** b")]
    texts = spark.createDataFrame(rows, "id int, text string")
    short = {r.id: r.d for r in texts.select("id", detect.rule_detections(F.col("text"), names=terms, names_only=True).alias("d")).collect()}
    known = spark.createDataFrame([(t,) for t in [*terms, None, " "]], "term string")
    long = {r.id: r.names for r in detect.names_detections(texts, known, ["id"]).collect()}
    assert short == long and (2, 5) in [(d.start, d.end) for d in long[901]]


def test_words_of_ascii_fold_as_others_do(spark):
    words = ["", "Abc", "I1_x", "İx", "ıX", "Straße", "STRASSE", "ΑΣ", "ας", "É", "e\u0301"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(detect._folded_word(F.col("w")).alias("a"), detect._folded(F.col("w")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
