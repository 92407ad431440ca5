import random
import tracemalloc
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from umbra.functions import places, runs
from umbra.operators import detect, flow, mapping, rewrite

BLANK = r"[\s\ufeff]"


def pattern(value):
    words = [w for w in regex.split(f"{BLANK}+", unicodedata.normalize("NFKC", value)) if w]
    if not words:
        return None
    alnum = lambda c: regex.match(r"[\p{L}\p{N}]", c)
    left = r"(?<![\p{L}\p{N}])" if alnum(words[0][0]) else ""
    right = r"(?![\p{L}\p{N}])" if alnum(words[-1][-1]) else ""
    return regex.compile(left + f"{BLANK}*".join(map(regex.escape, words)) + right)


def brute(values, text):
    """Places in the text, from matches in its normal form."""
    normal, first, end = places.normal_form(text)
    return sorted((first[m.start()], end[m.end() - 1], k) for k, v in enumerate(values) if (p := pattern(v)) for m in p.finditer(normal))


def brute_claims(values, text):
    taken, out = set(), []
    for k in sorted(range(len(values)), key=lambda k: (-len(values[k]), k)):
        for a, b, _ in [p for p in brute(values, text) if p[2] == k]:
            if not taken & set(range(a, b)):
                taken |= set(range(a, b))
                out.append((a, b, k))
    return sorted(out)


def made(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(1, most)))


def test_normal_form_in_parts():
    rng = random.Random(5)
    letters = ["a", "b", " ", "e\u0301", "\u0301", "\u0323", "\ufb01", "\uff21", "\u2460", "\u1100", "\u1161", "\u11a8", "\uff76", "\uff9e", "\u09c7", "\u09be", "\u3000", "\u212b", "\u0958"]
    for _ in range(3000):
        text = made(rng, letters, 9)
        normal, first, end = places.normal_form(text)
        assert normal == unicodedata.normalize("NFKC", text) and len(normal) == len(first) == len(end)
        assert all(a < b for a, b in zip(first, end, strict=True)) and list(first) == sorted(first)


def test_places_and_claims_match_brute_force():
    rng = random.Random(6)
    for _ in range(3000):
        values = [made(rng, "ab +*\ufb01fi ", 6) for _ in range(4)]
        text = made(rng, "ab  +*\ufb01fi \u0301\uff21\n", 26)
        held = places.Values(values)
        assert held.places(text) == brute(values, text)
        assert held.claimed(text) == brute_claims(values, text)


def test_leaks_of_the_check(spark):
    texts = spark.createDataFrame([(1, "by JeanDupont today"), (2, "jean@x.org and x.org alone"), (3, None), (4, "a *** b"), (4, "a *** b")], "id int, text string")
    known = spark.createDataFrame([("Jean Dupont", "t1"), ("jean@x.org", "t2"), ("x.org", "t3"), ("***", "t4"), (None, "t5"), (" ", "t6"), ("***", "t0")], "original string, token string")
    for most in (100, 1):
        assert {(r.id, r.value) for r in rewrite.leaks(texts, known, ["id"], most=most).collect()} == {(1, "Jean Dupont"), (2, "jean@x.org"), (2, "x.org"), (4, "***")}
        got = {(r.id, r.start, r.end, r.token) for r in rewrite.claimed(texts, known, ["id"], most=most).collect()}
        assert got == {(1, 3, 13, "t1"), (2, 0, 10, "t2"), (2, 15, 20, "t3"), (4, 2, 5, "t0")}


@pytest.mark.parametrize("most", [1000, 3])
def test_both_ways_of_looking_up(spark, most):
    rng = random.Random(7)
    values = sorted({made(rng, "ab +*\ufb01fi ", 6) for _ in range(30)})
    rows = [(k, made(rng, "ab  +*\ufb01fi \u0301\n", 30)) for k in range(60)]
    texts = spark.createDataFrame(rows, "id int, text string")
    known = spark.createDataFrame([(v, f"t{k}", k) for k, v in enumerate(values)], "original string, token string, first int")
    got = sorted((r.id, r.start, r.end, r.value) for r in rewrite.leak_places(texts, known, ["id"], most=most).collect())
    assert got == sorted((i, a, b, values[k]) for i, t in rows for a, b, k in brute(values, t))
    got = sorted((r.id, r.start, r.end, r.token) for r in rewrite.claimed(texts, known, ["id"], order_col="first", most=most).collect())
    assert got == sorted((i, a, b, f"t{k}") for i, t in rows for a, b, k in brute_claims(values, t))


def test_values_of_one_first_word_meet_their_own_texts(spark):
    rows = [(k, f"x \ufb01n{k}, fin\n {k}! xfin {k}", f"fin {k}") for k in range(300)]
    frame = spark.createDataFrame(rows, "id int, text string, original string")
    wanted = frame.select(F.col("original").alias("value"), F.lit("t").alias("token"), F.col("original").alias("_order"), F.regexp_replace("original", " ", "").alias("_key"))
    assert {(r.id, r.value) for r in rewrite._met(frame.select("id", "text"), wanted, ["id"], "text").collect()} == {(k, v) for k, _, v in rows}
    got = rewrite.leak_places(frame.select("id", "text"), frame, ["id"], most=10).collect()
    assert sorted((r.id, r.start, r.end, r.value) for r in got) == sorted((i, a, b, v) for i, t, v in rows for a, b, _ in brute([v], t))


def test_long_values_both_ways(spark):
    rng = random.Random(8)
    values = sorted({" ".join(made(rng, "ab", 9) for _ in range(n)) for n in (1, 5, 15, 16, 17, 30, 40, 80) for _ in range(3)} | {"a" * n for n in (63, 64, 65, 127, 128, 129)})
    rows = [(k, f"{made(rng, 'ab ', 5)} {v if k % 2 else v.replace(' ', '')} {made(rng, 'ab ', 5)}") for k, v in enumerate(values)]
    texts, known = spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(v,) for v in values], "original string")
    for most in (1000, 2):
        got = sorted((r.id, r.start, r.end, r.value) for r in rewrite.leak_places(texts, known, ["id"], most=most).collect())
        assert got == sorted((i, a, b, values[k]) for i, t in rows for a, b, k in brute(values, t)) and len(got) >= len(values)


def rows_of_words(text, sizes):
    words = runs.WORD.findall(unicodedata.normalize("NFKC", text))
    bare, at = "".join(words), 0
    for k, w in enumerate(words):
        for j in range(k + 1, len(words) + 1):
            if sum(map(len, words[k:j])) in sizes:
                yield "".join(words[k:j])
        yield from (bare[at : at + n] for n in sizes if n >= rewrite.WHOLE_KEY and at + n <= len(bare))
        at += len(w)


def bits_of(spark, keys):
    found = spark.createDataFrame([(int(h),) for h in runs.hashes_of(keys).view("int64")], "h long")
    return runs.bitmap(found, len(keys))


def test_few_rows_of_words_leave_a_text(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", *(made(rng, "abc  \ufb01\u0301\U0001f600\uff21,\n", 200) for _ in range(300)), "x" * 70 + " " + "y" * 200]
    every = [set() if t is None else set(rows_of_words(t, {1, 2, 5, 9, 64, 128})) for t in texts]
    keys = sorted({k for own in every for k in own})
    wanted, sizes = rng.sample(keys, 40) + ["x" * 64, "nowhere"], (1, 2, 5, 9)
    assert len(set(runs.hashes_of(keys).tolist())) == len(keys)
    got = runs.Wanted(sizes, (64, 128), bits_of(spark, wanted)).keys(texts)
    assert got[0] is None and got[1] == got[2] == []
    for own, held in zip(got[1:], every[1:], strict=True):
        assert len(own) == len(set(own)) and held & set(wanted) <= set(own) <= held
    assert sum(map(len, got[1:])) - sum(len(x & set(wanted)) for x in every) <= 0.01 * sum(map(len, every))


def test_memory_of_a_task_that_looks_for_many_values(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(("ab", "cde", "fghi")) + str(k) for k in range(400)) for _ in range(500)]
    held = runs.Wanted(range(4, 31), (), bits_of(spark, [f"no{k}" for k in range(20_000)]))
    held.keys(texts[:1])
    tracemalloc.start()
    assert sum(map(len, held.keys(texts))) < 100_000  # of some 800,000 rows of words
    assert tracemalloc.get_traced_memory()[1] < 8 * sum(map(len, texts)) + (48 << 20)
    tracemalloc.stop()


def test_first_token_wins(spark):
    found = spark.createDataFrame([(2, [(0, 1, "x", "URL", "regex", 1.0)]), (1, [(5, 6, "x", "PERSON", "names", 1.0)])], f"id int, detections {detect.DETECTIONS.simpleString()}")
    entities = mapping.allocated(mapping.occurrences(found, ["id"]), bytes(16))
    tokens = {r.type: r.token for r in entities.collect()}
    first = rewrite.replacements(found, entities, ["id"]).collect()
    assert [(r.original, r.token) for r in first] == [("x", tokens["PERSON"])]
    texts = spark.createDataFrame([(1, "an x")], "id int, text string")
    assert rewrite.scrubbed(texts, rewrite.replacements(found, entities, ["id"]), ["id"], order_col="first").first().scrubbed == f"an {tokens['PERSON']}"


def test_detect_anonymize_detect(spark):
    rows = [(1, "mail a.b@c.org and 10.0.0.1, 06 12 34 56 78"), (2, "nothing"), (3, None), (4, "a.b@c.org Jean Dupont")]
    texts = spark.createDataFrame(rows, "id int, text string")
    done, entities = flow.anonymized(texts, ["id"], bytes(16), names=["Jean Dupont"])
    once = done.select("id", F.col("anonymized").alias("text"))
    again = detect.detected(once, names=["Jean Dupont"])
    assert again.select("id", F.explode("detections").alias("d")).count() == 0
    twice = rewrite.with_tokens(again, ["id"], salt=bytes(16)).select("id", F.concat("anonymized", F.lit(" x@y.org")).alias("text"))
    thrice = detect.detected(twice).select("id", F.explode("detections").alias("d")).select("id", "d.text").collect()
    assert sorted(map(tuple, thrice)) == [(1, "x@y.org"), (2, "x@y.org"), (4, "x@y.org")]
    lazy = rewrite.with_tokens(detect.detected(texts), ["id"], salt=bytes(16)).select("id", F.col("anonymized").alias("text"))
    assert detect.detected(lazy).filter(F.size("detections") > 0).count() == 0
    assert dict(rewrite.restored(once, entities, ["id"]).select("id", "restored").collect()) == dict(rows)


def test_numbered_tokens_are_looked_up(spark):
    texts = spark.createDataFrame([(1, "a@b.org"), (2, "c@d.org"), (3, "none"), (4, None)], "id int, text string")
    found = detect.detected(texts)
    entities = mapping.allocated(mapping.occurrences(found, ["id"]), bytes(16)).withColumn("token", F.when(F.col("original") == "c@d.org", "⟦E-ABCDE2⟧").otherwise(F.col("token")))
    assert [r.original for r in mapping.numbered(entities, bytes(16)).collect()] == ["c@d.org"]
    got = dict(rewrite.with_tokens(found, ["id"], entities, bytes(16)).select("id", "anonymized").collect())
    assert got[2] == "⟦E-ABCDE2⟧" and got[3] == "none" and got[4] is None and got[1].startswith("⟦E-")
