import collections
import itertools
import random

import numpy as np
import xxhash

from umbra.llm import similar, simhash
from umbra.llm.bitmaps import bitmap, within
from umbra.llm.components import connected_components


def brute_fp(text, k=4):
    w = [x for x in __import__("re").findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    g = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)) if h else 0


def roots(n, edges):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = roots(400, edges)
    assert all(got[n] == want[n] for n in got)
    assert {n for e in edges for n in e if e[0] != e[1]} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("abAB éß\t\n\x0b\x1c .") for _ in range(rng.randrange(60)))
        assert simhash.majority_bits(simhash.shingle_hashes(simhash.words_of(t), 4)) == brute_fp(t)


def test_links_connect_all_within_radius(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base) | {0, 1, 3, (1 << 64) - 1}
    for b in base:
        for _ in range(8):
            x = b
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    for radius, block in ((4, 4096), (4, 5), (7, 64), (0, 8), (2, 16)):
        want = roots(len(fps), [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(fps), 2) if (a ^ b).bit_count() <= radius])
        at = {simhash.signed(x): k for k, x in enumerate(fps)}
        edges = [(at[a], at[b]) for a, b in simhash.links(frame, radius, block).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= radius for a, b in edges)
        assert roots(len(fps), edges) == want


def test_plan_covers_radius():
    rng = np.random.default_rng(0)
    bits = rng.random((500, 64)) < rng.random(64)
    bits[:, 1] = bits[:, 0]
    both = bits.T.astype(float) @ bits
    for n in (10, 500, 10**6, 10**10):
        for radius in (0, 3, 4, 7):
            plan = simhash.allocate(both, n, radius)
            assert sum(t + 1 for _, t in plan) >= radius + 1
            used = [b for part, _ in plan for b in part]
            assert len(used) == len(set(used))


def test_near_duplicates_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two three four five"), (5, "ONE two  three four five"), (6, "x"), (6, "x"), (None, "one two three four five"), (None, "y z"), (9, "word " * 30000)]
    got = {(r.id, r.fp, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    by = {r[0]: r for r in got}
    assert by[1][1] == by[2][1] == by[3][1] == 0 and by[3][2] == 1
    assert by[5][2] == 4 and simhash.near_duplicates(docs(spark, rows)).count() == len(rows)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_similar_groups_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["w%d" % k for k in range(400)]
    rows = []
    for k in range(12):
        base = [rng.choice(vocab) for _ in range(150)]
        rows.append(base)
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randrange(1, 4)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append(x)
    rows = [(k, " ".join(x)) for k, x in enumerate(rows)] + [(500, None), (501, ""), (None, "w1")]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in rows if t and i is not None}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(84, edges)
    for block in (256, 3):
        got = dict(similar.similar_groups(docs(spark, rows), block=block).collect())
        assert [got[k] for k in range(84)] == want
        assert got[501] == 500 and got[None] is None


def test_similar_groups_with_blocks_of_new_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    rows, shared = [], [word() for _ in range(12)]
    for k in range(60):
        n = rng.choice((60, 200, 600))
        base = [word() for _ in range(n)]
        at = rng.randrange(10, n - 10)
        base[at:at] = shared  # a common line in unlike texts
        extra = [word() for _ in range(int(n * rng.uniform(0.05, 0.24)))]
        changed = [base + extra, base[: n - len(extra)], base[:at] + extra + base[at:]][k % 3]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(changed))]
    rows += [(9000, "a b c"), (9001, "a b c"), (9002, "a b d"), (None, rows[0][1])]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in rows if i is not None}
    ids = list(sets)
    alike = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]])]
    fps = dict(simhash.fingerprints(docs(spark, rows), shingle=0).collect())
    assert sum((fps[ids[a]] ^ fps[ids[b]]).bit_count() > 7 for a, b in alike) >= 5
    got = dict(similar.similar_groups(docs(spark, rows)).collect())
    assert [ids.index(got[i]) for i in ids] == roots(len(ids), alike)


def test_deduplicated_keeps_unlike_texts_of_equal_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven", "quick brown fox jumps over lazy dogs today")
    rows = [(3, a), (7, a), (7, b), (7, b.upper()), (7, b), (8, c), (8, c), (None, c), (None, "only here and nowhere else at all"), (9, None), (10, "")]
    got = collections.Counter((r.doc_id, (r.text or "").lower()) for r in similar.deduplicated(docs(spark, rows)).collect())
    assert got == {(3, a): 1, (7, b): 1, (8, c): 1, (None, "only here and nowhere else at all"): 1, (9, ""): 1}
    assert similar.deduplicated(docs(spark, [])).count() == 0
    assert similar.deduplicated(docs(spark, rows)).columns == docs(spark, rows).columns


def test_a_large_group_of_near_copies_meets_in_few_pairs(spark, monkeypatch):
    rng = random.Random(12)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(240):
        words = list(base)
        for at in rng.sample(range(120), 2):
            words[at] = f"n{k}x{at}"
        rows.append((k, " ".join(words)))
    met, stage = [], similar.stage

    def counted(df, name):
        out = stage(df, name)
        if name == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(similar, "stage", counted)
    docs = spark.createDataFrame([*rows, (900, "something else that stands alone")], "doc_id long, text string")
    # no bits may differ, so that fingerprints leave the copies apart
    got = {r.id: r.group for r in similar.similar_groups(docs, radius=0, block=64).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    root = list(range(240))
    for a in range(240):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    assert [got[k] for k in range(240)] == root and got[900] == 900
    assert sum(met) < 240 * 239 / 4


def test_stars_read_large_buckets_only_and_places_are_dealt_once(spark, monkeypatch):
    """Places were counted, joined and sent anew for each turn of stars, small buckets with them."""
    rng = random.Random(21)
    rows = []
    for k in range(10):  # pairs of near copies that no large bucket holds
        base = [f"p{k}x{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:60], "other", *base[61:]]))]
    large = [f"w{k}" for k in range(120)]
    copies = [(1000 + k, " ".join([*large[: 3 * k], f"n{k}", *large[3 * k + 1 :]])) for k in range(40)]
    dealt, turns, one_stage, candidates = [], [], similar.stage, similar._candidates

    def told(rows, similarity, which, *rest):
        turns.append((which, rows.select("node").distinct().count()))
        return candidates(rows, similarity, which, *rest)

    monkeypatch.setattr(similar, "stage", lambda df, name: dealt.append(name) or one_stage(df, name))
    monkeypatch.setattr(similar, "_candidates", told)
    got = {r.id: r.group for r in similar.similar_groups(spark.createDataFrame(rows + copies, "doc_id long, text string"), radius=0, block=8).collect()}
    assert got == {k: k - k % 2 for k in range(20)} | {1000 + k: 1000 for k in range(40)}
    assert turns[0] == ("star", 40) and dealt.count("sizes") <= 2


def test_a_bitmap_takes_few_jobs_whatever_the_partitions(spark):
    """Its segments came by a job for each shuffle partition: 211 of them took 23 s for a bitmap of a few KB."""
    members = [(k * 0x9E3779B97F4A7C15 % 2**64) - 2**63 for k in range(2000)]
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("bitmap", "one bitmap")
        bits = bitmap(spark.createDataFrame([(m,) for m in members], "v long"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")
    finally:
        spark.sparkContext.setJobGroup("others", "others")
        for k, v in before.items():
            spark.conf.set(k, v)
    assert within(np.array(members).view(np.uint64), bits).all() and 1 <= len(jobs) <= 8


def test_a_turn_of_stars_that_joins_few_groups_is_the_last(spark, monkeypatch):
    """Stars were made again for a handful of groups: each turn reads all large buckets, and the pairs that it spares are few."""
    large = [f"w{k}" for k in range(120)]
    copies = [(k, " ".join([*large[: 3 * k], f"n{k}", *large[3 * k + 1 :]])) for k in range(40)]
    turns, candidates = [], similar._candidates

    def told(dealt, similarity, which, *rest):
        turns.append(which)
        return candidates(dealt, similarity, which, *rest)

    monkeypatch.setattr(similar, "_candidates", told)
    got = {r.id: r.group for r in similar.similar_groups(spark.createDataFrame(copies, "doc_id long, text string"), radius=0, block=8).collect()}
    assert got == {k: 0 for k in range(40)} and turns.count("star") == 1
