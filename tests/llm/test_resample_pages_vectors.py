"""Importance resampling, main text of pages and centroid clustering against brute force, with nulls, repeats, ties and empty tables."""

import collections
import hashlib
import html
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import exponion, main_text, queries, resample

# ---------------------------------------------------------------- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_draw(docs, target, longest, buckets, seed, least, percent):
    features = lambda t: [" ".join(w[k : k + n]) for w in [words(t)] for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t))
    t = collections.Counter(bucket(f) for x in target for f in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in docs:
        own = [gain(bucket(f)) for f in features(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, len(words(text)) >= least])
    enough = sorted((r for r in out if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], "doc_id long, text string, score int, id string, part string")


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (2, 50), (3, 997)])
def test_draw_matches_brute_force(spark, longest, buckets):
    rng = random.Random(41)
    made = lambda n: "".join(rng.choice(["the ", "The-", "of ", "é ", "漢😀 ", "z9 ", "\n", "a\x00b ", "\x7f", "ß."]) for _ in range(n))
    docs = [(k, made(rng.randrange(60))) for k in range(300)] + [(None, made(40)), (None, made(40)), (7, made(50)), (1000, None), (1001, ""), (1002, " ;")]
    docs += [(2000, "the of é " * 10)] * 60  # one row many times
    target = [made(30) for _ in range(9)] + [None, ""]
    got = resample.resampled(texts(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), longest, buckets, "2024", 20, 10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_draw(docs, target, longest, buckets, "2024", 20, 10)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 16)
    monkeypatch.setattr(resample, "MOST_TUPLES", 20)
    rng = random.Random(42)
    for longest in (1, 2, 3):
        d = resample.Dictionary(longest, 101)
        for _ in range(200):
            text = "".join(rng.choice(["aB", " ", "é", "longlonglonglonglonglong", ".", "x "]) for _ in range(rng.randrange(40)))
            w = words(text)
            want = collections.Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % 101 for n in range(1, longest + 1) for k in range(len(w) - n + 1))
            got = collections.Counter(int(b) for part in resample._features(text.encode(), d) for b in part)
            assert got == want and [x.decode() for part in resample.words_of(text.encode()) for x in part] == w


def test_each_tuple_is_hashed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(resample.zlib, "crc32", lambda b, real=zlib.crc32: seen.append(b) or real(b))
    d = resample.Dictionary(2, 100)
    for _ in range(5):
        list(resample._features(b"a b a b c a b", d))
    assert len(seen) == len(set(seen)) and {b"a", b"b", b"c", b"a b", b"b a", b"b c", b"c a"} == set(seen)


def test_draw_from_empty_tables(spark):
    none = texts(spark, [])
    assert resample.resampled(none, none).count() == 0
    rows = resample.resampled(texts(spark, [(1, "a " * 30), (2, "b " * 30)] * 10), none).collect()
    assert sum(r.rank is not None for r in rows) == 2 and {r.rank for r in rows} == {None, 1, 2}


# ---------------------------------------------------------------- main text of pages

PROSE = "Lorem ipsum dolor sit amet, consectetur adipiscing elit; sed do eiusmod tempor. Ut enim ad minim veniam, quis nostrud exercitation."


def page(kind, rng):
    """A page and its main text."""
    paragraphs = [" ".join(rng.choice(PROSE.split()) for _ in range(rng.choice([3, 20, 60]))) + "." for _ in range(rng.randrange(3, 9))]
    title = "A title of " + rng.choice(["some", "few"]) + " words"
    esc = lambda t: html.escape(t)
    menu = "<nav><ul>" + "".join(f'<li><a href="/{k}">Entry {k}</a></li>' for k in range(8)) + "</ul></nav>"
    foot = "<footer>&copy; 2026 Somebody, all rights reserved.</footer>"
    aside = '<aside class="sidebar"><h3>Latest</h3><p>A teaser of another text, which is not so short, to be read elsewhere.</p></aside>'
    comments = '<section class="comments"><h2>3 comments</h2>' + "".join(f'<div class="comment"><p>{esc(" ".join(rng.choice(PROSE.split()) for _ in range(25)))}.</p></div>' for _ in range(4)) + "</section>"
    notice = '<div id="cookie-banner">We use cookies. <button>Accept</button> Please read our terms, they are long, and boring.</div>'
    form = '<form action="/s"><label>Search</label><input name="q"><p>Type a word, any word, and press the button.</p></form>'
    script = '<script>var t = "</p><p>not text"; if (a < b) {}</script><style>p > a {}</style><!-- <p>no</p> -->'
    body = "".join(f"<p>{esc(p)}</p>\n" for p in paragraphs)
    inner = paragraphs
    if kind == "article":
        main = f"<article><header><h1>{esc(title)}</h1></header>{body}</article>"
    elif kind == "div":
        main = f'<div id="wrap" class="page has-sidebar"><div class="content post-body"><h1>{esc(title)}</h1>{body}</div></div>'
    elif kind == "main":
        main = f"<main><h1>{esc(title)}</h1><div>{body}<ul><li>first point of a list</li><li>second</li></ul><blockquote>{esc(PROSE)}</blockquote></div></main>"
        inner = [*paragraphs, "first point of a list", "second", PROSE]
    elif kind == "flat":
        main = f"<h1>{esc(title)}</h1>{body}"
    else:
        main = "<table><tr><td>" + menu + "</td><td class='text'><h1>" + esc(title) + "</h1>" + body.replace("</p>", "") + "</td></tr></table>"
    source = f"<!DOCTYPE html><html><head><title>T</title>{script}</head><body class='has-sidebar comments-open'>{notice}<div class='header'><a href='/'>Site</a></div>{menu}{form}{main}{script}{aside}{comments}{foot}</body></html>"
    return source, "\n".join([title, *(" ".join(p.split()) for p in inner)])


@pytest.mark.parametrize("kind", ["article", "div", "main", "flat", "table"])
def test_main_text_of_pages(kind):
    rng = random.Random(43)
    for _ in range(60):
        source, want = page(kind, rng)
        assert main_text.main_text(source) == want


@pytest.mark.parametrize("name", ["cookiebar", "comment-list", "commentlist", "adSlot", "topnav", "js-newsletter", "siteFooter", "related-links", "Sidebar2"])
def test_names_of_what_is_no_article(name):
    long = "A long text, with marks; and more, of the same. " * 9
    source = f"<body><div class=content><p>{long}</p><div class='{name}'><p>{long}</p></div><p class='lead adventure address'>{long}</p></div>"
    assert main_text.main_text(source) == "\n".join([long.strip()] * 2)


def test_main_text_of_the_given_pages(spark):
    """Their articles' own blocks, cut out by another way."""
    rows = duckdb.execute("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for _, source in rows:
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert main_text.main_text(source) == "\n".join(b for b in blocks if b)
    found = queries.op12_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) > 0 for r in found)


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""), ("", ""), (" \n", ""), ("no markup, at all", "no markup, at all"), ("a < b &amp; c &#x41;&eacute;&nbsp;x", "a < b & c Aé x"), ("<p>one<p>two<br>three</p>four", "one\ntwo three\nfour"),
        ("<article><p>it <b>is <i>so</b></i> &lt;b&gt;\n\n now", "it is so <b> now"), ("<article><p title='a>b'>x</p><p title=\"y>z>w</p>", "x\nz>w"), ("<article><p>a</p><!-- b", "a"), ("<article><p>a<script>b", "a"),
        ("<nav>only a menu</nav>", ""), ("<article><p>a</p><svg><text>x</text></svg><p>b<video>c</p></article>", "a\nb c"), ("<article hidden><p>a</p></article>", ""), ("<article><h1><a href=x>T u</a></h1><p>a b, c d.</p><ul><li><a>x</a></li><li><a>y</a></li></ul></article>", "T u\na b, c d."), ("<form><h1>a</h1><p>b c.</p></form><form><p>d e.</p></form>", "a\nb c."), ("<ARTICLE><P>a</P><LI>b<LI>c</ARTICLE>", "a\nb\nc"),
    ],
)
def test_main_text_of_odd_pages(source, want):
    text = main_text.main_text(source)
    assert text == want or (want.startswith("x\nz") and text.startswith("x"))


def test_extraction_keeps_rows(spark):
    rows = [(1, "u", None), (1, "u", "<article><p>a b, c.</p></article>"), (1, "u", "<article><p>a b, c.</p></article>"), (None, None, "")]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(repr, (tuple(r) for r in main_text.extracted(frame).collect()))) == sorted(map(repr, [(1, "u", "", 0), (1, "u", "a b, c.", 7), (1, "u", "a b, c.", 7), (None, None, "", 0)]))
    assert main_text.extracted(frame.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<div>", "<p>x", "<a \"", "<li><div>", "</p>", "<b>", "<td>", "<", "&", "<article class='a'>", "<!--", "<p>word, word. </p>", "<h1>", "</x>", "<svg>", "<a \"></svg"])
def test_long_pages_take_time_in_proportion(unit):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        main_text.main_text(unit * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


# ---------------------------------------------------------------- centroid clustering


def lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1])
    at = [v for _, v in sorted(kept, key=hashed)[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((distance(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(at)]
    done = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = collections.Counter()
    for _, j, d in done:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in done), key=repr)


@pytest.mark.parametrize("k, rounds, spread", [(8, 10, 1.0), (1, 3, 1.0), (30, 6, 1.0), (5, 4, 0.002), (16, 10, 0.01)])
def test_clusters_match_plain_rounds(spark, k, rounds, spread):
    rng = np.random.default_rng(44)
    dims = 6
    vectors = (rng.normal(size=(240, dims)) * spread + rng.integers(0, 4, (240, 1))).astype(np.float32).tolist()
    rows = list(enumerate(vectors)) + [(500, vectors[0])] * 40 + [(3, vectors[9]), (None, vectors[4]), (600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 7), (604, [float("nan")] * dims), (605, [float("inf")] + [0.0] * 5), (606, [None] + [0.0] * 5)]
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance int, id string")
    got = exponion.clustered(frame, k, rounds, "3", dims)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows, k, rounds, dims)


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [9e9, -9e9])], "vec_id long, embedding array<double>")
    rows = {r.id: r for r in exponion.clustered(frame, 8, 10, "3", 2).collect()}
    assert rows[1].cluster == rows[2].cluster and rows[1].distance == 0 and rows[3].distance == 0
    empty = exponion.clustered(frame.limit(0), 8, 10, "3", 2)
    assert empty.count() == 0 and empty.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_search_is_exact_and_takes_fewer_distances():
    rng = np.random.default_rng(45)
    for scale in (3, 40, 4000):  # few places: many ties
        x = rng.integers(-scale, scale, (3000, 4)) + rng.integers(0, 6, (3000, 1)) * 9 * scale
        at = x[rng.choice(len(x), 40, replace=False)].astype(np.int64)
        cluster, upper, lower = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
        before, taken = None, 0
        for _ in range(8):
            c = exponion.Centroids.of(at, before)
            cluster, upper, lower, n = exponion.search(x, cluster, upper, lower, c)
            d = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
            assert (cluster == d.argmin(axis=1)).all()
            own = np.sqrt(d[np.arange(len(x)), cluster])
            d[np.arange(len(x)), cluster] = 1 << 60
            assert (upper >= own).all() and (lower <= np.sqrt(d.min(axis=1).astype(float)) + 1e-9).all()
            taken += n
            before, at = at, np.array([np.floor_divide(x[cluster == j].sum(axis=0), max(1, (cluster == j).sum())) if (cluster == j).any() else at[j] for j in range(40)])
        assert taken < 8 * len(x) * 40 * 0.6


def test_squares_are_exact_at_any_size():
    x = np.array([[1 << 27, -(1 << 27)], [5, 7]])
    assert exponion.squared(x, x).tolist() == [[0, (2**27 - 5) ** 2 + (2**27 + 7) ** 2], [(2**27 - 5) ** 2 + (2**27 + 7) ** 2, 0]]
