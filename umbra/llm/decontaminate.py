"""Benchmark decontamination by winnowing.

A text's words are hashed; each run of GRAM words has a hash, and of each SPAN - GRAM + 1 neighbouring runs the least hash is kept
as a fingerprint. Two texts that share SPAN words in a row share the fingerprint of that place, so every such passage is met by
an equality of fingerprints; each meeting is then extended word by word in both directions. An item of fewer than SPAN words has
no such fingerprint: its whole hash is looked for among all runs of its length.

A benchmark of at most `most_words` words is sent to every task once, and documents are never shuffled. A larger one is joined, which
gives the same rows: a bitmap of its fingerprints goes to all tasks, and a place of a text whose fingerprint is in it is extended to the
windows that it stands for, by their hashes. These meet the items' windows in a join of hashes and places: no text is in it. Windows that the
same items have are one set, so that a passage joins its items once, however long it is and however many items have it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, within
from .common import in_chunks, passing, rows_of, stage

SPAN, GRAM = 13, 7
#: Words of a benchmark that is sent to the tasks: 8 bytes each, and about as much again for their fingerprints.
MOST_WORDS = 4_000_000
_MEMO = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes to word bytes: A-Z to a-z, and all that stands between words to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Hashes(dict):
    """Hash of a word, kept for words seen; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str | None, memo: dict) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out *= _MULTIPLIER
        out += words[k : len(words) - size + 1 + k]
    return out ^ (out >> np.uint64(29))


def _least(x: np.ndarray, size: int, of=np.minimum) -> np.ndarray:
    """Least of each `size` neighbours."""
    out = x
    done = 1
    while done < size:
        step = min(done, size - done)
        out = of(out[:-step], out[step:])
        done += step
    return out


def winnowed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs that are the least of some window (all of them, at ties)."""
    grams = run_hashes(words, GRAM)
    size = SPAN - GRAM + 1
    if len(grams) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _least(grams, size)
    pad = np.zeros(size - 1, np.uint64)
    kept = np.flatnonzero(_least(np.concatenate((pad, least, pad)), size, np.maximum) == grams)
    return kept, grams[kept]


def _run_on(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    n = min(len(a), len(b))
    at, step = 0, 32
    while at < n:
        same = a[at : min(n, at + step)] == b[at : min(n, at + step)]
        if not same.all():
            return at + int(same.argmin())
        at, step = min(n, at + step), step * 4
    return n


class Items:
    """Benchmark items as word hashes, with their fingerprints sorted for search."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        found: list[tuple[int, int, int]] = []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, w in enumerate(self.words):
            if len(w) >= SPAN:
                at, h = winnowed(w)
                found += zip(h.tolist(), [k] * len(at), at.tolist(), strict=True)
            elif len(w):
                self.short[len(w)][int(run_hashes(w, len(w))[0])].append(k)
        found.sort()
        self.short_keys = {n: np.array(sorted(x), np.uint64) for n, x in self.short.items()}
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.keys = np.array([f[0] for f in found], np.uint64)
        self.item = np.array([f[1] for f in found], np.int64)
        self.at = np.array([f[2] for f in found], np.int64)

    def _by_windows(self, words: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) as in spans(), of the given items, by the hashes of all windows."""
        own = run_hashes(words, SPAN)
        for i in items.tolist():
            at = np.flatnonzero(np.isin(own, run_hashes(self.words[i], SPAN)))
            cuts = np.flatnonzero(np.diff(at) > 1) + 1
            yield from ((i, int(part[0]), int(part[-1]) + SPAN) for part in np.split(at, cuts) if len(part))

    def spans(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of each passage of the words that is at least one window of the item."""
        at, h = winnowed(words)
        if len(at) and len(self.keys):
            left = np.searchsorted(self.keys, h)
            many = np.searchsorted(self.keys, h, side="right") - left
            hits = np.flatnonzero(many)
            if many.sum() > 4 * len(words) + 64:
                # words said over and over meet at every place: look up the windows themselves, once for each item
                yield from self._by_windows(words, np.unique(np.concatenate([self.item[a : a + n] for a, n in {*zip(left[hits].tolist(), many[hits].tolist(), strict=True)}])))
                hits = hits[:0]
            done: dict[tuple[int, int], int] = {}
            for x in hits.tolist():
                k, p = int(left[x]), int(at[x])
                while k < len(self.keys) and self.keys[k] == h[x]:
                    i, q = int(self.item[k]), int(self.at[k])
                    k += 1
                    if done.get((i, p - q), -1) >= p:
                        continue
                    w = self.words[i]
                    ahead = _run_on(words[p:], w[q:])
                    back = _run_on(words[:p][::-1], w[:q][::-1])
                    done[i, p - q] = p + ahead
                    if ahead + back >= SPAN:
                        yield i, p - back, p + ahead
        for n, keys in self.short_keys.items():
            runs = run_hashes(words, n)
            if len(runs):
                for p in np.flatnonzero(np.isin(runs, keys)).tolist():
                    for i in self.short[n][int(runs[p])]:
                        if (words[p : p + n] == self.words[i]).all():
                            yield i, p, p + n


def _digest(ids: set) -> tuple[int, str]:
    named = sorted(str(i) for i in ids if i is not None)
    return len(named), hashlib.sha256(",".join(named).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated; `keep`: columns carried along.

    A document is contaminated if passages shared with items cover a twentieth of its words or more. Null and blank texts have no
    words and are clean; items without words match nothing. Items of equal id count once; items of null id hit words but are not
    counted. Repeated documents keep their rows. Very long texts are read whole. Extra columns of either table are not read.
    """
    keep = keep or []
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text"))
    chars = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if chars <= 2 * most_words:  # a word and what ends it are two characters at least
        counted = _against_sent_items(docs, items, id_col, text_col, keep)
    else:
        counted = _against_joined_items(docs, items, id_col, text_col, keep)
    return _judged(counted)


def _judged(counted: DataFrame) -> DataFrame:
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; see contamination()."""
    items = benchmark.select(F.lit(0).alias("item_id"), F.col(item_text_col).alias("item_text"))
    if (items.agg(F.sum(F.length("item_text"))).first()[0] or 0) > 2 * most_words:
        text_key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
        texts = docs.select(text_key.alias("_key"), F.col(text_col).alias("text")).dropDuplicates(["_key"])
        hit = _judged(_against_joined_items(texts, items, "_key", "text", [])).filter("contaminated")
        whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text_key.alias("_key"))
        return whole.join(hit.select(F.col("id").alias("_key")), "_key", "left_anti").select("_row.*")
    memo = _Hashes()
    sent = docs.sparkSession.sparkContext.broadcast(Items([(i, word_hashes(t, memo)) for i, t in items.toLocalIterator()]))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, memo = sent.value, _Hashes()

        def clean(text: str | None) -> bool:
            words, hit = word_hashes(text, memo), None
            for _, start, end in bench.spans(words):
                hit = np.zeros(len(words), bool) if hit is None else hit
                hit[start:end] = True
            return hit is None or 20 * int(hit.sum()) < len(words)

        for batch in batches:
            yield batch.filter(pa.array((clean(v.as_py()) for v in batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _named(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), F.struct(*(F.col(k) for k in keep)).alias("_kept") if keep else F.lit(0).alias("_kept"))


def _against_sent_items(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    memo = _Hashes()
    sent = docs.sparkSession.sparkContext.broadcast(Items([(i, word_hashes(t, memo)) for i, t in items.toLocalIterator()]))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), *keep)
    fields = [f for f in named.schema if f.name != "_text"]
    names = [f.name for f in fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_words long, n_hit long, n_items long, items_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, memo = sent.value, _Hashes()
        clean = _digest(set())
        for batch in batches:
            n_words, n_hit, n_items, digests = [], [], [], []
            for value in batch.column("_text"):
                words = word_hashes(value.as_py(), memo)
                found, hit = set(), None
                for i, start, end in bench.spans(words):
                    if hit is None:
                        hit = np.zeros(len(words), bool)
                    hit[start:end] = True
                    found.add(bench.ids[i])
                n_words.append(len(words))
                n_hit.append(0 if hit is None else int(hit.sum()))
                count, digest = _digest(found) if found else clean
                n_items.append(count)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string())], names=[*names, "n_words", "n_hit", "n_items", "items_sha256"])

    return named.mapInArrow(run, ddl)


def _tagged(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words, told apart from those of other lengths."""
    x = (h ^ np.uint64(n * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) * _MULTIPLIER
    return x ^ (x >> np.uint64(32))


def _places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint and the hash of each window of SPAN words."""
    grams = run_hashes(words, GRAM)
    size = SPAN - GRAM + 1
    if len(grams) < size:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return _tagged(_least(grams, size), 0), _tagged(run_hashes(words, SPAN), SPAN)


def _item_windows(items: DataFrame) -> DataFrame:
    """(item_key, f, w, n) of items(item_key, text): fingerprint and hash of each window; an item of fewer words is one window, and its own fingerprint."""
    schema = pa.schema([("item_key", pa.binary()), ("f", pa.int64()), ("w", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for key, text in rows_of(batch):
                words = word_hashes(text, memo)
                if 0 < len(words) < SPAN:
                    h = int(_tagged(run_hashes(words, len(words)), len(words)).view(np.int64)[0])
                    yield key, h, h, len(words)
                else:
                    f, w = _places(words)
                    yield from ((key, a, b, SPAN) for a, b in zip(f.view(np.int64).tolist(), w.view(np.int64).tolist(), strict=True))

        for batch in batches:
            yield from in_chunks(rows(batch), schema)

    return items.mapInArrow(run, "item_key binary, f long, w long, n int")


def _windows_met(texts: DataFrame, marks: np.ndarray, lengths: list[int]) -> DataFrame:
    """(key, w, start, end) of texts(key, text): windows whose fingerprint the bitmap has, and runs of the other lengths that it has."""
    sent = texts.sparkSession.sparkContext.broadcast(marks)
    schema = pa.schema([("key", pa.binary()), ("w", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = _Hashes(), sent.value

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for key, text in rows_of(batch):
                words = word_hashes(text, memo)
                f, w = _places(words)
                for at, h, n in ((np.flatnonzero(within(f, known)), w, SPAN), *((np.flatnonzero(within(r, known)), r, n) for n in lengths for r in (_tagged(run_hashes(words, n), n),))):
                    yield from ((key, x, p, p + n) for x, p in zip(h[at].view(np.int64).tolist(), at.tolist(), strict=True))

        for batch in batches:
            yield from in_chunks(rows(batch), schema)

    return texts.mapInArrow(run, "key binary, w long, start long, end long")


def _against_joined_items(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    text_key = lambda c: F.unhex(F.sha2(F.coalesce(F.col(c), F.lit("")), 256))
    named = _named(docs, id_col, text_col, keep).withColumn("key", text_key("_text"))
    bench = items.withColumn("item_key", text_key("item_text"))
    with passing() as kept:
        windows = stage(_item_windows(bench.dropDuplicates(["item_key"]).select("item_key", F.col("item_text").alias("text"))).distinct(), "item-windows")
        lengths = [r.n for r in windows.filter(F.col("n") < SPAN).select("n").distinct().collect()]  # at most SPAN - 1 values
        marks = bitmap(stage(windows.select(F.col("f").alias("v")).distinct(), "fingerprints"))
        # windows that the same items have are one set, named by its least window
        items_of = stage(windows.groupBy("w").agg(F.count("*").alias("n"), F.sum(F.xxhash64("item_key").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "item_key")).alias("x")), "items-of-windows")
        sets = stage(items_of.join(items_of.groupBy("n", "s", "x").agg(F.min("w").alias("set")), ["n", "s", "x"]).select("w", "set"), "sets")
        texts = named.select("key", F.col("_text").alias("text")).dropDuplicates(["key"])
        found = kept(stage(_windows_met(texts, marks, lengths).join(sets, "w").select("key", "start", "end", "set"), "hits"))
        ids = bench.filter("item_id is not null").select("item_key", F.col("item_id").cast("string").alias("i")).distinct()
        named_sets = kept(stage(windows.select(F.col("w").alias("set"), "item_key").join(sets.select("set").distinct(), "set").join(ids, "item_key").select("set", "i").distinct(), "named-sets"))
    before = F.max("end").over(Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = found.select("key", "start", "end").distinct().withColumn("b", F.coalesce(before, F.lit(0)))
    covered = covered.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "b"))).alias("n_hit"))
    listed = found.select("key", "set").distinct().join(named_sets, "set").select("key", "i").distinct()
    listed = listed.groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("i")), ","), 256).alias("items_sha256"))

    words = F.size(F.filter(F.split(F.coalesce("_text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    out = named.withColumn("n_words", words.cast("long")).join(covered, "key", "left").join(listed, "key", "left")
    none = _digest(set())[1]
    return out.select("id", *(F.col(f"_kept.{k}").alias(k) for k in keep), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"))
