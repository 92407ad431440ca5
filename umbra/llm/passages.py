"""Repeated passages within and across documents: paragraph MinHash banding.

Paragraphs are lines; lines of fewer words than a shingle that follow each other are taken as one line. A longer line is cut where the
hash of two neighbouring words is the least (the first, at ties) of REACH places on either side, so that a passage is cut alike wherever
it stands, and around a word that is said over and over. A paragraph's signature is the least hash of its shingles under each of
`bands * rows` permutations, `bands` and `rows` chosen to find pairs of the asked similarity with the asked probability. Paragraphs that
collide in a band are compared by the exact Jaccard similarity of their shingle sets, and components of those links are classes of
copies. All occurrences but a class's first one are removals, where copied paragraphs in a row have MIN_WORDS words or more (those of
fewer words than a shingle are not counted).

The first pass over the texts counts band values; a bitmap holds those that occur more than once. The second pass sends only paragraphs
that the bitmap lets through; a full bitmap lets through more, never less: from some 100 M repeated values on it lets more and more through,
and in the end the second pass sends all paragraphs, in proportion to the texts.

Paragraphs of a value that over BLOCK different ones have meet by prefixes, which lose no pair: shingles have one order, those that many of
these paragraphs have come last; of n and m distinct shingles, two that are as similar as asked have common ones, the first of which is among
the first n - ceil(similarity * n) + 1 of either, and the second among one more. A shingle that stands in over BLOCK such prefixes is taken with a
second one. Paragraphs that share a common shingle and little else then do not meet. What is still large is compared in all pairs of blocks.
Only ids are dealt to where paragraphs meet; shingles are fetched for those that do.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, within
from .common import in_chunks, passing, rows_of, stage
from .components import connected_components
from .decontaminate import _Hashes, _least, run_hashes
from .simhash import blocked

#: Words on either side of a cut that decide on it; shingle size; words that copied paragraphs in a row must have to be reported.
REACH, SHINGLE, MIN_WORDS = 6, 5, 16
#: Paragraphs of a band value that meet in one task as they are.
BLOCK = 256
#: Characters of texts that are cut at once.
TOGETHER = 1 << 17


def tuned(similarity: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows) with the fewest band values a paragraph, then the most rows, that find a pair of this similarity with `recall`."""
    found = [(b, -r) for r in range(1, 9) for b in range(1, most + 1) if 1 - (1 - similarity**r) ** b >= recall]
    bands, rows = min(found)
    return bands, -rows


def _salts(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Paragraphs:
    """Cuts texts into paragraphs and gives their shingles and band values."""

    def __init__(self, bands: int, rows: int):
        self.memo, self.bands, self.rows, self.salts = _Hashes(), bands, rows, _salts(bands * rows)

    def of(self, text: str | None, named: bool = True):
        """(first word, word after the last, ids, shingle hashes, first shingle of each, band values) of the text, or None; without `named` no ids."""
        return found[2:] if (found := self.of_several([text], named)) is not None else None

    def of_several(self, texts: list[str | None], named: bool = True):
        """(texts' bytes, number of text of each paragraph), and of() with words numbered from the first text on, or None: all texts at once."""
        data = [(text or "").encode("utf-8", "surrogatepass").lower() for text in texts]
        split = [d.split() for d in data]
        many = np.array([len(words) for words in split])
        n = int(many.sum())
        if not n:
            return None
        raw = np.frombuffer(b"\n".join(data), np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        begin = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        text = np.repeat(np.arange(len(data)), many)
        # every text ends its last line
        number = np.cumsum(raw == 10)[begin]
        line = np.concatenate(([0], np.cumsum(number[1:] != number[:-1])))
        opens = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        short = np.diff(np.append(opens, n)) < SHINGLE
        joined = short[1:] & short[:-1] & (text[opens][1:] == text[opens][:-1])
        line = np.cumsum(np.concatenate(([True], ~joined)))[line]  # short lines in a row are one
        h = np.fromiter(map(self.memo.__getitem__, itertools.chain.from_iterable(split)), np.uint64, n)
        cut = np.concatenate(([True], line[1:] != line[:-1]))
        pairs = run_hashes(h, 2)
        if len(pairs) > 2 * REACH:
            behind = _least(pairs, REACH)
            least = _least(pairs, 2 * REACH + 1)
            # of equal ones only the first: a word said over and over is no place to cut
            inner = (pairs[REACH : REACH + len(least)] == least) & (least < behind[: len(least)])
            # a place whose window reaches over a line's or a text's end is no cut: that end is
            at = np.flatnonzero(inner)
            cut[at[(line[at] == line[at + 2 * REACH]) & (text[at] == text[at + 2 * REACH + 1])] + REACH] = True
        first_of_text = np.concatenate(([True], text[1:] != text[:-1]))
        runs = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])) | first_of_text), n)
        long = np.flatnonzero(np.diff(runs) > REACH)  # a word said over and over is a paragraph, however often
        cut[runs[long]] = True
        cut[runs[long + 1][runs[long + 1] < n]] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n)
        # shingles stay inside their paragraph; one of fewer words than a shingle is a shingle itself
        size = np.maximum(last - first - SHINGLE + 1, 1)
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        whole = run_hashes(h, SHINGLE)
        at = np.repeat(first - start, size) + np.arange(size.sum())
        shingles = whole[np.minimum(at, max(len(whole) - 1, 0))] if len(whole) else np.zeros(len(at), np.uint64)
        for k in range(1, SHINGLE):
            few = np.flatnonzero(last - first == k)
            shingles[start[few]] = run_hashes(h, k)[first[few]] + np.uint64(k)
        return data, text[first], first, last, self._ids(shingles, start, size) if named else None, shingles, start, self._values(shingles, start)

    @staticmethod
    def _ids(shingles: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
        """A hash of each paragraph's shingles in their order."""
        position = np.arange(len(shingles)) - np.repeat(start, many)
        spread = shingles * np.uint64(0x9E3779B97F4A7C15) + position.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        spread = (spread ^ (spread >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return np.add.reduceat(spread ^ (spread >> np.uint64(32)), start) + many.astype(np.uint64)

    def _values(self, shingles: np.ndarray, start: np.ndarray) -> np.ndarray:
        values = np.empty((self.bands, len(start)), np.uint64)
        for b in range(self.bands):
            value = np.full(len(start), b + 1, np.uint64)
            for salt in self.salts[b * self.rows : (b + 1) * self.rows]:
                x = shingles ^ salt
                x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                value = value * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x ^ (x >> np.uint64(29)), start)
            values[b] = value ^ (value >> np.uint64(32))
        return values

    @staticmethod
    def offsets(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word of several texts, in code points of its text."""
        raw = np.frombuffer(b"\n".join(data), np.uint8)
        blank = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]))
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        begin, end = edge[::2], edge[1::2]
        front = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))
        own = front[np.searchsorted(front, begin, side="right") - 1]  # where the word's text begins
        if raw.max(initial=0) < 128:
            return begin - own, end - own
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        return points[begin] - points[own], points[end] - points[own]


def _prefixed(crowded: DataFrame, similarity: float, block: int) -> DataFrame:
    """(pid, v): any two of crowded(pid, shingles) that are as similar as asked have a v in common.

    v is a shingle of the prefix, or where that stands in over `block` prefixes, a hash of it and of a later one; where one common shingle may
    be enough, of it and itself too.
    """
    each = pa.schema([("v", pa.int64())])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                held = [np.unique(np.frombuffer(s.as_py(), np.uint64)) for s in batch.column(0)[k : k + 1024]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], schema=each)

    counted = crowded.select("shingles").mapInArrow(distinct, "v long").groupBy("v").agg(F.count("*").alias("n"))
    last = crowded.sparkSession.sparkContext.broadcast(bitmap(stage(counted.filter(F.col("n") > block).select("v"), "common")))
    schema = pa.schema([("pid", pa.int64()), ("v", pa.int64()), ("later", pa.list_(pa.int64()))])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[int]]]:
            for pid, shingles in rows_of(batch):
                own = np.unique(np.frombuffer(shingles, np.uint64))
                late = within(own, last.value)
                need = int(np.ceil(similarity * len(own) - 1e-9))
                most = len(own) - need + 1
                ahead = np.concatenate((own[~late], own[late]))[: most + 1].view(np.int64).tolist()
                for k in range(min(most, len(own))):
                    yield pid, ahead[k], ahead[k + 1 :] + ahead[k : k + (need < 2)]

        for batch in batches:
            yield from in_chunks(rows(batch), schema)

    placed = stage(crowded.mapInArrow(prefixes, "pid long, v long, later array<long>"), "prefixes")
    hot = stage(placed.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("v", F.lit(True).alias("hot")), "hot")
    second = F.transform("later", lambda w: F.xxhash64("v", w))
    return placed.join(hot, "v", "left").select("pid", F.explode(F.when(F.col("hot"), second).otherwise(F.array("v"))).alias("v"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.99, min_words: int = MIN_WORDS, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per copied paragraph that stands in a long enough run of them: id, start, end (code points), n_words, class_id, first_id, removed.

    class_id names the class of copies, first_id is the document of its first occurrence (by id, then place), and removed is false
    for that occurrence only. Null and blank texts have no paragraphs. Rows with a null id are not looked at; of rows with equal id
    and text one is. Texts without copies give no row. Other columns are not read. Very long texts are cut and compared whole.
    """
    bands, rows = tuned(similarity, recall)
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    value_schema = pa.schema([("v", pa.int64())])

    def together(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        """Rows, their text last, in groups of some TOGETHER characters."""
        held, many = [], 0
        for row in rows:
            held.append(row)
            many += len(row[-1])
            if many >= TOGETHER:
                yield held
                held, many = [], 0
        if held:
            yield held

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Paragraphs(bands, rows)
        for batch in batches:
            for texts in together(rows_of(batch)):
                if (found := cutter.of_several([t for (t,) in texts], named=False)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(found[7].ravel().view(np.int64))], schema=value_schema)

    counted = named.select("text").mapInArrow(values, "v long").groupBy("v").agg(F.count("*").alias("n"))
    with passing():
        sent = spark.sparkContext.broadcast(bitmap(stage(counted.filter("n > 1").select("v"), "values"), bits))
    schema = pa.schema([("id", pa.int64()), ("ord", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int32()), ("pid", pa.int64()), ("bands", pa.list_(pa.int64())), ("shingles", pa.binary())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, repeated = Paragraphs(bands, rows), sent.value

        def batch_of(group: list[tuple[int, str]]) -> pa.RecordBatch | None:
            """The texts' paragraphs that the bitmap lets through."""
            if (found := cutter.of_several([t for _, t in group])) is None:
                return None
            data, text, first, last, ids, shingles, start, v = found
            k = np.flatnonzero(within(v.ravel(), repeated).reshape(v.shape).any(axis=0))
            if not len(k):
                return None
            a, b = Paragraphs.offsets(data)
            size = np.diff(np.append(start, len(shingles)))[k]
            at = np.repeat(start[k] - np.cumsum(size) + size, size) + np.arange(size.sum())
            i, ords = np.array([i for i, _ in group])[text[k]], k - np.searchsorted(text, text[k])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * bands), pa.array(v[:, k].T.ravel().view(np.int64)))
            ends = np.concatenate(([0], np.cumsum(size * 8))).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(shingles[at].tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(ords.astype(np.int32)), pa.array(a[first[k]].astype(np.int64)), pa.array(b[last[k] - 1].astype(np.int64)), pa.array((last - first)[k].astype(np.int32)), pa.array(ids[k].view(np.int64)), listed, raw], schema=schema)

        for batch in batches:
            for group in together(rows_of(batch)):
                if (found := batch_of(group)) is not None:
                    yield found

    with passing() as keep:
        found = stage(named.mapInArrow(candidates, "id long, ord int, start long, end long, n_words int, pid long, bands array<long>, shingles binary"), "candidates")
        texts = stage(found.groupBy("pid").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.any_value("bands").alias("bands"), F.any_value("shingles").alias("shingles")), "paragraphs")
        keys = ["v", "x", "y"]
        banded = texts.select("pid", F.explode("bands").alias("v"))
        sizes = stage(banded.groupBy("v").agg(F.count("*").alias("_n")).filter("_n > 1"), "sizes")
        valued = stage(banded.join(sizes, "v").select("pid", "v", (F.col("_n") > block).alias("hot")), "valued")
        crowded = stage(texts.join(valued.filter("hot").select("pid").distinct(), "pid", "left_semi").select("pid", "shingles"), "crowded")
        keyed = valued.filter("not hot").select("pid", "v").unionByName(_prefixed(crowded, similarity, block))
        meet = blocked(keyed, ["v"], "pid", block).join(texts.select("pid", "shingles"), "pid")
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def alike(a: np.ndarray, b: np.ndarray) -> bool:
            if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                return False
            both = len(np.intersect1d(a, b, assume_unique=True))
            return both >= similarity * (len(a) + len(b) - both)

        def verified(group: list[tuple]) -> Iterator[tuple[int, int]]:
            left = [(g[3], np.unique(np.frombuffer(g[4], np.uint64))) for g in group]
            while left:
                ahead = [left.pop()]
                while ahead and left:
                    at, own = ahead.pop()
                    rest = []
                    for other in left:
                        if alike(own, other[1]):
                            ahead.append(other)
                            yield at, other[0]
                        else:
                            rest.append(other)
                    left = rest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def edges():
                every = (row for batch in batches for row in rows_of(batch))
                for _, group in itertools.groupby(every, key=lambda r: r[:3]):
                    yield from verified(list(group))

            yield from in_chunks(edges(), out)

        met = meet.select(*keys, "pid", "shingles").repartition(*keys).sortWithinPartitions(*keys, "pid")
        near = connected_components(met.mapInArrow(run, "a long, b long"))
        classed = texts.join(near, texts.pid == near.node, "left").select("pid", "n", F.coalesce("root", "pid").alias("class_id"))
        classed = stage(classed, "classed")
        # what is joined to hot classes is stored first, so that Spark can split their rows
        copies = stage(classed.groupBy("class_id").agg(F.sum("n").alias("n")).filter("n > 1").select("class_id"), "repeated")
        of = stage(classed.join(copies, "class_id", "left_semi").select("pid", "class_id"), "classes")
        marked = keep(stage(stage(found.drop("bands", "shingles").dropDuplicates(["id", "ord", "pid", "start"]), "places").join(of, "pid"), "copies"))
        firsts = marked.groupBy("class_id").agg(F.min(F.struct("id", "ord", "start")).alias("f"), F.count("*").alias("m")).filter("m > 1")
        firsts = keep(stage(firsts, "firsts"))
    by_place = Window.partitionBy("id").orderBy("ord", "start")
    runs = marked.join(firsts, "class_id").withColumn("gap", F.when(F.col("ord") - F.lag("ord").over(by_place) == 1, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("gap").over(by_place)).withColumn("run_words", F.sum(F.when(F.col("n_words") >= SHINGLE, F.col("n_words")).otherwise(0)).over(Window.partitionBy("id", "run")))
    removed = (F.col("id") != F.col("f.id")) | (F.col("ord") != F.col("f.ord")) | (F.col("start") != F.col("f.start"))
    return runs.filter(F.col("run_words") >= min_words).select("id", "start", "end", "n_words", "class_id", F.col("f.id").alias("first_id"), removed.alias("removed"))
