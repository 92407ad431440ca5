"""Importance resampling towards a target: documents whose hashed n-grams are frequent in target texts are drawn more often.

Words are told apart as integers. Each task keeps a dictionary of distinct words; a run of words is a tuple of their numbers, kept as the
number of the run without its last word and that word's number, so that distinct tuples are told apart by one 64-bit key. Only a tuple
seen for the first time has its bytes put together and hashed; all its occurrences take the bucket from a table. Texts are read twice:
once for the buckets' counts, of which a row for each bucket and task is shuffled, and once for the weights. The draw is Gumbel top-k:
each document's score is its weight and a noise that depends on its id alone, and the highest scores are drawn, ranked by a
range-partitioned sort of ids and scores, so that no task holds them all.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, in_chunks, passing, rows_of, stage

#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Distinct words and tuples that a task's dictionary holds; a full one is begun anew.
MOST_TUPLES = 400_000

# what is no letter a-z, digit or byte of a longer character separates words; A-Z are lower-cased
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, piece by piece."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_TABLE)
        if at + PIECE < len(text):
            cut = piece.rfind(b" ") + 1
            if not cut:  # one word, longer than a piece
                rest = text[at:].translate(_TABLE)
                cut = rest.find(b" ") + 1 or len(rest)
                piece = rest
            piece = piece[:cut]
        at += len(piece)
        yield piece.split()


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key: object) -> int:
        self[key] = n = len(self)
        return n


class Dictionary:
    """Words and tuples of up to `longest` words as integers, each with the bucket of its bytes."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.clear()

    def clear(self) -> None:
        self.words = _Numbers()
        self.spelt: list[bytes] = []  # by word number
        self.word_bucket = array("i")
        # of runs of two words, three words ...: numbers by key, and words and bucket by number
        self.runs: list[dict[int, int]] = [{} for _ in range(2, self.longest + 1)]
        self.run_words: list[list[tuple[int, ...]]] = [[] for _ in self.runs]
        self.run_bucket = [array("i") for _ in self.runs]

    def __len__(self) -> int:
        return len(self.words) + sum(map(len, self.runs))

    def _hashed(self, spelt: list[bytes]) -> list[int]:
        return [zlib.crc32(s) % self.buckets for s in spelt]

    def buckets_of(self, words: list[bytes], carried: int = 0) -> Iterator[np.ndarray]:
        """The bucket of each run of 1 to `longest` words that ends after the first `carried` words."""
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if len(self.words) > len(self.spelt):
            fresh = list(islice(reversed(self.words), len(self.words) - len(self.spelt)))[::-1]
            self.spelt += fresh
            self.word_bucket.extend(self._hashed(fresh))
        yield np.frombuffer(self.word_bucket, np.int32)[ids[carried:]] if words else np.zeros(0, np.int32)
        before = ids
        for k, known in enumerate(self.runs):
            if len(ids) < k + 2:
                return
            keys = (before[:-1] << 32) | ids[k + 1 :]
            distinct, place = np.unique(keys, return_inverse=True)
            spelt = []
            for x in distinct.tolist():
                if x not in known:
                    head = (x >> 32,) if k == 0 else self.run_words[k - 1][x >> 32]
                    known[x] = len(known)
                    self.run_words[k].append(run := (*head, x & 0xFFFFFFFF))
                    spelt.append(b" ".join(self.spelt[w] for w in run))
            self.run_bucket[k].extend(self._hashed(spelt))
            before = np.array([known[x] for x in distinct.tolist()], np.int64)[place]
            yield np.frombuffer(self.run_bucket[k], np.int32)[before[max(0, carried - k - 1) :]]


def _features(text: bytes | None, d: Dictionary) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, in parts."""
    tail: list[bytes] = []
    for words in words_of(text or b""):
        if len(d) > MOST_TUPLES:
            d.clear()
        yield from d.buckets_of(tail + words, len(tail))
        tail = (tail + words)[max(0, len(tail) + len(words) - d.longest + 1) :] if d.longest > 1 else []


def _counting(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n, held, many = Dictionary(longest, buckets), np.zeros(buckets, np.int64), [], 0
        for b in batches:
            for (text,) in rows_of(b):
                for part in _features(text, d):
                    held.append(part)
                    many += len(part)
                    if many > PIECE:
                        n += np.bincount(np.concatenate(held), minlength=buckets)
                        held, many = [], 0
        if held:
            n += np.bincount(np.concatenate(held), minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts each bucket has: as many numbers as there are buckets, whatever the texts' number."""
    parts = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_counting(longest, buckets), "bucket int, n long")
    out = np.zeros(buckets, object)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target than in the source, both with one more in every bucket."""
    size, s_all, t_all = len(source), int(sum(source)), int(sum(target))
    ratio = (float(t + 1) * float(s_all + size) / (float(s + 1) * float(t_all + size)) for s, t in zip(source, target, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weighing(longest: int, gain: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Dictionary(longest, len(gain))

        def rows() -> Iterator[tuple]:
            for b in batches:
                for key, text in rows_of(b):
                    n, total = 0, 0
                    for part in _features(text, d):
                        n, total = n + len(part), total + int(gain[part].sum())
                    n_words = n if longest == 1 else sum(map(len, words_of(text or b"")))
                    yield key, n_words, n, total // n if n else 0

        yield from in_chunks(rows(), schema)

    return run


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null if not drawn).

    Features are runs of 1 to `longest` words. Null and empty texts have none and weigh 0; texts are read whole, however long. A null id
    makes noise as an empty one does. Of the N documents of `least_words` words or more, floor(percent * N / 100) are drawn: highest
    scores, then smaller ids (null first); repeated rows are drawn each for itself, and which of equal rows has which rank is all one.
    Empty tables draw nothing; an empty target makes all buckets alike but for their counts. Other columns are not read.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets, target_col))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    weighed = named.mapInArrow(_weighing(longest, gain), "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    with passing() as keep:
        rows = stage(weighed.select("id", "n_words", "n_features", "weight", score.cast("long").alias("score"), F.monotonically_increasing_id().alias("row")), "weights")
        enough = F.col("n_words") >= least_words
        drawn = rows.filter(enough).count() * percent // 100
        order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("n_features").asc(), F.col("row").asc()]  # the row splits what repeats
        lined = rows.filter(enough).repartitionByRange(*order).sortWithinPartitions(*order)
        lined = keep(stage(lined.select("id", "n_features", "weight", "score", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranks"))
        others = keep(stage(rows.filter(~enough).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")), "few-words"))
    before, starts = 0, []
    for r in lined.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect():  # a row for each partition of the sort
        starts.append((r["part"], before - r["first"] + 1))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "part int, shift long")
    place = F.col("at") + F.col("shift")
    ranked = lined.join(F.broadcast(offsets), "part").select("id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
    return ranked.unionByName(others)
