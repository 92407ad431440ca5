"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits, runs of other visible characters, and marks for where a line starts, repeats an earlier one
or where the text ends. Single words, pairs and the pairs and triples of their shapes (how they are written, and whether they repeat the
word before) are hashed into SIZE weights; a text is the sparse vector of their shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_chunks, passing, rows_of, stage

SIZE = 1 << 18
#: Labelled rows that the model is fitted on at most, those of least hash of their id; passes over them.
MOST_ROWS, PASSES = 8000, 4
#: Values of all those rows' vectors at most, 8 bytes each: rows beyond are not fitted on. Whole texts have up to SIZE values each.
MOST_VALUES = 1 << 25
#: Follow-the-regularised-leader: step size, smoothing, and the weights of the two penalties.
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.002, 0.01
#: Inputs are shares of a text's n-grams times this.
SCALE = 8.0
_MEMO = 500_000
_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_MARKS = ("\n", "\n\n", "\0")
_ODD, _ODDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _shape(word: str) -> str:
    if word in _MARKS:
        return word
    if word.isdigit():
        return "9"
    if not word[0].isalnum():
        return word[:3]
    if any(c.isdigit() for c in word):
        return "a9"
    return "x" if word.islower() else "X" if word.isupper() and len(word) > 1 else "Xx" if word[1:].islower() or len(word) == 1 else "xX"


class _Words(dict):
    """Hash of a word and of its shape, kept for words seen."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = out = (xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 1), xxhash.xxh64_intdigest(_shape(word).encode("utf-8", "replace"), 2))
        return out


def features(text: str | None, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Indices (ascending, distinct) and shares of the whole text's n-grams; an empty text has the marks of its ends only."""
    words: list[str] = []
    seen: set[int] = set()
    for line in (text or "").split("\n"):
        key = hash(line)
        words.append("\n\n" if line.strip() and key in seen else "\n")
        seen.add(key)
        words += _WORD.findall(line)
    words.append("\0")
    both = np.array([memo[w] for w in words], np.uint64)
    raw, shape = both[:, 0], both[:, 1].copy()
    again = np.flatnonzero(raw[1:] == raw[:-1]) + 1
    shape[again] ^= _ODDER
    pairs = raw[:-1] * _ODD ^ raw[1:]
    shape_pairs = shape[:-1] * _ODD ^ shape[1:]
    shape_triples = shape_pairs[:-1] * _ODD ^ shape[2:] if len(shape) > 2 else shape[:0]
    index = np.concatenate((raw, pairs, shape, shape_pairs, shape_triples))
    index = (index * _ODDER) >> np.uint64(64 - 18)
    at, count = np.unique(index.astype(np.int32), return_counts=True)
    return at, (count * (SCALE / len(words))).astype(np.float32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights, the last one for the constant input; rows are (label, indices, values)."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for p in range(PASSES):
        for k in np.random.default_rng(p).permutation(len(rows)):
            y, at, x = rows[k]
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = _weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return _weights(z, n).astype(np.float32)


def held_out(id_col: str, folds: int, fold: int):
    """Whether the crc32 of the id as text leaves this remainder; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train) -> np.ndarray:
    """Weights fitted on at most MOST_ROWS labelled rows of at most MOST_VALUES values in all, taken in the order of a hash of their ids.

    Rows without label are left out; of rows of one id that with the least text hash counts.
    """
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & train).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(MOST_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("y", pa.float64()), ("at", pa.binary()), ("x", pa.binary())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()

        def each(batch):
            for i, y, t in rows_of(batch):
                at, x = features(t, memo)
                yield i, float(y), at.tobytes(), x.tobytes()

        for batch in batches:
            yield from in_chunks(each(batch), schema, 512)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(y, np.frombuffer(at, np.int32), np.frombuffer(x, np.float32)) for batch in batches for _, y, at, x in rows_of(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(held).tobytes()], pa.binary())], names=["w"])

    with passing():
        held = stage(rows.mapInArrow(vectors, "id long, y double, at binary, x binary"), "vectors")
        sizes = held.select("id", (F.length("at") / 4).cast("long").alias("n"))  # at most MOST_ROWS
        upto = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))).filter(F.col("upto") <= MOST_VALUES)
        bounded = held.join(upto.select("id"), "id").repartition(1).sortWithinPartitions("id")
        learned = bounded.mapInArrow(learn, "w binary").first()
    return np.frombuffer(learned[0], np.float32) if learned else fit([])


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only labels of ids that are not held out are learned from. Null texts are scored as empty ones. Without any usable label every
    score is 0.5. Very long texts are scored whole. Repeated rows stay repeated; empty tables stay empty; other columns are not read.
    """
    weights = trained(docs, labels, id_col, text_col, label_col, ~held_out(id_col, folds, fold))
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, memo = sent.value, _Words()
        for batch in batches:
            scores = []
            for value in batch.column(2):
                at, x = features(value.as_py(), memo)
                scores.append(float(1 / (1 + np.exp(-np.clip(float(w[at] @ x) + float(w[-1]), -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["id", "held_out", "score"])

    named = docs.select(F.col(id_col).alias("id"), held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(run, f"id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
