"""Language identification with hyperdimensional profiles.

Each letter, of whatever alphabet, has a random vector of +1 and -1, drawn by its code point; a trigram's vector binds (multiplies) those
of its letters, rotated by their place; a text's vector bundles (adds) those of its trigrams, and a language's prototype bundles all
texts that are known to be in it. The language whose prototype has the greatest cosine to the text's vector is predicted. Prototypes are
sums of whole numbers, taken in each task and then in a shuffle: DIMENSIONS values a language come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_model import held_out

DIMENSIONS, SEED = 1024, 20240229
#: Bits of a code point in a trigram's code; texts that are judged together; trigrams whose vectors are made together.
_BITS, _BATCH, _TOGETHER = 21, 128, 8192
_MASK = (1 << _BITS) - 1
_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Of each code point its small letter, and 0 of what is no letter; made once in a process."""
    if not _FOLDED:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                small = x.lower()
                table[c] = ord(small) if len(small) == 1 else c
        _FOLDED.append(table)
    return _FOLDED[0]


class Trigrams:
    """Trigram codes (63 bits) of texts and their vectors."""

    def __init__(self) -> None:
        self.table = _folded()
        self.row = np.full(0x110000, -1, np.int32)
        self.letters = np.empty((0, DIMENSIONS), np.int8)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of the text's letters, words set apart, and how often each occurs; empty if it has no letter."""
        s = self.table[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
        s = np.concatenate(([0], s, [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        codes = (s[:-2] << 2 * _BITS) | (s[1:-1] << _BITS) | s[2:]
        return np.unique(codes[s[1:-1] != 0], return_counts=True)

    def _letters(self, points: np.ndarray) -> np.ndarray:
        new = np.unique(points[self.row[points] < 0])
        if len(new):
            self.row[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            drawn = [np.random.default_rng((SEED, int(c))).choice(np.array([-1, 1], np.int8), DIMENSIONS) for c in new]
            self.letters = np.concatenate((self.letters, np.array(drawn)))
        return self.letters[self.row[points]]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        first, second, third = (self._letters((codes >> shift) & _MASK) for shift in (2 * _BITS, _BITS, 0))
        return np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third

    def bundle(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each n times; whole numbers."""
        total = np.zeros(DIMENSIONS)
        for k in range(0, len(codes), _TOGETHER):
            total += n[k : k + _TOGETHER].astype(float) @ self.vectors(codes[k : k + _TOGETHER]).astype(float)
        return total.astype(np.int64)


def profiles(docs: DataFrame, text_col: str, lang_col: str, train) -> tuple[list[str], np.ndarray]:
    """Learned languages in order, and their prototypes as unit vectors, from all rows with a language where `train` holds."""
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums, held, size = Trigrams(), {}, {}, 0

        def add(lang: str) -> None:
            """Bundles what is held of a language's trigrams."""
            pairs = held.pop(lang)
            codes, where = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([n for _, n in pairs]))
            sums[lang] = sums.get(lang, 0) + grams.bundle(codes, n)

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = grams.counts(value.as_py())
                if len(found[0]):
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
                    if size > 1 << 20:
                        for own in list(held):
                            add(own)
                        size = 0
        for lang in list(held):
            add(lang)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)], schema=schema)

    found = docs.filter(F.col(lang_col).isNotNull() & train).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, k int, v long")
    sums: dict[str, np.ndarray] = {}
    for lang, k, v in found.groupBy("lang", "k").agg(F.sum("v").alias("v")).toLocalIterator():
        sums.setdefault(lang, np.zeros(DIMENSIONS))[k] = v
    langs = sorted(sums)
    return langs, np.array([sums[x] / max(np.linalg.norm(sums[x]), 1e-12) for x in langs], np.float32).reshape(len(langs), DIMENSIONS)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (the cosine, not below 0).

    Null texts and those without a letter, and all texts if no language could be learned, are `und` with score 0. Ties go to the
    first language by name. Very long texts are read whole. Repeated rows stay repeated; empty tables stay empty; other columns are
    not read.
    """
    langs, prototypes = profiles(docs, text_col, lang_col, ~held_out(id_col, folds, fold))
    sent = docs.sparkSession.sparkContext.broadcast((langs, prototypes.T.copy()))  # 4 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, (names, proto) = Trigrams(), sent.value

        def judge(texts: list) -> Iterator[tuple[str, float]]:
            found = [grams.counts(t) for t in texts]
            every = np.unique(np.concatenate([c for c, _ in found]))
            bundles = np.zeros((len(texts), DIMENSIONS), np.float32)
            for k in range(0, len(every), _TOGETHER):
                part = every[k : k + _TOGETHER]
                counts = np.zeros((len(texts), len(part)), np.float32)
                for row, (codes, n) in zip(counts, found, strict=True):
                    a, b = np.searchsorted(codes, (part[0], part[-1] + 1))
                    row[np.searchsorted(part, codes[a:b])] = n[a:b]
                bundles += counts @ grams.vectors(part).astype(np.float32)
            norms = np.linalg.norm(bundles, axis=1)
            cosines = bundles @ proto / np.maximum(norms, 1e-9)[:, None] if names else np.zeros((len(texts), 1))
            for row, (codes, _) in zip(cosines, found, strict=True):
                best = int(row.argmax())
                yield (names[best], min(1.0, max(0.0, float(row[best])))) if names and len(codes) else ("und", 0.0)

        for batch in batches:
            out: list[tuple[str, float]] = []
            for k in range(0, batch.num_rows, _BATCH):
                out += judge(batch.column(2).slice(k, _BATCH).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    named = docs.select(F.col(id_col).alias("id"), held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
