"""Rows of a text's words as keys, hashed many at once: only those that a bitmap of wanted keys lets through are made into strings.

A text has several rows of words for each word, far more than the text itself is long; a value stands in few. The bitmap has 16 to 32 bits
a key, 32 MB at most, so its use fades from some 16 M keys on: it then lets more through, and loses none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"[\p{L}\p{N}]+")
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Letters and digits that are hashed at once, unless one text has more.
GROUP = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The base's powers, and those of its inverse, below n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(max(n, GROUP), base, np.uint64)])
    return _POWERS


def _sums(text: str) -> np.ndarray:
    """Sums from which hashes() has that of any part of the text."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.r_[np.zeros(1, np.uint64), np.cumsum(x * _powers(len(x) + 1)[0][: len(x)])]


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each part of a text; equal parts have equal ones, wherever they stand."""
    h = (sums[end] - sums[start]) * _powers(len(sums))[1][start]
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(times)
    return h ^ (h >> np.uint64(33))


def hashes_of(keys: Sequence[str]) -> np.ndarray:
    """hashes() of whole keys."""
    ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
    return hashes(_sums("".join(keys)), np.r_[np.zeros(1, np.int64), ends][:-1], ends)


def bitmap(found: DataFrame, members: int) -> np.ndarray:
    """Words of 64 bits with two bits for each of the hashes found(h long)."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * members).bit_length()))
    slots = found.select(F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def within(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether the bitmap has both bits of each hash."""
    mask = np.uint64(64 * len(words) - 1)

    def hit(slot: np.ndarray) -> np.ndarray:
        return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)

    return (hit(h & mask) & hit((h >> np.uint64(32)) & mask)).astype(bool)


def _grouped(texts: Iterable[str | None]) -> Iterator[list[list[str] | None]]:
    """Words of texts in NFKC, so many texts at once that they have about GROUP letters and digits."""
    part: list[list[str] | None] = []
    size = 0
    for t in texts:
        part.append(None if t is None else WORD.findall(t if t.isascii() else unicodedata.normalize("NFKC", t)))
        size += len(t or "")
        if size >= GROUP:
            yield part
            part, size = [], 0
    if part:
        yield part


class Wanted:
    """Keys of these sizes: `whole` ones are whole words in a row, `longer` ones begin with a word and may end inside of one."""

    def __init__(self, whole: Iterable[int], longer: Iterable[int], words: np.ndarray):
        whole = set(whole)
        self.most, self.longer, self.words = max(whole, default=0), sorted(longer), words
        self.fits = np.isin(np.arange(self.most + 1), list(whole))

    def keys(self, texts: Iterable[str | None]) -> list[list[str] | None]:
        """For each text its rows of words that the bitmap lets through, each once; None for None."""
        return [own for part in _grouped(texts) for own in self._keys(part)]

    def _keys(self, part: list[list[str] | None]) -> list[list[str] | None]:
        bare = "".join(w for own in part for w in own or ())
        counts = np.array([len(own or ()) for own in part])
        ends = np.cumsum(np.array([len(w) for own in part for w in own or ()], np.int64))
        starts = np.r_[np.zeros(1, np.int64), ends][:-1]
        number, last = np.repeat(np.arange(len(part)), counts), np.repeat(np.cumsum(counts), counts)  # of a word: its text, and the first word beyond it
        sums = _sums(bare)
        found: list[set[str]] = [set() for _ in part]

        def add(k: np.ndarray, end: np.ndarray) -> None:
            hit = within(hashes(sums, starts[k], end), self.words)
            for n, a, b in zip(number[k[hit]].tolist(), starts[k[hit]].tolist(), end[hit].tolist(), strict=True):
                found[n].add(bare[a:b])

        k, more = np.arange(len(starts)), 0
        while len(k):  # rows of 1, 2, 3... words
            size = ends[k + more] - starts[k]
            k, size = k[size <= self.most], size[size <= self.most]
            add(k[self.fits[size]], ends[k[self.fits[size]] + more])
            more += 1
            k = k[k + more < last[k]]
        for n in self.longer:
            k = np.flatnonzero(starts + n <= ends[last - 1]) if len(starts) else np.arange(0)
            add(k, starts[k] + n)
        return [None if own is None else list(found[n]) for n, own in enumerate(part)]
