"""Byte-level BPE encoding and decoding of whole texts.

The pre-tokens that a group of texts needs are laid end to end as one linked list of symbols, in which no pair reaches over a
pre-token's end. Each pair of neighbours that the vocabulary can merge waits in the bucket of its rank, as its place in the list; a
bitmap of two levels (256 ranks to a lower word) says which buckets hold anything, and the lowest set bit of each level leads to the
lowest rank. What waits for a pair that is no longer there is skipped when its bucket comes up. The places of a bucket are merged
together, so a pre-token of a million equal letters takes a few steps, and so do a million short ones.

Pre-tokens never reach over the end of a word, so the ids of each piece (white space and the word after it) are kept for pieces
seen before; beyond PIECES only those of the texts at hand stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a worker keeps, and the longest it keeps.
PIECES, LONGEST = 200_000, 64
#: Code points of the texts that are encoded together, and bytes of the pre-tokens that are merged together.
CHARS, BYTES = 1 << 23, 1 << 21
#: White_Space characters as the `regex` module and the vocabulary's pattern have them: str.isspace() but for U+001C..U+001F.
_PIECE = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+")
_WORD_END = re.compile("[\\S\x1c-\x1f](?=[^\\S\x1c-\x1f])")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Places by rank; the lowest rank first."""

    def __init__(self, ranks: int):
        #: bit t of `high` says that low[t] has bits, bit x of low[t] that rank 256 t + x waits
        self.high, self.low = 0, [0] * ((ranks >> 8) + 1)
        self.waiting: dict[int, list[np.ndarray]] = {}

    def push(self, places: np.ndarray, ranks: np.ndarray) -> None:
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist(), strict=False):
            bucket = self.waiting.get(rank)
            if bucket is None:
                self.waiting[rank] = [places[a:b]]
                self.low[rank >> 8] |= 1 << (rank & 255)
                self.high |= 1 << (rank >> 8)
            else:
                bucket.append(places[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and its places, ascending and distinct."""
        t = (self.high & -self.high).bit_length() - 1
        bits = self.low[t]
        rank = t << 8 | (bits & -bits).bit_length() - 1
        self.low[t] = bits = bits & (bits - 1)
        if not bits:
            self.high &= self.high - 1
        bucket = self.waiting.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


class Codec:
    """Encodes and decodes with the ranks of one vocabulary. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: what two neighbours make: left * (size + 1) + right, ascending, and the rank; id `size` stands beyond a pre-token's ends
        pairs = sorted((ranks[t[:k]] * (self.size + 1) + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.keys = np.array([*(k for k, _ in pairs), 1 << 62], np.int64)
        self.made = np.array([*(r for _, r in pairs), -1], np.int32)
        left, right = self.keys[:-1] // (self.size + 1), self.keys[:-1] % (self.size + 1)
        #: tokens that can be half of a token of lower rank
        self.early = np.zeros(self.size, bool)
        for half in (left, right):
            self.early[half[self.made[:-1] < half]] = True
        self.first = self._rank(self.bytes.astype(np.int64).repeat(256), np.tile(self.bytes, 256)).reshape(256, 256)
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each left and right id make together, or -1."""
        key = left * np.int64(self.size + 1) + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.made[at], np.int32(-1))

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian 32-bit integers."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return [b""] * len(words)
        ends = np.cumsum([len(w) for w in words])
        last = ends[ends > 0] - 1
        # place n stands for what is beyond a pre-token's ends
        ids = np.append(self.bytes[raw], np.int32(self.size))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[last], before[np.minimum(last + 1, n)], before[0] = n, n, n
        rank_at = np.full(n + 1, -1, np.int32)  # what the pair that starts here waits for
        rank_at[: n - 1] = self.first[raw[:-1], raw[1:]]
        rank_at[last] = -1
        queue = RankQueue(self.size)
        places = np.flatnonzero(rank_at >= 0).astype(np.int32)
        queue.push(places, rank_at[places])
        while queue.high:
            rank, at = queue.pop()
            at = at[rank_at[at] == rank]  # the others are stale
            if len(at) > 1:
                at = self._apart(queue, rank, at, ids, after, before, ends)
            elif not len(at):
                continue
            gone = after[at]
            to = after[gone]
            ids[at], ids[gone] = rank, -1
            rank_at[gone] = -1
            after[at], before[to] = to, at
            left = before[at]
            places = np.concatenate((at, left))
            near = np.full(len(at), rank, np.int64)
            ranks = self._rank(np.concatenate((near, ids[left])), np.concatenate((ids[to], near)))
            rank_at[places] = ranks
            new = ranks >= 0
            queue.push(places[new], ranks[new])
        alive = ids[:-1] >= 0
        cuts = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))] * 4
        packed, cuts = ids[:-1][alive].astype("<u4").tobytes(), cuts.tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _apart(self, queue: RankQueue, rank: int, at: np.ndarray, ids: np.ndarray, after: np.ndarray, before: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of pairs of one rank, ascending, those that can be merged together as if one by one from the left."""
        touch, chosen = after[at[:-1]] == at[1:], at
        if touch.any():  # of pairs that share a symbol every other one: the merge of the first leaves the second stale
            place = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~touch)), place, 0))
            chosen = at[(place - begin) % 2 == 0]
        if self.early[rank] and len(chosen) > 1:
            # where a merge makes a pair of lower rank, that comes before the pre-token's later pairs, which go on waiting
            to, left, near = after[after[chosen]], ids[before[chosen]], np.full(len(chosen), rank, np.int64)
            left[1:][to[:-1] == chosen[1:]] = rank
            new = np.stack((self._rank(left, near), self._rank(near, ids[to])))
            lower = ((new >= 0) & (new < rank)).any(axis=0)
            if lower.any():
                word = np.searchsorted(ends, chosen, side="right")
                earlier = np.cumsum(lower) - lower
                start = np.maximum.accumulate(np.where(np.concatenate(([True], word[1:] != word[:-1])), np.arange(len(word)), 0))
                chosen = chosen[earlier == earlier[start]]
                of, index = np.unique(np.searchsorted(ends, chosen[::-1], side="right"), return_index=True)
                ended = np.zeros(len(ends), at.dtype)
                ended[of] = chosen[::-1][index]
                later = at[at > ended[np.searchsorted(ends, at, side="right")]]
                queue.push(later, np.full(len(later), rank))
        return chosen

    def _pieces(self, pieces: list[str]) -> None:
        """Learns the ids of pieces: white space and the word after it."""
        words = [self.split.findall(p) for p in pieces]
        every = list({w for of in words for w in of} - self.known.keys())
        raw = [w.encode("utf-8", "replace") for w in every]
        asked = [(w, r) for w, r in zip(every, raw, strict=True) if r not in self.ranks]
        found = {w: self.ranks[r].to_bytes(4, "little") for w, r in zip(every, raw, strict=True) if r in self.ranks}
        while asked:
            many = int(np.searchsorted(np.cumsum([len(r) for _, r in asked]), BYTES)) + 1
            found.update(zip((w for w, _ in asked[:many]), self.merged([r for _, r in asked[:many]]), strict=True))
            asked = asked[many:]
        known = self.known
        for piece, of in zip(pieces, words, strict=True):
            known[piece] = found[piece] if len(of) == 1 and piece in found else b"".join([found[w] if w in found else known[w] for w in of])

    def _together(self, texts: list[str]) -> list[bytes]:
        known = self.known
        need = set().union(*map(_PIECE.findall, texts))
        if len(known) + len(need) > PIECES:
            self.known = known = {p: ids for p, ids in known.items() if p in need}
        self._pieces([p for p in need if p not in known])
        out = [b"".join([known[p] for p in _PIECE.findall(t)]) for t in texts]
        for piece in need:
            if len(piece) > LONGEST:
                del known[piece]
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each whole text, as little-endian 32-bit integers; none for null."""
        held, many = [], 0
        for text in texts:
            if len(text or "") > CHARS:
                yield from self._together(held)
                held, many = [], 0
                yield b"".join(self._together([part])[0] for part in _parts(text))
                continue
            if many + len(text or "") > CHARS:
                yield from self._together(held)
                held, many = [], 0
            held.append(text or "")
            many += len(held[-1])
        yield from self._together(held)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids given as little-endian 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about CHARS code points that end with a word."""
    at = 0
    while at < len(text):
        found = _WORD_END.search(text, at + CHARS)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


_CODECS: dict[tuple[str, str], Codec] = {}


def vocabulary(docs: DataFrame, path: str) -> str:
    """Makes the file known to every executor; its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def codec(name: str, pattern: str) -> Codec:
    """The worker's codec of a vocabulary that vocabulary() made known."""
    if (name, pattern) not in _CODECS:
        _CODECS[name, pattern] = Codec(read_ranks(SparkFiles.get(name)), pattern)
    return _CODECS[name, pattern]


def encoded(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, round_trip; with_ids adds ids (binary, 32-bit little-endian).

    Null and empty texts have no tokens, and the digests of nothing. decoded_sha256 is of the bytes that the ids decode to.
    Very long texts are encoded whole, however long their pre-tokens. Repeated rows stay repeated, empty tables stay empty, other columns
    are not read.
    """
    name = vocabulary(docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, pattern)
        for batch in batches:
            counts, hashes, decoded, equal, payload = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for text, ids in zip(texts, own.encode_all(texts), strict=True):
                back = own.decode(ids)
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                equal.append(back == (text or "").encode("utf-8", "replace"))
                if with_ids:
                    payload.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), pa.array(equal, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(payload, pa.binary())] if with_ids else columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids"][: len(columns) + with_ids])

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids binary" * with_ids)
