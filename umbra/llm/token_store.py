"""Token ids in binary shards, with constant-time access by document key.

A shard is a file of raw little-endian ids (16 bits where the vocabulary allows, else 32) of documents in ascending key order, and an
index file: a minimal perfect hash of the shard's keys gives a slot, which holds the key's fingerprint and its first document; document
offsets stand in an array. Keys are dealt to shards by range, so the key's shard is found by bisection over shard bounds; a key that
many documents have may go on in the next shards.

The hash has levels of bit arrays: a key whose position in a level is its own ends there, the others go on to the next level; the
slot is the number of bits set before the key's. Keys are 64-bit integers and are mixed by a bijection, so no two collide on all levels.

The tokenizer lower-cases, drops white space and never merges across it, so texts are cut at ASCII white space into pieces, and a
piece that occurs again is not encoded again. Pieces of small letters alone, which most are, need no normalizing and no further cuts: they go
to the tokenizer's model at once, if that gives the same ids for a sample of its vocabulary.

Tasks write under names of their own, and only files listed in the committed manifest are read, so lost and repeated tasks do no harm.
"""

from __future__ import annotations

import bisect
import io
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, in_chunks, rows_of, stage

#: Bits of a level for each key that is left, and levels before the rest is kept as it is.
GAMMA, LEVELS = 2, 48
#: Pieces of text whose ids a worker keeps, the longest it keeps, texts that are encoded together, and pieces in a call.
PIECES, LONGEST, TEXTS, CALL = 600_000, 64, 64, 512
#: Code points of a shard's texts, about: its keys and lengths are held while it is written, some 60 bytes a document. From MOST_SHARDS
#: shards on they grow with the corpus, so that the list of shards, which all lookup tasks get, has a bound: some 10 MB.
SHARD, MOST_SHARDS = 1 << 24, 1 << 16
_CLOSING = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Letters of lower case that normalization leaves alone, and how byte-level tokenizers write their bytes.
_SMALL = re.compile("[a-zß-öø-ÿ]+")
_SPELT = {c: "".join(chr(b) if b not in range(127, 161) and b != 173 else chr(256 + 33 + (b - 127 if b != 173 else 34)) for b in chr(c).encode()) for c in range(0xDF, 0x100)}
_SLOT, _MARK = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit integers for each salt."""
    z = x + np.uint64(_SLOT * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: slots 0 to n - 1."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, rest: np.ndarray):
        self.words, self.sizes, self.rest = words, sizes, rest
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words)))).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, words, sizes = keys.astype(np.uint64), [], []
        while len(left) and len(sizes) < LEVELS:
            size = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.concatenate(words) if words else np.empty(0, np.uint64), np.array(sizes, np.int64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; keys that were not among those hashed get any slot, or -1."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.before[at >> 6] + below)[here]
            left = left[~here]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            here = self.rest[at] == keys[left]
            out[left[here]] = self.before[-1] + at[here]
        return out


class ShardIndex:
    """Document offsets of a shard and the slots of its keys."""

    def __init__(self, data: bytes):
        held = np.load(io.BytesIO(data))
        self.hash = PerfectHash(held["words"], held["sizes"], held["rest"])
        self.marks, self.first, self.count, self.offsets, self.nulls = held["marks"], held["first"], held["count"], held["offsets"], int(held["nulls"])

    @staticmethod
    def build(keys: np.ndarray, nulls: int, lengths: np.ndarray) -> bytes:
        """Of ascending keys (repeats next to each other) of the documents after `nulls` without key, and the lengths of all."""
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        found = PerfectHash.of(distinct.view(np.uint64))
        slots = found.slots(distinct.view(np.uint64))
        by_slot = lambda x, kind: np.put(out := np.zeros(len(distinct), kind), slots, x) or out
        to = io.BytesIO()
        marks = (mixed(distinct.view(np.uint64) ^ _MARK, 0) >> np.uint64(32)).astype(np.uint32)
        np.savez(to, words=found.words, sizes=found.sizes, rest=found.rest, marks=by_slot(marks, np.uint32), first=by_slot(first + nulls, np.int64), count=by_slot(count, np.int32), offsets=np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), nulls=nulls)
        return to.getvalue()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; none where the stored fingerprint differs."""
        slots = self.hash.slots(keys.view(np.uint64))
        if not len(self.marks):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known = (slots >= 0) & (self.marks[slots] == (mixed(keys.view(np.uint64) ^ _MARK, 0) >> np.uint64(32)).astype(np.uint32))
        return np.where(known, self.first[slots], 0), np.where(known, self.count[slots], 0)


class Encoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each piece that is kept."""

    def __init__(self, path: str, end_id: int, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.known = Tokenizer.from_file(path), f"<u{width}", {}
        self.end = np.array([end_id], self.kind).tobytes()
        #: a special token of the vocabulary keeps pieces apart that are encoded in one call
        self.mark_id, self.mark = next(((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special), (None, ""))

        self.model, self.packed = self.tokenizer.model, [struct.Struct(f"<{n}{'H' if width == 2 else 'I'}").pack for n in range(2 * LONGEST + 2)]
        self.direct = True
        sample = [w for w in (k.removesuffix("</w>") for k in sorted(self.tokenizer.get_vocab())[::7]) if _SMALL.fullmatch(w)][:2000] + ["été", "größe", "ñandú", "æøåÿßþð"]
        self.direct = dict(self._modelled([w.encode() for w in sample])[0]) == dict(self._encoded([w.encode() for w in sample]))

    def _modelled(self, pieces: list[bytes]) -> tuple[list[tuple[bytes, bytes]], list[bytes]]:
        """Ids from the model of pieces that are small letters alone, and the other pieces."""
        if not self.direct:
            return [], pieces
        tokenize, packed, found, rest = self.model.tokenize, self.packed, [], []
        for p in pieces:
            if len(p) > LONGEST:
                rest.append(p)
                continue
            if p.isalpha():
                ids = [t.id for t in tokenize(p.decode())]
            elif not p.isascii():
                word = p.decode()
                if not _SMALL.fullmatch(word):
                    rest.append(p)
                    continue
                ids = [t.id for t in tokenize(word.translate(_SPELT))]
            else:
                rest.append(p)
                continue
            found.append((p, packed[len(ids)](*ids)))
        return found, rest

    def _encoded(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids from the whole tokenizer."""
        plain = [p for p in pieces if self.mark_id is not None and b"<" not in p]
        for k in range(0, len(plain), CALL):
            part = plain[k : k + CALL]
            line = self.mark.join([p.decode() for p in part])
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.kind)
            marks = np.flatnonzero(ids == self.mark_id)
            bounds = zip([0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)], strict=True)
            yield from ((p, ids[a:b].tobytes()) for p, (a, b) in zip(part, bounds, strict=True))
        rest = pieces if self.mark_id is None else [p for p in pieces if b"<" in p]
        found = self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False) if rest else []
        yield from ((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(rest, found, strict=True))

    def _learn(self, pieces: list[bytes]) -> None:
        found, rest = self._modelled(pieces)
        self.known.update(found)
        self.known.update(self._encoded(rest))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, its end included."""
        known = self.known
        cut = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
        every = set().union(*cut)
        new = every.difference(known)
        if len(known) + 2 * len(new) > PIECES:
            known.clear()
            new = every
        # punctuation after an ASCII letter or digit is a token run of its own
        pairs = [(p, s) for p in new if b"<" not in p and (s := p.rstrip(_CLOSING)) is not p and len(s) < len(p) and s[-1:].isalnum()]
        ends = {p for p, _ in pairs}
        asked = {p for p in new if p not in ends}.union([s for _, s in pairs], [p[len(s) :] for p, s in pairs]).difference(known)
        self._learn(list(asked))
        known.update((p, known[s] + known[p[len(s) :]]) for p, s in pairs)
        out = [b"".join(map(known.__getitem__, pieces)) + self.end for pieces in cut]
        for piece in [p for p in asked.union(new) if len(p) > LONGEST]:
            known.pop(piece, None)
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(name: str, end_id: int, width: int) -> Encoder:
    """The worker's encoder, kept from task to task. The library must not start threads of its own: Spark deals out the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (name, end_id, width) not in _ENCODERS:
        _ENCODERS[name, end_id, width] = Encoder(SparkFiles.get(name), end_id, width)
    return _ENCODERS[name, end_id, width]


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if re.match(r"\w+:", uri) else (pafs.LocalFileSystem(), uri)


@dataclass
class TokenStore:
    """Shards as their manifest lists them, in key order."""

    spark: SparkSession
    width: int
    shards: list  # of manifest rows; a row for each shard

    @property
    def starts(self) -> list[int]:
        """Ids in all shards before each."""
        return [0, *itertools.accumulate(r.n_ids for r in self.shards)][:-1]

    def lookup(self, keys: DataFrame, key_col: str) -> DataFrame:
        """One row per stored document of each distinct key: id, start (ids of all documents before), n_tokens, ids_crc32, ids.

        Keys that are not stored give no row; the null key gives the documents without key.
        """
        width, count = self.width, len(self.shards)
        kind = np.dtype(f"<u{width}")
        sent = self.spark.sparkContext.broadcast(([r.asDict() for r in self.shards], self.starts))  # at most MOST_SHARDS rows

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = sent.value[0]
            skip = sum(r["min_key"] is None for r in shards)
            least, most = ([r[k] for r in shards[skip:]] for k in ("min_key", "max_key"))
            without = [k for k, r in enumerate(shards) if r["n_nulls"]]
            for batch in batches:
                keys = batch.column(0).to_pylist()
                held = [without if k is None else range(bisect.bisect_left(most, k) + skip, bisect.bisect_right(least, k) + skip) for k in keys]
                pairs = [(k, s) for k, own in zip(keys, held, strict=True) for s in own]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([s for _, s in pairs], pa.int32())], names=["id", "shard"])

        schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

        def of_shard(at: int, keys: list) -> Iterator[tuple]:
            shards, starts = sent.value
            fs, path = _file_system(shards[at]["index"])
            with fs.open_input_stream(path) as f:
                index = ShardIndex(f.read())
            fs, path = _file_system(shards[at]["payload"])
            whole = np.array([k or 0 for k in keys], np.int64)
            first, count = index.find(whole)
            with fs.open_input_file(path) as f:
                for key, a, n in zip(keys, first.tolist(), count.tolist(), strict=True):
                    a, n = (0, index.nulls) if key is None else (a, n)
                    for d in range(a, a + n):
                        begin, end = int(index.offsets[d]), int(index.offsets[d + 1])
                        f.seek(begin * width)
                        ids = np.frombuffer(f.read((end - begin) * width), kind).astype("<u4").tobytes()
                        yield key, starts[at] + begin, end - begin, zlib.crc32(ids), ids

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = (row for batch in batches for row in rows_of(batch))
            found = (row for at, group in itertools.groupby(every, key=lambda r: r[1]) for part in _parts(group) for row in of_shard(at, [r[0] for r in part]))
            yield from in_chunks(found, schema, 256)

        routed = keys.select(F.col(key_col).cast("long").alias("id")).distinct().mapInArrow(route, "id long, shard int")
        # as many tasks as shards: the keys are few bytes, what they fetch is not
        dealt = routed.repartition(max(1, count), "shard", F.expr("id div 16384")).sortWithinPartitions("shard", "id")
        return dealt.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _parts(rows: Iterator, most: int = 65536) -> Iterator[list]:
    while part := list(itertools.islice(rows, most)):
        yield part


def write(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", vocabulary_size: int = 1 << 16, shards: int | None = None) -> TokenStore:
    """Encodes every text, appends end_id, and stores the ids in ascending key order; documents without key come first.

    Null and empty texts have the end id only; very long ones are encoded whole. Repeated keys keep all their documents, next to each other
    in order of a hash of their texts, and over several shards where they are many. An empty table gives no shard. Other columns are not read. The tokenizer must lower-case, drop white space and not merge across it (see above).
    """
    spark, width = docs.sparkSession, 2 if vocabulary_size <= 1 << 16 else 4
    spark.sparkContext.addFile(tokenizer_path)
    name, to = tokenizer_path.rsplit("/", 1)[-1], fresh_path(spark, "tokens")
    schema = "shard int, payload string, index string, n_docs long, n_ids long, n_nulls long, min_key long, max_key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = TaskContext.get().partitionId(), None
        keys, lengths, nulls = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if base is None:
                base = f"{to}/shard-{at:06d}-{uuid.uuid4().hex}"
                fs, path = _file_system(base)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = fs.open_output_stream(f"{path}.ids")
                encoder = _encoder(name, end_id, width)
            for part in _parts(rows_of(batch), TEXTS):
                for (key, _), ids in zip(part, encoder.encode([text for _, text in part]), strict=True):
                    sink.write(ids)
                    lengths.append(len(ids) // width)
                    nulls += key is None
                    if key is not None:
                        keys.append(key)
        if base is None:
            return
        sink.close()
        with fs.open_output_stream(f"{path}.index") as f:
            f.write(ShardIndex.build(np.array(keys, np.int64), nulls, np.array(lengths, np.int64)))
        row = [at, f"{base}.ids", f"{base}.index", len(lengths), sum(lengths), nulls, keys[0] if keys else None, keys[-1] if keys else None]
        kinds = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars = named.agg(F.sum(F.length("text"))).first()[0] or 0
    many = shards or 1 + chars // max(SHARD, chars // MOST_SHARDS)
    # a hash of the text splits a key that many documents have
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = named.repartitionByRange(many, *order).sortWithinPartitions(*order)
    manifest = stage(ordered.mapInArrow(run, schema), "manifest")
    return TokenStore(spark, width, manifest.orderBy("shard").collect())
