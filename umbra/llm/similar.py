"""Near-duplicate texts: SimHash links first, an exact prefix filter for the rest, every link checked by exact similarity.

Equal word sequences are one text. SimHash fingerprints over the set of a text's words give candidate links by the generalised
pigeonhole principle (see simhash); those whose shingle sets are as similar as asked join texts to groups. Similar texts that this leaves
in different groups are found by their prefixes: shingles have one order, those that a sample of the texts has often come last; of
two similar texts the first common shingle is among the first n - ceil(similarity * n) + 1 of either. Only shingles that stand in
prefixes of several groups are sent on.

Each text has sketches: bit j is the parity of its shingles that hash to j. Two texts of a and b shingles and the asked similarity s
differ in at most (a + b)(1 - s)/(1 + s) shingles, so in at most as many bits; what is beyond is no pair, and no pair is lost. A
sketch of 256 bits goes with each place of a prefix, one of at least 4 bits a shingle stays with the text and is looked at before
whole texts are. First some texts of a large bucket are checked against its others, again with other ones for as long as many groups join
by that (FEW at least), so that large groups of near copies join by pairs in proportion to their texts, not to the square of that. Then one
pair of any two groups that are left is checked; where that pair fails and others met, all others are checked in a last round.

Words and shingles are 64-bit hashes, and texts 128-bit ones of which the links carry 64, taken as equal when equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, within
from .common import drop_stage, forget_shuffles, in_chunks, passing, rows_of, stage
from .components import connected_components
from .decontaminate import _Hashes, run_hashes
from .simhash import block_pairs, links, majority_bits, signed, words_of

#: One text of so many is looked at for shingles that are often used.
SAMPLE = 32
#: 64-bit words of a sketch; rows of a bucket that is compared together with others.
SKETCH, SMALL = 4, 16
#: Texts of a bucket that are compared with all its others; stars are made again where one of so many groups that met joined another, and
#: at least FEW did: fewer leave fewer pairs to the turn after the stars than another turn of stars costs.
LEADERS, JOINING, FEW = 16, 8, 256
_SKETCHES = [f"s{k}" for k in range(SKETCH)]
#: What tells rows apart; the first row of a group is the least in this order, so null ids come last.
ROW = ["none", "id", "raw"]


class _Stripped(_Hashes):
    """Hash of a word without the punctuation around it, kept for words seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = super().__missing__(word.strip(b",.;:!?"))
        return h


def _shingles(words: list[bytes], size: int, memo: dict) -> np.ndarray:
    """Distinct hashes of each run of `size` words, ascending; fewer words are one shingle, none give none."""
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return np.unique(run_hashes(h, min(size, len(h)))) if words else h


def _sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    slot = (shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits.bit_length())
    return np.packbits(np.bincount(slot.astype(np.int64), minlength=bits) & 1, bitorder="little")


def _apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; of the longer one, neighbouring bits are added until they are of one length."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8), bitorder="little") for s in (a, b))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[::2] ^ x[1::2]
    return int((x ^ y).sum())


def _node(line: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(line)[:8], "big", signed=True)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(none, id, raw, text): raw is a hash of the text as it stands; a null text is an empty one, a null id is 0 and none is set."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    return docs.select(own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(text).alias("raw"), text.alias("text"))


def _printed(named: DataFrame, size: int, similarity: float) -> DataFrame:
    """(none, id, raw, node, fp, n, sketches, prefix) per row: node is the hash of the word sequence, n the number of shingles."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for (text,) in rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(words_of(text), size, memo).view(np.int64))], names=["v"])

    some = named.filter(F.pmod("raw", F.lit(SAMPLE)) == 0).select("text").distinct()
    with passing():
        frequent = stage(some.mapInArrow(sampled, "v long").groupBy("v").agg(F.count("*").alias("n")).filter("n > 2").select("v"), "frequent")
        often = named.sparkSession.sparkContext.broadcast(bitmap(frequent))
    names = [*ROW, "node", "fp", "n", *_SKETCHES, "whole", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, stripped, last = _Hashes(), _Stripped(), often.value
        for batch in batches:
            nodes, fps, counts, sketches, whole, prefixes = [], [], [], [], [], []
            for value in batch.column(3):
                words = words_of(value.as_py())
                nodes.append(_node(b" ".join(words)))
                fps.append(signed(majority_bits(np.unique(np.fromiter(map(stripped.__getitem__, words), np.uint64, len(words))))))
                own = _shingles(words, size, memo)
                late = within(own, last)
                most = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
                counts.append(len(own))
                sketches.append(_sketch(own, 64 * SKETCH).view(np.int64))
                whole.append(_sketch(own, max(64 * SKETCH, 4 << (max(len(own), 1) - 1).bit_length())).tobytes())
                prefixes.append(np.concatenate((own[~late], own[late]))[:most].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)))
            apart = np.array(sketches, np.int64).reshape(-1, SKETCH).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(counts, pa.int32()), *map(pa.array, apart), pa.array(whole, pa.binary()), listed], names=names)

    return named.mapInArrow(run, "none boolean, id long, raw long, node long, fp long, n int, " + ", ".join(f"{s} long" for s in _SKETCHES) + ", whole binary, prefix array<long>")


def _first(name: str, of: str = ""):
    """The first row of a group."""
    return F.min(F.struct(*(F.col(of + c).alias(c) for c in ROW))).alias(name)


def _sketched(wholes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sketches leave room for the similarity. Only sketches that a bitmap of the pairs' texts lets through are sent."""
    with passing():
        asked = stage(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "asked")
        sent = wholes.sparkSession.sparkContext.broadcast(bitmap(asked))

    def let(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(within(batch.column(0).to_numpy().view(np.uint64), sent.value)))

    held = wholes.mapInArrow(let, wholes.schema)
    side = lambda x: held.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("whole").alias(f"w{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("ga", "gb", "a", "b", "more", "na", "nb", "wa", "wb")
    out = pa.schema([(k, pa.int64()) for k in ("ga", "gb", "a", "b")] + [("more", pa.bool_()), ("fits", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_chunks(((*r[:5], _apart(r[7], r[8]) <= (r[5] + r[6]) * ((1 - similarity) / (1 + similarity)) + 1e-6) for r in rows_of(batch)), out)

    return both.mapInArrow(run, "ga long, gb long, a long, b long, more boolean, fits boolean")


def _checked(named: DataFrame, texts: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs(a, b) of texts, by node, that are as similar as asked. Only texts that a bitmap of the pairs' lets through are sent."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    with passing():
        keys = stage(texts.join(asked, "node").select(F.xxhash64(*(f"first.{c}" for c in ROW)).alias("v")), "asked")
        sent = named.sparkSession.sparkContext.broadcast(bitmap(keys))
    schema = pa.schema([("node", pa.int64()), ("line", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value

        def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
            texts = batch.column(1)
            for k in np.flatnonzero(within(batch.column(0).to_numpy().view(np.uint64), wanted)).tolist():
                line = b" ".join(words_of(texts[k].as_py()))
                yield _node(line), line

        for batch in batches:
            yield from in_chunks(rows(batch), schema, 256)

    lines = named.select(F.xxhash64(*ROW).alias("key"), "text").mapInArrow(cut, "node long, line binary")
    held = stage(lines.dropDuplicates(["node"]), "lines")
    side = lambda x: held.select(F.col("node").alias(x), F.col("line").alias(f"l{x}"))
    sides = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "la", "lb")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = _Hashes()

        def alike(line_a: bytes, line_b: bytes) -> bool:
            a, b = (_shingles(line.split(), size, memo) for line in (line_a, line_b))
            if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                return False
            both = len(np.intersect1d(a, b, assume_unique=True))
            return both >= similarity * (len(a) + len(b) - both)

        for batch in batches:
            yield from in_chunks(((a, b) for a, b, la, lb in rows_of(batch) if alike(la, lb)), out)

    found = stage(sides.mapInArrow(compare, "a long, b long"), "similar")
    drop_stage(held)
    forget_shuffles(named.sparkSession)
    return found


def _dealt(rows: DataFrame, similarity: float, block: int) -> DataFrame:
    """Adds band, guest and cut to rows(h, place, n, node, group, sketch), the places of prefixes: the bucket of a row and the number of its blocks.

    A shingle in over `block` prefixes is split by size: texts are as similar as asked only if their sizes are, so each goes to the band of
    its own size and as a guest to the next larger one, where guests do not meet guests. What is still large is dealt by blocks of `block`
    rows; cut is 0 in buckets of at most SMALL rows. Counts are combined before they are shuffled, and stored, so that Spark can split a hot
    bucket's rows in the join.
    """
    hot = stage(rows.groupBy("h").agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select("h", F.lit(True).alias("_hot")), "hot")  # few: at most a row for each `block` rows
    band, one = F.floor(F.log(F.col("n").cast("double")) / (1e-9 - np.log(similarity))).cast("long"), lambda b, g: F.struct(b.alias("band"), F.lit(g).alias("guest"))
    bands = F.when(F.col("_hot"), F.array(one(band, False), one(band + 1, True))).otherwise(F.array(one(F.lit(-1).cast("long"), False)))
    rows = rows.join(hot, "h", "left").withColumn("_d", F.explode(bands)).select("h", "_d.band", "place", "n", "_d.guest", "node", "group", *_SKETCHES)
    size = rows.groupBy("h", "band").agg(F.count("*").alias("_n")).filter(F.col("_n") > SMALL)
    size = stage(size.select("h", "band", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_cut")), "sizes")
    return rows.join(size, ["h", "band"], "left").withColumn("cut", F.coalesce("_cut", F.lit(0))).drop("_cut")


def _candidates(dealt: DataFrame, similarity: float, which: str, turn: int = 0) -> DataFrame:
    """(ga, gb, a, b, more): pairs of texts of different groups ga < gb that meet in a prefix and may be similar.

    which: "star", those of LEADERS texts of each bucket of over SMALL rows, others at each turn; "one", one of any two groups, and whether more
    met; "every", every one. dealt: see _dealt.
    """
    keys, out = ["h", "band", "x", "y"], pa.schema([(k, pa.int64()) for k in ("ga", "gb", "a", "b")] + [("more", pa.bool_())])
    every = which == "every"

    def passes(place: list, n: list, guest: list, sketch: list) -> np.ndarray:
        """Of two sides: whether places, sizes and sketches leave room for the similarity, and not both are guests."""
        total = n[0] + n[1]
        hit = ~(guest[0] & guest[1]) & (np.minimum(n[0] - place[0], n[1] - place[1]) >= similarity / (1 + similarity) * total - 1e-6)
        hit &= np.minimum(n[0], n[1]) >= similarity * np.maximum(n[0], n[1]) - 1e-6
        at = np.flatnonzero(hit)
        apart = np.bitwise_count(np.broadcast_to(sketch[0], sketch[1].shape)[at] ^ sketch[1][at]).sum(axis=1)
        return at[apart <= total[at] * ((1 - similarity) / (1 + similarity)) + 1e-6]

    def batch_of(ga: np.ndarray, gb: np.ndarray, a: np.ndarray, b: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        swap = ga > gb
        columns = np.where(swap, gb, ga), np.where(swap, ga, gb), np.where(swap, b, a), np.where(swap, a, b)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(more)], schema=out)

    def large(place: np.ndarray, n: np.ndarray, guest: np.ndarray, node: np.ndarray, group: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of one bucket. Texts of its largest group come last: they are compared with those of others only."""
        _, of, sizes = np.unique(group, return_inverse=True, return_counts=True)
        order = np.lexsort((of, sizes[of]))
        place, n, guest, node, group, sketch, of = place[order], n[order], guest[order], node[order], group[order], sketch[order], of[order]
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        end, seen, told = np.repeat(ends, np.diff(np.concatenate(([0], ends)))), set(), set()
        for k in range(int(ends[-2]) if len(ends) > 1 else 0):
            rest = slice(int(end[k]), None)
            at = passes([place[k], place[rest]], [n[k], n[rest]], [guest[k], guest[rest]], [sketch[k], sketch[rest]]) + rest.start
            more = np.zeros(len(at), bool)
            if not every and len(at):
                _, first, many = np.unique(of[at], return_index=True, return_counts=True)
                pairs = [(of[k], g) for g in of[at[first]].tolist()]
                # a second text of the same group tells once that there are more
                new = np.array([p not in seen or p not in told for p in pairs])
                more = (many > 1) | np.array([p in seen for p in pairs])
                told.update(p for p, m in zip(pairs, more.tolist(), strict=True) if m)
                seen.update(pairs)
                at, more = at[first][new], more[new]
            if len(at):
                yield batch_of(np.full(len(at), group[k]), group[at], np.full(len(at), node[k]), node[at], more)

    def small(key: np.ndarray, place: np.ndarray, n: np.ndarray, guest: np.ndarray, node: np.ndarray, group: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of buckets of at most SMALL rows, which stand next to each other."""
        for step in range(1, SMALL):
            i = np.flatnonzero((key[step:] == key[:-step]) & (group[step:] != group[:-step]))
            if len(i):
                i = i[passes([place[i], place[i + step]], [n[i], n[i + step]], [guest[i], guest[i + step]], [sketch[i], sketch[i + step]])]
                yield batch_of(group[i], group[i + step], node[i], node[i + step], np.zeros(len(i), bool))

    def star(key: np.ndarray, place: np.ndarray, n: np.ndarray, guest: np.ndarray, node: np.ndarray, group: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of LEADERS texts of each bucket with its others: of those that are no guests the ones of the least hashes, mostly the same in buckets of one group."""
        lot = (node.view(np.uint64) ^ np.uint64(turn)) * np.uint64(0xC2B2AE3D27D4EB4F)
        lot = (lot ^ (lot >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((lot ^ (lot >> np.uint64(29)), guest, key))
        key, place, n, guest, node, group, sketch = key[order], place[order], n[order], guest[order], node[order], group[order], sketch[order]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))
        for step in range(LEADERS):
            j = np.flatnonzero(np.arange(len(key)) - first > step)
            j = j[group[j] != group[first[j] + step]]
            i = first[j] + step
            at = passes([place[i], place[j]], [n[i], n[j]], [guest[i], guest[j]], [sketch[i], sketch[j]])
            i, j = i[at], j[at]
            yield batch_of(group[i], group[j], node[i], node[j], np.zeros(len(i), bool))

    def buckets(key: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns = [*columns[:5], np.stack(columns[5:], axis=1).view(np.uint64)]
        if which == "star":
            yield from star(key, *columns)
            return
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        few = np.repeat(sizes <= SMALL, sizes)
        yield from small(key[few], *(c[few] for c in columns))
        for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            yield from large(*(c[s : s + m] for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            new = np.any([c[1:] != c[:-1] for c in now[: len(keys)]], axis=0)
            key = np.concatenate(([0], np.cumsum(new)))
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield from buckets(key[:cut], [c[:cut] for c in now[len(keys) :]])
            held = [c[cut:] for c in now]
        if held is not None:
            yield from buckets(np.zeros(len(held[0]), int), held[len(keys) :])

    rows = dealt.withColumn("_k", F.greatest("cut", F.lit(1))).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_k").cast("long")).cast("int"))
    if which == "star":  # a block has its own star
        rows = rows.filter("cut > 0").withColumn("_xy", F.struct(F.col("_b").alias("x"), F.col("_b").alias("y")))
    else:
        rows = rows.withColumn("_xy", F.explode(block_pairs("_k", "_b")))
    dealt = rows.select("h", "band", "_xy.x", "_xy.y", "place", "n", "guest", "node", "group", *_SKETCHES)
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "ga long, gb long, a long, b long, more boolean")
    if which != "one":
        return found.distinct()
    several = (F.min("a") < F.max("a")) | (F.min("b") < F.max("b")) | F.max("more")
    return found.groupBy("ga", "gb").agg(F.min("a").alias("a"), F.min_by("b", "a").alias("b"), several.alias("more"))


def _regrouped(df: DataFrame, moved: DataFrame, name: str = "group") -> DataFrame:
    to = moved.select(F.col("node").alias(name), F.col("root").alias("_to"))
    return df.join(to, name, "left").withColumn(name, F.coalesce("_to", name)).select(*df.columns)


def _replaced(before: DataFrame, after: DataFrame) -> DataFrame:
    """after, stored in place of before."""
    after = stage(after, "places")
    drop_stage(before)
    return after


def _grouped(named: DataFrame, size: int, similarity: float, radius: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(none, id, raw, node) of the rows of named, and (node, first, group) of each distinct text."""
    with passing() as keep:
        nodes, groups = _nodes_and_groups(named, size, similarity, radius, block)
        return keep(nodes), keep(groups)


def _nodes_and_groups(named: DataFrame, size: int, similarity: float, radius: int, block: int) -> tuple[DataFrame, DataFrame]:
    spark = named.sparkSession
    prints = stage(_printed(named, size, similarity), "prints")
    texts = stage(prints.groupBy("node").agg(_first("first"), F.any_value("fp").alias("fp")), "texts")
    of = stage(texts.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    equal = texts.join(of, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = links(of.select("fp"), radius).join(of.select(F.col("fp").alias("a"), F.col("least").alias("na")), "a").join(of.select(F.col("fp").alias("b"), F.col("least").alias("nb")), "b")
    linked = stage(equal.unionByName(near.select(F.col("na").alias("a"), F.col("nb").alias("b"))), "linked")
    same = connected_components(_checked(named, texts, linked, size, similarity))
    groups = stage(texts.join(same, "node", "left").select("node", "first", F.coalesce("root", "node").alias("group")), "groups")
    # sketches and prefixes of one row of each text, that of `first`
    keys = ["node", *ROW]
    sets = prints.join(groups.select("node", "first.*", "group").hint("merge"), keys).select(*keys, "group", "n", *_SKETCHES, "whole", "prefix").dropDuplicates(keys).drop(*ROW)
    sets = stage(sets, "sets")
    nodes = stage(prints.select(*ROW, "node"), "nodes")
    drop_stage(prints)
    forget_shuffles(spark)
    mixed = sets.select("group", F.explode("prefix").alias("v")).groupBy("v").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
    mixed = stage(mixed.select("v"), "mixed")
    sent = spark.sparkContext.broadcast(bitmap(mixed))
    drop_stage(mixed)
    forget_shuffles(spark)
    fields = ["h", "place", "n", "node", "group", *_SKETCHES]

    def let(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = sent.value
        for batch in batches:
            lists = batch.column("prefix")
            h, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            keep = np.flatnonzero(within(h.view(np.uint64), several))
            row = np.searchsorted(offsets, keep, side="right") - 1
            others = [pa.array(batch.column(c).to_numpy()[row]) for c in fields[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array((keep - offsets[row]).astype(np.int32)), *others], names=fields)

    rows = stage(sets.drop("whole").mapInArrow(let, "h long, place int, n int, node long, group long, " + ", ".join(f"{s} long" for s in _SKETCHES)), "places")
    wholes = stage(sets.select("node", "n", "whole"), "wholes")
    drop_stage(sets)
    rows = _replaced(rows, _dealt(rows, similarity, block))
    forget_shuffles(spark)
    # stars are for large buckets alone: what meets elsewhere is at most SMALL / 2 pairs for each row, and waits for the turn after them
    large, turn = rows.filter("cut > 0"), 0
    which = "one" if large.isEmpty() else "star"
    while True:
        met = _candidates(large if which == "star" else rows, similarity, which, turn)
        pairs = stage(_sketched(wholes, stage(met, "met"), similarity), "pairs")
        similar = _checked(named, texts, pairs.filter("fits"), size, similarity).withColumn("similar", F.lit(True))
        known = stage(pairs.join(similar, ["a", "b"], "left"), "known")
        moved = stage(connected_components(known.filter("similar").select(F.col("ga").alias("a"), F.col("gb").alias("b"))), "moved")
        groups = stage(_regrouped(groups, moved), "groups")
        if which == "every":
            break
        if which == "star":
            many = pairs.filter("fits").select(F.explode(F.array("ga", "gb"))).distinct().count()
            joined = moved.count()
            if joined >= FEW and joined * JOINING > many:
                large, turn = _replaced(large, _regrouped(large, moved)), turn + 1
            else:
                drop_stage(large)
                rows, which = _replaced(rows, rows.drop("group").join(groups.select("node", "group"), "node")), "one"
            continue
        which = "every"
        # groups of which one pair failed and others met
        still = known.filter("more and similar is null").select("ga", "gb")
        still = _regrouped(_regrouped(still, moved, "ga"), moved, "gb").filter("ga <> gb")
        still = stage(still.select(F.explode(F.array("ga", "gb")).alias("group")).distinct(), "still")
        if still.isEmpty():
            break
        left = _regrouped(rows.filter("not guest").select(*fields), moved).join(still, "group", "left_semi").select(*fields)
        rows = stage(_dealt(stage(left, "places"), similarity, block), "places")
    return nodes, groups


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 7, block: int = 1024) -> DataFrame:
    """One row per document: id, group (smallest id among texts that links of shingle similarity >= `similarity` connect).

    Equal word sequences are equal without comparison, blank and null texts equal each other. Rows of equal id and other texts are
    told apart by their texts. Rows with a null id count as after all others: their group has a null id only if all its rows do.
    Very long texts are compared whole. Repeated rows stay repeated; empty tables stay empty; other columns are not read.
    """
    nodes, groups = _grouped(_keyed(docs, id_col, text_col), shingle, similarity, radius, block)
    least = groups.groupBy("group").agg(_first("least", "first."))
    of = stage(groups.join(least, "group").select("node", F.when(~F.col("least.none"), F.col("least.id")).alias("group")), "classes")
    drop_stage(groups)
    return nodes.join(of, "node").select(F.when(~F.col("none"), F.col("id")).alias("id"), "group")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 7, block: int = 1024) -> DataFrame:
    """The first row of each group of similar_groups(), with all its columns: that of the least id, and of equal ids that of the least text hash.

    A text goes only if its own group has an earlier row, whatever other texts have its id. Of equal rows one stays; of rows of equal
    id and text that differ in other columns any one does. A row with a null id stays if no row with an id is in its group.
    """
    named = _keyed(docs, id_col, text_col)
    nodes, groups = _grouped(named, shingle, similarity, radius, block)
    kept = stage(groups.groupBy("group").agg(_first("k", "first.")).select("k.*"), "kept")
    for table in (nodes, groups):
        drop_stage(table)
    forget_shuffles(docs.sparkSession)
    # equal rows are combined before the one shuffle of whole texts, which the join takes over
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    whole = whole.select("_row", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64("_text").alias("raw"))
    return whole.dropDuplicates(ROW).join(kept.hint("merge"), ROW).select("_row.*")
