"""SimHash fingerprints, links within a Hamming radius by the generalised pigeonhole principle, and near-duplicate groups.

The 64 bits are dealt into m parts, bits that depend on each other into the same part. For thresholds t_1..t_m with
sum(t) = radius - m + 1, two fingerprints within the radius differ in at most t_i bits of some part i. Which parts get which
thresholds is chosen by dynamic programming over estimated costs: rows to send and pairs to compare. Each distinct fingerprint
sends its value of a part, and its values with up to t_i zero bits of that part set (the other side's value lacks them, so one
of the two always sends the other's). Those with equal values meet and are compared in full.

A bucket of more than BLOCK fingerprints is cut into blocks and each pair of blocks is a bucket of its own; what a bucket gives
is a spanning forest of its links, never all pairs, so rows stay in proportion to the fingerprints that meet.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, passing, rows_of, stage
from .components import connected_components

#: Fingerprints in a bucket before it is cut into blocks; a task holds two blocks at a time.
BLOCK = 4096
#: Cost of sending one row (count, join, shuffle, sort and Arrow: about 2 microseconds) against comparing one pair (about 5 nanoseconds).
ROW_COST = 400.0
ONE = np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased: what ASCII white space (space, tab to carriage return) separates."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, repeats included; fewer words are one shingle, none give none."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    many = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(line[a:b], 42) for a, b in zip(starts[:many].tolist(), last.tolist(), strict=True)), np.uint64, many)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit j is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) per row; null and blank texts get 0. shingle 0: over the set of distinct words instead."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def one(text: str | None) -> int:
        words = words_of(text)
        if shingle:
            return signed(majority_bits(shingle_hashes(words, shingle)))
        return signed(majority_bits(shingle_hashes(sorted({w.strip(b",.;:!?") for w in words}), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_chunks(((i, one(t)) for i, t in rows_of(batch)), schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many of them have bits i and j set (64 x 64), over all rows of distinct(fp)."""
    schema = pa.schema([("i", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for k in range(0, len(bits), 8192):
                total += bits[k : k + 8192].T @ bits[k : k + 8192]
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int32()), pa.array([*total.astype(np.int64).ravel().tolist(), n], pa.int64())], schema=schema)

    found = dict(distinct.select("fp").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect())
    return found.get(4096, 0), np.array([found.get(k, 0) for k in range(4096)], float).reshape(64, 64)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Deals the 64 bits into m parts of nearly equal size; each bit joins the part with which it correlates most."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(64)), []
    for k in range(m):
        size = (len(left) + m - k - 1) // (m - k)
        part = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (corr[b, part].sum(), -b)))
            left.discard(part[-1])
        parts.append(sorted(part))
    return parts


def differing(p: np.ndarray) -> np.ndarray:
    """Chance that two fingerprints differ in exactly k bits of a part, bits taken as independent."""
    out = np.ones(1)
    for q in 2 * p * (1 - p):
        out = np.convolve(out, [1 - q, q])
    return out


def sent(size: int, t: int) -> float:
    """Rows that a fingerprint sends for a part: its own value, and those with one of 1..t of its zero bits set."""
    return 0.0 if t < 0 else 1 + sum(comb(size, k) / 2 for k in range(1, t + 1))


def allocate(both: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost, over all numbers of parts; a part with threshold -1 is left out."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, radius + 2):
        parts = group_bits(both, n, m)
        costs = []
        for part in parts:
            near = np.cumsum(differing(p[part]))
            costs.append({t: 0.0 if t < 0 else ROW_COST * n * sent(len(part), t) + n * n / 2 * near[min(t, len(part))] for t in range(-1, min(radius, len(part)) + 1)})
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:  # thresholds of the parts so far that sum to s
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t, x in cost.items():
                    if s + t not in step or c + x < step[s + t][0]:
                        step[s + t] = (c + x, [*ts, t])
            table = step
        c, ts = table.get(radius - m + 1, (float("inf"), []))
        if c < best[0]:
            best = (c, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0])
    return best[1]


def probes(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, sig, fp): what each distinct fingerprint sends."""
    schema = pa.schema([("part", pa.int32()), ("sig", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(whole), 4096):
                fp = whole[k : k + 4096].view(np.uint64)
                for i, (bits, t) in enumerate(plan):
                    mask = np.uint64(sum(1 << b for b in bits))
                    own = fp & mask
                    sigs, fps = [own], [fp]
                    for w in range(1, t + 1):
                        for chosen in itertools.combinations(bits, w):
                            # the lowest of the flipped bits must be 0 here: then it is 1 in the other one, which need not send
                            free = (own >> np.uint64(chosen[0])) & ONE == 0
                            sigs.append(own[free] ^ np.uint64(sum(1 << b for b in chosen)))
                            fps.append(fp[free])
                    sig, fp_out = np.concatenate(sigs), np.concatenate(fps)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), i, np.int32)), pa.array(sig.view(np.int64)), pa.array(fp_out.view(np.int64))], schema=schema)

    return distinct.select("fp").mapInArrow(run, "part int, sig long, fp long")


def block_pairs(cut: str, own: str) -> Column:
    """(x, y) of each pair of `cut` blocks that has the block `own`."""
    return F.when(F.col(cut) == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col(cut) - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    )


def blocked(rows: DataFrame, keys: list[str], by: str, block: int) -> DataFrame:
    """Adds x and y: buckets of over `block` rows are cut by a hash of `by`, and a row goes to each pair that has its block.

    The counts are combined before they are shuffled, and stored, so that Spark can split a hot bucket's rows in the join; buckets
    with a single row are dropped, as nothing meets there.
    """
    size = stage(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1"), "sizes")
    cut = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(by), F.col("_k").cast("long")).cast("int")
    return rows.join(size, keys).withColumn("_k", cut).withColumn("_b", own).withColumn("_xy", F.explode(block_pairs("_k", "_b"))).select(*rows.columns, "_xy.x", "_xy.y")


def forest(values: np.ndarray, radius: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """A spanning forest of the links among distinct values: (value, values first reached from it)."""
    left = values
    while left.size:
        ahead, left = [left[0]], left[1:]
        while ahead and left.size:
            x = ahead.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hit, left = left[near], left[~near]
                ahead.extend(hit)
                yield x, hit


def links(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links among distinct(fp) that connect all fingerprints which links of at most `radius` bits connect."""
    n, both = bit_statistics(distinct)
    rows = blocked(probes(distinct, allocate(both, n, radius)), ["part", "sig"], "fp", block)
    keys = ["part", "sig", "x", "y"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    def compare(fp: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(starts, len(fp)))
        small = np.repeat(sizes <= 8, sizes)
        f, g = fp[small], group[small]
        for step in range(1, 8):
            if len(f) <= step:
                break
            hit = (g[step:] == g[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= radius) & (f[step:] != f[:-step])
            if hit.any():
                yield pairs(f[:-step][hit], f[step:][hit])
        for s, c in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            for x, hit in forest(np.unique(fp[s : s + c]), radius):
                yield pairs(np.full(len(hit), x), hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            new = np.zeros(len(now[0]), bool)
            for c in now[:4]:
                new[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new)
            cut = int(np.searchsorted(group, group[-1]))  # the last bucket may go on in the next batch
            held = [c[cut:] for c in now]
            if cut:
                yield from compare(now[4][:cut].view(np.uint64), group[:cut])
        if held is not None and len(held[0]):
            yield from compare(held[4].view(np.uint64), np.zeros(len(held[4]), int))

    return rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: id, fp, component_id (smallest id that links of at most `radius` bits reach).

    Rows with a null id keep their row; a group of only such rows has a null component_id. Repeated rows stay repeated.
    Empty tables give an empty table; very long texts are read whole. Only the two named columns are read.
    """
    with passing() as keep:
        fps = keep(stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints"))
        distinct = stage(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
        found = connected_components(links(distinct, radius))
        rooted = stage(distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
        # stored before it is joined, so that Spark can split a large component's or a common fingerprint's rows
        least = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
        of = keep(stage(rooted.join(least, "root").select("fp", "component_id"), "classes"))
    return fps.join(of, "fp").select("id", "fp", "component_id")
