"""Sets of 64-bit hashes as bitmaps that tasks get whole: they let through all members, and few others while they are not full.

A bitmap has 8 to 16 bits a member, from 2^20 to 2^29 bits (64 MB) in all, whatever the corpus; from some 100 M members on it lets more
and more through, and what reads it must be right, and in proportion to its input, with a bitmap that lets all through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SEGMENT = 1 << 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29


def bits_for(members: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * members).bit_length()))


def bitmap(values: DataFrame, bits: int | None = None) -> np.ndarray:
    """The bitmap of values(v long): two bits for each value, of its lower and its upper half. Without `bits`, values are counted: give a stored table.

    Values are dealt to tasks by segments of the bitmap, which come to the driver once each and in one job: 64 MB at most. (Partition by
    partition they would come in a job for each shuffle partition, one after the other, however few segments there are.)
    """
    bits = bits or bits_for(values.count())
    schema = pa.schema([("segment", pa.int32()), ("data", pa.binary())])
    per = min(_SEGMENT, bits)

    def setbits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.sort(batch.column(1).to_numpy(zero_copy_only=False))
            for part in np.split(slots, np.flatnonzero(np.diff(slots // per)) + 1):
                if len(part):
                    held.setdefault(int(part[0]) // per, np.zeros(per, bool))[part % per] = True
        for segment, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], schema=schema)

    out = np.zeros(bits // 8, np.uint8)
    low, high = F.col("v").bitwiseAND(bits - 1), F.shiftrightunsigned("v", 32).bitwiseAND(bits - 1)
    both = values.select(F.explode(F.array(low.cast("int"), high.cast("int"))).alias("slot"))
    slots = both.select(F.floor(F.col("slot") / per).cast("int").alias("segment"), "slot").repartition("segment")
    for segment, data in slots.mapInArrow(setbits, "segment int, data binary").collect():
        out[segment * per // 8 : (segment + 1) * per // 8] = np.frombuffer(data, np.uint8)
    return out


def within(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bitmap has both bits of each value."""
    mask = np.uint64(8 * len(bits) - 1)

    def hit(slot: np.ndarray) -> np.ndarray:
        return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1

    return (hit(h & mask) & hit((h >> np.uint64(32)) & mask)).astype(bool)
