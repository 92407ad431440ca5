"""Centroid clustering of integer vectors by Lloyd's rounds, with exponion search for the nearest centroid.

Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to all others. Centroids move,
bounds follow by the triangle inequality, and a vector whose upper bound stays below the lower one (or below half the way from its
centroid to the nearest other one) is not compared at all. The others are compared with the centroids in a ball around their own one,
whose radius is twice the upper bound and the way to the nearest other centroid: a prefix of that centroid's sorted list of distances.
The ball is closed and bounds are widened by more than doubles round off, so that centroids at equal distance are always in it; which
one is nearest is decided by exact integers.

A round is one pass over a table of vectors and bounds in the shared folder, written anew. Its tasks add up what left and entered each
centroid, so that only sums for each centroid and task are shuffled, and only the centroids are on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

#: Components are exact up to this size and are held at it beyond: squared distances of up to 128 of them fit 64 bits.
MOST = 1 << 27
#: More than what a few operations on doubles round off.
WIDER = 1 + 1e-9

_STATE = "id long, v array<int>, cluster int, upper double, lower double, moved array<struct<cluster:int,n:long,total:array<long>>>"
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))
_STATE_ARROW = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("moved", _MOVED)])
_DONE_ARROW = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


@dataclass(frozen=True)
class Centroids:
    """Integer centroids, and what the search needs of them: sorted lists of distances from each to all, and how far each has moved."""

    at: np.ndarray
    order: np.ndarray
    away: np.ndarray
    moved: np.ndarray

    @staticmethod
    def of(at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        apart = np.sqrt(squared(at, at).astype(np.float64))
        np.fill_diagonal(apart, -1.0)  # itself is first in its list, before one at the same place
        order = np.argsort(apart, axis=1, kind="stable")
        away = np.maximum(np.take_along_axis(apart, order, axis=1), 0.0)
        moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(axis=1).astype(np.float64))
        return Centroids(at, order, away, moved * WIDER)

    @property
    def nearest(self) -> np.ndarray:
        """The way from each centroid to the nearest other one; endless if there is none."""
        return self.away[:, 1] if len(self.at) > 1 else np.full(len(self.at), np.inf)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of y."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), np.int64)
    most = int(max(np.abs(x).max(), np.abs(y).max()))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64  # doubles are exact while all sums are below 2^53
    x, y = x.astype(kind), y.astype(kind)
    return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)).astype(np.int64)


def two_nearest(x: np.ndarray, at: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x: the nearest of the centroids `among` (of equally near ones the smaller number), its distance, the second distance."""
    among = np.sort(among)
    d = squared(x, at[among])
    first = d.argmin(axis=1)
    near = d[np.arange(len(x)), first]
    d[np.arange(len(x)), first] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64)) if len(among) > 1 else np.full(len(x), np.inf)
    return among[first], np.sqrt(near.astype(np.float64)), second


def search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster, upper and lower bound of each row of x, and how many distances were taken. Clusters below 0 are unknown yet."""
    cluster, upper, lower, taken = cluster.copy(), upper.copy(), lower.copy(), 0
    new = cluster < 0
    if new.any():
        cluster[new], near, second = two_nearest(x[new], c.at, np.arange(len(c.at)))
        upper[new], lower[new] = near * WIDER, second / WIDER
        taken += int(new.sum()) * len(c.at)
    old = ~new
    if old.any():
        # the largest and second largest move: what another centroid may have come nearer
        far = np.argsort(c.moved)[::-1]
        most = np.full(len(c.at), c.moved[far[0]])
        most[far[0]] = c.moved[far[1]] if len(far) > 1 else 0.0
        upper[old] = (upper[old] + c.moved[cluster[old]]) * WIDER
        lower[old] = lower[old] / WIDER - most[cluster[old]]
        bound = np.maximum(lower, c.nearest[cluster] / 2 / WIDER)
        todo = np.flatnonzero(old & (upper >= bound))
        if len(todo):
            own = x[todo].astype(np.int64) - c.at[cluster[todo]]
            upper[todo] = np.sqrt((own * own).sum(axis=1).astype(np.float64)) * WIDER
            taken += len(todo)
            todo = todo[upper[todo] >= bound[todo]]
        for a in np.unique(cluster[todo]):
            mine = todo[cluster[todo] == a]
            radius = (2 * upper[mine] + c.nearest[a]) * WIDER
            held = np.maximum(np.searchsorted(c.away[a], radius, side="right"), min(2, len(c.at)))
            rings = np.minimum(1 << np.ceil(np.log2(held)).astype(int), len(c.at))  # prefixes of doubling length, as few of them as need be
            for m in np.unique(rings):
                rows = mine[rings == m]
                cluster[rows], near, second = two_nearest(x[rows], c.at, c.order[a][:m])
                upper[rows], lower[rows] = near * WIDER, second / WIDER
                taken += len(rows) * int(m)
    return cluster, upper, lower, taken


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _round(dims: int, c: Centroids):
    """The state after one assignment; the last row of a task has what left and entered each centroid, and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c.at), np.int64), np.zeros((len(c.at), dims), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, was = _matrix(b.column("v"), dims), b.column("cluster").to_numpy(zero_copy_only=False)
            now, upper, lower, _ = search(x, was, b.column("upper").to_numpy(zero_copy_only=False), b.column("lower").to_numpy(zero_copy_only=False), c)
            changed = was != now
            for k in np.unique(now[changed]):
                rows = changed & (now == k)
                n[k] += rows.sum()
                total[k] += x[rows].sum(axis=0)
            for k in np.unique(was[changed & (was >= 0)]):
                rows = changed & (was == k)
                n[k] -= rows.sum()
                total[k] -= x[rows].sum(axis=0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(now, pa.int32()), pa.array(upper), pa.array(lower), pa.nulls(b.num_rows, _MOVED)], schema=_STATE_ARROW)
        touched = [{"cluster": k, "n": int(n[k]), "total": total[k].tolist()} for k in range(len(n)) if n[k] or total[k].any()]
        if touched:
            yield pa.RecordBatch.from_pylist([dict.fromkeys(_STATE_ARROW.names) | {"moved": touched}], schema=_STATE_ARROW)

    return run


def _last(dims: int, c: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dims)
                now, *_ = search(x, b.column("cluster").to_numpy(zero_copy_only=False), b.column("upper").to_numpy(zero_copy_only=False), b.column("lower").to_numpy(zero_copy_only=False), c)
                own = x - c.at[now]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(now, pa.int32()), pa.array((own * own).sum(axis=1))], schema=_DONE_ARROW)

    return run


def _sums(state: DataFrame, sums: np.ndarray) -> np.ndarray:
    """Adds the changes of a round to (count, totals) of each centroid, in Python integers: a row for each centroid and component."""
    parts = state.filter(F.col("moved").isNotNull()).select(F.explode("moved").alias("m"))
    parts = parts.select("m.cluster", F.posexplode(F.concat(F.array("m.n"), "m.total")).alias("k", "x"))
    for r in parts.groupBy("cluster", "k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        sums[r["cluster"], r["k"]] += int(r["x"])
    return sums


def quantized(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v): vectors of exactly `dims` components, none null or non-finite, each as the integer floor(scale * x)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-1e15)), F.lit(1e15))), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return vectors.filter((F.size(vector_col) == dims) & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def clustered(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dims` components, none null or non-finite; others are in no row. Components become floor(1024 * x), held
    at +-2^27. The first centroids are the kept vectors whose sha256 of "seed:id" is smallest (null ids last; of repeated ids the smaller
    vector first); where there are fewer vectors than clusters, there are as many clusters as vectors. In each round all vectors go to the
    nearest centroid, ties to the smaller number, and each centroid that has any becomes the floor of their mean; then they are assigned
    once more. Rounds end early where no centroid moves, since nothing would change any more. Repeated rows stay repeated, an empty table
    stays empty, other columns are not read.
    """
    spark = vectors.sparkSession
    kept = quantized(vectors, dims, id_col, vector_col)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(hashed.asc_nulls_last(), "id", "v").limit(clusters).collect()  # as many rows as there are clusters
    schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    at, before = np.array([r["v"] for r in first], np.int64), None
    sums = np.zeros((len(at), dims + 1), object)
    state = kept.select("id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    held = None
    for _ in range(rounds):
        c = Centroids.of(at, before)
        state = stage(state.mapInArrow(_round(dims, c), _STATE), "vectors")
        if held is not None:
            drop_stage(held)
        held = state
        sums = _sums(state, sums)
        before, at = at, np.array([[int(t // s[0]) for t in s[1:]] if s[0] else list(old) for s, old in zip(sums, at, strict=True)], np.int64)
        state = state.filter(F.col("moved").isNull()).drop("moved")
        if (at == before).all():
            break
    done = stage(state.mapInArrow(_last(dims, Centroids.of(at, before)), "id long, cluster int, distance long"), "clusters")
    if held is not None:
        drop_stage(held)
    own = {r["cluster"]: int(r["x"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in at.tolist()]
    each = spark.createDataFrame([(k, x, sum(own.values()), digests[k]) for k, x in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(each), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each cluster
