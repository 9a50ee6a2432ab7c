"""Centroid clustering of integer vectors with Elkan's bounds.

Vectors with exactly `size` components, none null or non-finite, are turned into integers and
assigned to the nearest of k centroids by squared Euclidean distance (ties: the smaller number);
centroids then become the componentwise floor of their vectors' mean, empty ones stay.

With every vector goes an upper bound of the distance to its centroid and a lower bound to each of
the k.  When centroids have moved, the bounds move with them, and a distance is computed only where
the bounds and the distances between centroids leave it open.  Bounds are doubles that every step
rounds outwards, and a centroid is passed over only if it is strictly farther, so ties are always
computed.  Distances that are computed are exact integers, and so are sums and means.

A pass over the vectors is one job without a shuffle.  It writes each vector with its bounds, and
at the end of a task what the centroids' sums have gained and lost by the vectors that changed
sides.  Such gains, one row for each centroid and component, are all that is shuffled; the driver
gets k centroids.  Passes are written to the shared folder, and the one before the last two is
deleted when the next has been written.

Integers of any size are exact: components up to 2**27 are kept as 32-bit integers and computed in
64 bits, vectors with larger ones are kept as doubles and computed with Python's integers, and sums
are taken over digits of 40 bits.

Cases: fewer kept vectors than k give fewer centroids.  Repeated rows are vectors of their own; of
rows with one id those with smaller vectors come first among the starting centroids.  A null id
counts as the text "null" there and is returned as null.  A distance or an inertia beyond 64 bits is
null (the clusters are right all the same).  An empty table gives an empty result.  Only the named
columns are read."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, BatchFn, columns_as, dropped, kept, staged

SIZE = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
SMALL = 1 << 27
DIGIT = 40
STATE = "vec_id long, vec binary, cluster int, upper double, lower binary, distance decimal(38,0)"
GAINS = "centroid int, component int, digit int, gain long"


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: 64-bit integers, or Python's where some are beyond SMALL."""
    if not x.size or np.abs(x).max() <= SMALL // SCALE:
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([int(v) * SCALE if abs(v) >= 1 << 52 else math.floor(SCALE * v) for v in x.ravel().tolist()], object).reshape(x.shape)


def as_bytes(x: np.ndarray) -> list[bytes]:
    """Vectors of doubles as they are kept: 4 bytes a component if all are small, else 8."""
    small = np.abs(x).max(axis=1, initial=0) <= SMALL // SCALE
    out = [v.tobytes() for v in x]
    for k, v in zip(np.flatnonzero(small).tolist(), scaled(x[small]).astype("<i4"), strict=True):
        out[k] = v.tobytes()
    return out


def as_integers(raw: list[bytes], size: int) -> np.ndarray:
    large = [k for k, r in enumerate(raw) if len(r) == 8 * size]
    if not large:
        return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), size).astype(np.int64)
    out = np.empty((len(raw), size), object)
    for k, r in enumerate(raw):
        out[k] = scaled(np.frombuffer(r, np.float64)) if len(r) == 8 * size else np.frombuffer(r, "<i4").astype(object)
    return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to those of c, or to the one vector c."""
    if x.dtype == object or c.dtype == object:
        return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=-1)
    d = x - c
    return np.einsum("...j,...j->...", d, d)


def outward(d, up: bool) -> np.ndarray:
    """The roots of exact squared distances, rounded up or down for sure."""
    d = np.asarray(d)
    if d.dtype == object:  # beyond doubles the upper bound is infinite, the lower one the largest double
        top = int(np.finfo(np.float64).max)
        d = np.array([float(v) if v <= top else np.finfo(np.float64).max * (np.inf if up else 1) for v in d.ravel()]).reshape(d.shape)
    r = np.sqrt(d.astype(np.float64))
    away = np.inf if up else -np.inf
    for _ in range(2):  # one place for the conversion to a double, one for the root
        r = np.nextafter(r, away)
    return np.maximum(r, 0)


class Centroids:
    """Centroids of a pass, how far they moved to get here, and how far they are from each other."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None = None) -> None:
        self.now = self._array(now)
        k = len(now)
        self.moved = outward(squared(self.now, self._array(before)), True) if before else np.zeros(k)
        # half the distance to each other centroid, and to the nearest
        self.half = np.full((k, k), np.inf)
        for a in range(k):
            others = [b for b in range(k) if b != a]
            self.half[a, others] = np.nextafter(outward(squared(self.now[others], self.now[a]), False) / 2, -np.inf)
        self.near = self.half.min(axis=1, initial=np.inf)

    @staticmethod
    def _array(rows: list[list[int]]) -> np.ndarray:
        x = np.array(rows, object).reshape(len(rows), len(rows[0]) if rows else 0)
        return x.astype(np.int64) if not x.size or max(abs(v) for v in x.ravel()) <= SMALL else x


def assign(x: np.ndarray, c: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, skipped: Counter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) of vectors when their centroids have moved to those of `c`."""
    cluster, upper, lower = cluster.copy(), np.nextafter(upper + c.moved[cluster], np.inf), np.maximum(np.nextafter(lower - c.moved, -np.inf), 0)
    best = np.zeros(len(x), object if object in (x.dtype, c.now.dtype) else np.int64)
    known = np.zeros(len(x), bool)
    live = np.flatnonzero(upper >= c.near[cluster])
    computed = 0

    def open_(rows: np.ndarray, j: int) -> np.ndarray:
        own = cluster[rows]
        return rows[(own != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= c.half[own, j])]

    for j in range(len(c.now)):
        rows = open_(live, j)
        first = rows[~known[rows]]
        if len(first):  # the distance to the vector's own centroid makes the upper bound tight
            own = cluster[first]
            best[first] = squared(x[first], c.now[own])
            upper[first], lower[first, own] = outward(best[first], True), outward(best[first], False)
            known[first] = True
            computed += len(first)
            rows = open_(rows, j)
        if len(rows):
            d = squared(x[rows], c.now[j])
            lower[rows, j] = outward(d, False)
            computed += len(rows)
            nearer = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
            rows, d = rows[nearer], d[nearer]
            cluster[rows], best[rows], upper[rows] = j, d, outward(d, True)
    if skipped is not None:
        skipped.update(computed=computed, all=len(x) * len(c.now))
    return cluster, upper, lower


def _kept(size: int) -> BatchFn:
    """Vectors that count, as bytes."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            whole = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == size))
            values = column.take(pa.array(whole)).flatten()
            x = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(whole), size)
            ok = np.isfinite(x).all(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whole[ok])), pa.array(as_bytes(x[ok]), pa.binary())], ["vec_id", "vec"])

    return run


def digits(v: int) -> list[int]:
    """v in digits of DIGIT bits, the smallest first; the last one carries the sign."""
    out = []
    while not -(1 << DIGIT) < v < 1 << DIGIT:
        out.append(v & (1 << DIGIT) - 1)
        v >>= DIGIT
    return [*out, v]


def _gained(gains: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [(j, p, k, d) for j, total in gains.items() for p, v in enumerate(total.tolist()) for k, d in enumerate(digits(int(v)))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["centroid", "component", "digit", "gain"])


def _pass(shared, size: int, last: bool) -> BatchFn:
    """Vectors with their bounds, and at the end of the task one row for each gain.  Component `size`
    counts vectors.  In the last pass nothing is gained, and exact distances come out."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kept("elkan")
        c: Centroids = shared.value
        k = len(c.now)
        gains: dict[int, np.ndarray] = {}
        names = [f.split()[0] for f in f"{STATE}, {GAINS}".split(", ")]
        for b in batches:
            raw = b.column(1).to_pylist()
            if not raw:
                continue
            x, n = as_integers(raw, size), len(raw)
            if b.num_columns == 2:  # the first pass: every vector is with the first centroid, nothing is known
                was, cluster, upper, lower = np.full(n, -1), np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
            else:
                was = cluster = b.column(2).to_numpy().astype(np.int64)
                upper, lower = b.column(3).to_numpy(), np.frombuffer(b"".join(b.column(4).to_pylist()), np.float64).reshape(n, k)
            cluster, upper, lower = assign(x, c, cluster, upper, lower)
            distance = pa.nulls(n, pa.decimal128(38, 0))
            if last:
                exact = squared(x, c.now[cluster]).tolist()
                distance = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).cast(pa.decimal128(38, 0))
            else:
                for sign, side in ((1, cluster), (-1, was)):
                    for j in np.unique(side[(cluster != was) & (side >= 0)]).tolist():
                        own = x[(side == j) & (cluster != was)]
                        total = np.append(own.sum(axis=0), len(own)).astype(object)
                        gains[j] = gains.get(j, 0) + sign * total
            state = [b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array([v.tobytes() for v in lower], pa.binary()), distance]
            yield pa.RecordBatch.from_arrays([*state, *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names)
        if gains:
            g = _gained(gains)
            n = g.num_rows
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.binary(), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([*none, *g.columns], names)

    return run


def starting(vectors: DataFrame, k: int, seed: int, size: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = vectors.orderBy(key, "vec").limit(k).select("vec").collect()
    return [[int(v) for v in as_integers([bytes(r.vec)], size)[0]] for r in first]


def _next(sums: dict[tuple[int, int], int], centroids: list[list[int]], size: int) -> list[list[int]]:
    out = []
    for j, c in enumerate(centroids):
        n = sums.get((j, size), 0)
        out.append([sums.get((j, p), 0) // n for p in range(size)] if n else c)
    return out


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster and exact distance of every vector kept; the centroids)."""
    spark = vectors.sparkSession
    rows = columns_as(vectors, vec_id=id_col, embedding=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    state = staged(rows.mapInArrow(_kept(size), "vec_id long, vec binary"), "vectors")
    centroids = starting(state, k, seed, size)
    sums: dict[tuple[int, int], int] = {}
    before, done = None, []
    for step in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Centroids(centroids, before))
        made = staged(state.mapInArrow(_pass(shared, size, step == rounds), f"{STATE}, {GAINS}"), "bounds")
        done.append(state)
        if len(done) > 1:
            dropped(done.pop(0))
        state = made.where("centroid is null").select(*(f.split()[0] for f in STATE.split(", ")[:5]))
        if step < rounds:
            for r in made.where("centroid is not null").groupBy("centroid", "component", "digit").agg(F.sum(F.col("gain").cast("decimal(38,0)")).alias("gain")).collect():
                at = (r.centroid, r.component)
                sums[at] = sums.get(at, 0) + (int(r.gain) << DIGIT * r.digit)
            before, centroids = centroids, _next(sums, centroids, size)
    return made.where("centroid is null").select("vec_id", "cluster", F.col("distance").cast("long").alias("distance")), centroids


def cluster_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept."""
    rows, centroids = clusters(vectors, id_col, vector_col, k, rounds, size, seed)
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = {r.cluster: None if r.s is None else int(r.s) for r in rows.groupBy("cluster").agg(total.alias("s")).collect()}  # k rows at most
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    inertia = fits(None if None in by.values() else sum(by.values()))
    few = [(j, fits(s), inertia, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, s in by.items()]
    kinds = {"cluster": pa.int32(), "cluster_inertia": pa.int64(), "inertia": pa.int64(), "centroid_sha256": pa.string()}
    few = vectors.sparkSession.createDataFrame(pa.table({name: pa.array([r[k] for r in few], kind) for k, (name, kind) in enumerate(kinds.items())}))
    return rows.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
