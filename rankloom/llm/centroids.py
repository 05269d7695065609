"""Clustering of integer vectors around centroids, with candidates from N-simplex projection.

The distances of a vector to a few pivots, squared integers and so exact, place it as the apex
of a simplex over the pivots: coordinates in the pivots' own space and an altitude above it. Of
two apexes the plain distance is a lower bound of the distance of the vectors, and the distance
with one altitude turned over an upper bound. Apexes of all vectors are computed once and kept
with them; in each round a centroid whose lower bound exceeds the smallest upper bound, or the distance of
the likeliest centroid, is out, and only the others are compared, in integers.

A round is one pass over the kept table. It brings one sum per centroid to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import keep

#: Fixed values of the clustering: vector length, scale of the integers, centroids, rounds.
DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED_TEXT = "2:"

#: Pivots of the projection, taken from the first centroids.
PIVOTS = 16

#: A pivot must stand out of the space of those before it by this part of their distances,
#: which keeps the coordinates' rounding errors far below ``SLACK``.
LEAST_ALTITUDE = 0.02

#: Allowance for rounding, as a part of the squared distances at hand.
SLACK = 1e-7

#: Larger integers would have squared distances beyond 64 bits.
LARGEST = 1 << 26

#: Vectors compared at a time.
ROWS = 1_024


def is_whole(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has all its components, each a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def as_integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of one matrix to those of another."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def apexes(base: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Apex coordinates from squared distances to the pivots at ``base``; altitude last."""
    n = len(base)
    out = np.zeros((len(distances), n))
    for i in range(1, n):
        known = out[:, : i - 1] @ base[i, : i - 1]
        out[:, i - 1] = ((distances[:, 0] - distances[:, i] + (base[i] ** 2).sum()) / 2 - known) / base[i, i - 1]
    out[:, n - 1] = np.sqrt(np.maximum(distances[:, 0] - (out[:, : n - 1] ** 2).sum(axis=1), 0))
    return out


def choose_pivots(vectors: np.ndarray, most: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Pivots among the vectors, each the highest above the simplex of those before it, and
    their coordinates. Vectors that hardly leave that space are no pivots."""
    pivots, base = vectors[:1], np.zeros((1, 0))
    while 0 < len(pivots) < min(most, len(vectors)):
        found = apexes(np.pad(base, ((0, 0), (0, 1))), squared(vectors, pivots).astype(float))
        best = int(found[:, -1].argmax())
        if found[best, -1] <= LEAST_ALTITUDE * np.sqrt((found**2).sum(axis=1).max()):
            break
        base = np.vstack([np.pad(base, ((0, 0), (0, 1))), found[best]])
        pivots = np.vstack([pivots, vectors[best : best + 1]])
    return pivots, np.pad(base, ((0, 0), (0, 1)))


def bounds(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of vectors to centroids, from their
    apexes; rounding is allowed for."""
    a, b = (points**2).sum(axis=1)[:, None], (centres**2).sum(axis=1)[None, :]
    low = a + b - 2 * points @ centres.T
    slack = SLACK * (a + b) + 1e-3
    return low - slack, low + 4 * points[:, -1:] * centres[None, :, -1] + slack


def nearest(vectors: np.ndarray, points: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid, the smaller number among equals,
    and how many distances were computed.

    A centroid is out if its lower bound exceeds the smallest upper bound, or the distance of
    the centroid with the smallest lower bound.
    """
    cluster, distance, compared = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int64), 0
    for at in range(0, len(vectors), ROWS):
        some = vectors[at : at + ROWS]
        low, high = bounds(points[at : at + ROWS], centres)
        likely = low.argmin(axis=1)
        first = ((some - centroids[likely]) ** 2).sum(axis=1)
        possible = low <= np.minimum(high.min(axis=1), first)[:, None]
        possible[np.arange(len(some)), likely] = True
        row, number = np.nonzero(possible)
        exact = ((some[row] - centroids[number]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, starts)
        # Per row the first that reaches the least; numbers ascend within a row.
        hit = np.flatnonzero(exact == np.repeat(least, np.diff(starts, append=len(row))))
        cluster[at : at + ROWS] = number[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]]
        distance[at : at + ROWS] = least
        compared += len(row) + len(some)
    return cluster, distance, compared


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _project(pivots: np.ndarray, base: np.ndarray):
    """Rows (vec_id, x) with the apexes of their vectors."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"], np.int64, pivots.shape[1])
            if (np.abs(x) >= LARGEST).any():
                raise ValueError(f"a component of {LARGEST} or more has no squared distance in 64 bits")
            apex = apexes(base, squared(x, pivots).astype(float))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(apex.ravel()), len(base)).cast(pa.list_(pa.float64()))
            narrow = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.int32)), x.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], narrow, lists], ["vec_id", "x", "apex"])

    return project


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, centres: np.ndarray):
    for batch in batches:
        x = _matrix(batch["x"], np.int64, centroids.shape[1])
        cluster, distance, _ = nearest(x, _matrix(batch["apex"], float, centres.shape[1]), centroids, centres)
        yield batch, x, cluster, distance


def _sums(centroids: np.ndarray, centres: np.ndarray):
    """Per task one row and sum for every centroid that vectors were assigned to."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x, cluster, _ in _assigned(batches, centroids, centres):
            n += np.bincount(cluster, minlength=len(n))
            np.add.at(total, cluster, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return sums


def _assignments(centroids: np.ndarray, centres: np.ndarray):
    def assignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance in _assigned(batches, centroids, centres):
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return assignments


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept.

    Kept are the vectors with exactly ``dimensions`` components, none null or non-finite. They
    are clustered as integers, floor(256 * x). The first centroids are the k vectors whose ids
    have the smallest SHA-256 of ``2:<id>``; after each of the rounds a centroid is the floor
    of its vectors' mean, or stays where it has none. Equal distances go to the smaller number.

    Fewer than k vectors give as many centroids as there are vectors. Ids may repeat, and every
    row is clustered; among equal hashes the smaller vector comes first, and vectors with a
    null id start a centroid only where too few others exist. Equal vectors share a cluster.
    Other columns are ignored. An empty table gives no rows. A component of 2**18 or more
    before scaling stops the job: its distances do not fit 64 bits.
    """
    spark = vectors.sparkSession
    rows = vectors.where(is_whole(F.col(vector), dimensions)).select(F.col(vec_id).alias("vec_id"), as_integers(F.col(vector)).alias("x"))
    order = F.sha2(F.concat(F.lit(SEED_TEXT), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dimensions)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)
    if (np.abs(centroids) >= LARGEST).any():
        raise ValueError(f"a component of {LARGEST} or more has no squared distance in 64 bits")
    chosen, base = choose_pivots(centroids, pivots)

    kind = vectors.select(vec_id).schema[0].dataType.simpleString()
    kept = keep(rows.mapInArrow(_project(chosen, base), f"vec_id {kind}, x array<int>, apex array<double>"), "vectors")
    places = lambda c: apexes(base, squared(c, chosen).astype(float))
    for _ in range(rounds):
        partial = kept.mapInArrow(_sums(centroids, places(centroids)), "cluster int, n long, total array<long>")
        exact = [F.sum(F.col("total")[i].cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(dimensions)]
        # One row per centroid.
        found = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*exact).alias("total")).collect()
        centroids = centroids.copy()
        for row in found:
            centroids[row["cluster"]] = [int(t) // row["n"] for t in row["total"]]

    assigned = keep(kept.mapInArrow(_assignments(centroids, places(centroids)), f"vec_id {kind}, cluster int, distance long"), "assigned")
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = assigned.agg(F.sum("distance").alias("inertia"))
    # k rows, k rows and one.
    facts = F.broadcast(inertia.join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(whole)))
    return assigned.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
