from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centres = [v for *_, v in hashed[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
            if mine:
                centres[n] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    found = assign()
    inside = {n: sum(d for d, c in found if c == n) for n in range(len(centres))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, inside[c], sum(d for d, _ in found), names[c]) for (i, _), (d, c) in zip(kept, found, strict=True)]


def vectors(n, seed, spread=1.0):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(7)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(middle)] for _ in range(n)]


@pytest.mark.parametrize("n,spread", [(3, 1.0), (40, 1.0), (300, 0.05), (300, 1.0)])
def test_against_brute_force(spark, n, spread):
    rows = list(enumerate(vectors(n, n, spread)))
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_odd_rows_ties_and_repeats(spark):
    good = vectors(60, 1)
    rows = [(i % 25, v) for i, v in enumerate(good)] + [(3, good[3])] * 20
    rows += [(100 + i, [float(i % 2)] * 64) for i in range(30)] + [(200, [0.0] * 64), (None, good[5])]
    bad = [(1, None), (2, []), (3, good[0][:63]), (4, [*good[0], 0.0]), (5, [None, *good[0][:63]]), (6, [float("nan"), *good[0][:63]]), (7, [float("-inf"), *good[0][:63]])]
    given = spark.createDataFrame(rows + bad, SCHEMA).withColumns({n: F.lit("clash") for n in ("x", "apex", "cluster", "distance")})
    got = sorted(map(str, map(tuple, centroids.cluster(given).collect())))
    # Rows without an id are told apart by their vector only.
    assert got == sorted(map(str, brute(rows)))


def test_empty_table_and_no_whole_vector(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0]), (2, None)], SCHEMA)).count() == 0


def test_equal_vectors_and_empty_clusters(spark):
    rows = [(i, [0.5] * 64) for i in range(90)]
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)} and len(got) == 90


def test_too_large_components_stop_the_job(spark):
    given = spark.createDataFrame([(1, [1e30] * 64)], SCHEMA)
    with pytest.raises(Exception, match="64 bits|out of|overflow"):
        centroids.cluster(given).collect()


def test_bounds_hold_and_filter():
    """No nearest centroid is ever filtered out, and near clusters need few comparisons."""
    rng = np.random.default_rng(2)
    for scale in (0.02, 1.0, 900.0):
        middle = rng.normal(0, 256 * scale, (40, 64))
        x = np.floor(middle[rng.integers(0, 40, 3_000)] + rng.normal(0, 20 * scale, (3_000, 64))).astype(np.int64)
        centres = np.floor(middle).astype(np.int64)
        pivots, base = centroids.choose_pivots(centres)
        a, b = (centroids.apexes(base, centroids.squared(v, pivots).astype(float)) for v in (x, centres))
        exact = centroids.squared(x, centres)
        low, high = centroids.bounds(a, b)
        assert (low <= exact).all() and (high >= exact).all()
        number, distance, compared = centroids.nearest(x, a, centres, b)
        assert (distance == exact.min(axis=1)).all() and (number == exact.argmin(axis=1)).all()
        if scale >= 1:
            assert compared < 0.2 * exact.size
