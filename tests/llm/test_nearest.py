from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import ann_forest
from rankloom.llm.queries import QUERIES


def truth(rows, every, k=10):
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i, x in zip(ids, points, strict=True):
        if i % every == 0:
            score = np.sqrt(np.square(points - x).sum(axis=1))
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, score)) if ids[j] != i][:k]
    return out


def by_query(df):
    found = df.toPandas().sort_values(["query_id", "rank"])
    assert all(list(g["rank"]) == list(range(1, len(g) + 1)) for _, g in found.groupby("query_id"))
    return {int(q): list(zip(g["vec_id"].tolist(), g["score"].tolist(), strict=True)) for q, g in found.groupby("query_id")}


def test_query_recall_and_exact_scores(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = truth(rows, 100)
    got = by_query(QUERIES["op1_nearest_neighbours"](spark, folder))
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    points = {i: np.array(x, float) for i, x in rows}
    assert all(s == pytest.approx(np.linalg.norm(points[q] - points[i]), abs=1e-12) for q, own in got.items() for i, s in own)


@pytest.mark.parametrize("n", [1_200, 4_000])
def test_recall_without_structure_and_rows_read(spark, n):
    """Random directions in 64 dimensions: hardly anything tells near from far."""
    rng = np.random.default_rng(n)
    points = rng.normal(size=(n, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    rows = list(enumerate(points.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = truth(rows, 40), by_query(ann_forest.nearest(df, F.col("vec_id") % 40 == 0))
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    # Not all rows are read, so not all neighbours are found.
    assert 0.9 <= np.mean(hits) < 1
    forest = ann_forest.Forest(points)
    leaves, wanted = forest.leaves(points), forest.size * ann_forest.overlap_sum(ann_forest.SHARE, ann_forest.TREES)
    read = [np.mean(np.any([leaves[:, t] == leaf for t, leaf in forest.probe(points[q], wanted)], axis=0)) for q in range(0, n, 200)]
    assert 0.6 < np.mean(read) < 0.85


def test_clustered_vectors_need_a_small_share(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(60, 32)) * 4
    rows = [(i, (middles[i % 60] + rng.normal(size=32) * 0.5).tolist()) for i in range(6_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = truth(rows, 50), by_query(ann_forest.nearest(df, F.col("vec_id") % 50 == 0, share=0.1))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_hot_vector_in_parts_is_exact_over_all_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "LEAF_ROWS", 64)
    monkeypatch.setattr(ann_forest, "LEAF_QUERIES", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).round(2).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(ann_forest.nearest(df, F.col("vec_id") % 50 == 0, share=1.0))
    want = truth(rows, 50)
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in own] for q, own in want.items()}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (200, [0.0, 2.0])]
    bad = [(2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 1.0]), (7, [inf, 0.0]), (8, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in good + bad], "vec_id long, embedding array<float>, rank int, score int")
    got = by_query(ann_forest.nearest(df, F.col("vec_id") % 100 == 0))
    assert {q: [i for i, _ in own] for q, own in got.items()} == {0: [1, 100, 200], 100: [0, 1, 200], 200: [0, 1, 100]}
    assert ann_forest.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann_forest.nearest(df.where("vec_id = 2"), F.col("vec_id") % 100 == 0).count() == 0
