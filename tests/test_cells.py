"""Cells follow the data: crowded values, far outliers, any number of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import batches, drift, metrics, ordering, sampling


def largest(cut):
    return cut.groupBy("_cell").count().agg(F.max("count")).first()[0]


SATURATED = 1 - np.random.default_rng(1).random(12_000) * 1e-9
OUTLIER = np.append(np.random.default_rng(2).random(12_000), 1e300)


@pytest.mark.parametrize("values", [SATURATED, OUTLIER], ids=["saturated", "outlier"])
def test_no_cell_is_crowded_and_order_holds(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"value": np.unique(values)})).withColumn("n", F.lit(1).cast("long"))
    cut = ordering.range_cells(df, ["value"], 500)
    assert largest(cut) <= 1_500
    got = ordering.prefix_sums(cut, "value", ["n"], F.col("_cell")).orderBy("value").toPandas()
    assert got["n_before"].tolist() == list(range(len(got)))


def test_auc_of_saturated_scores_is_exact(spark):
    rng = np.random.default_rng(3)
    score = np.concatenate([SATURATED[:6_000], [0.2, 0.2, np.nan]])
    label = (rng.random(len(score)) < 0.3).astype(float)
    scored = spark.createDataFrame(pd.DataFrame({"label": label, "score": score})).replace(float("nan"), None)
    pos, neg = (score[:-1][label[:-1] == k] for k in (1, 0))
    want = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    row = metrics.binary_metrics(scored, cell_rows=300).first()
    assert row["n"] == len(score) and row["auc"] == pytest.approx(want, abs=1e-12)
    assert row["auc"] == pytest.approx(metrics.auc(scored).first()["auc"], abs=1e-12)
    p = np.clip(score[:-1], 1e-7, 1 - 1e-7)
    assert row["log_loss"] == pytest.approx(-(label[:-1] * np.log(p) + (1 - label[:-1]) * np.log(1 - p)).mean(), rel=1e-9)
    assert row["accuracy"] == pytest.approx(((score[:-1] > 0.5) == (label[:-1] > 0.5)).mean())


def test_metrics_of_odd_labels_and_scores(spark):
    """Missing and fractional labels, both zeros and no number as a score, in cells of one score."""
    rows = [(None, 0.3), (1.0, 0.3), (None, 0.9), (0.75, None), (0.0, float("nan")), (1.0, -0.0), (0.0, 0.0), (0.25, 0.8)]
    df = spark.createDataFrame(rows, "label double, score double")
    row = metrics.binary_metrics(df, cell_rows=1).first()
    # Pairs in order: 0.3 over the zero, and the tied zeros half, of two positives and three negatives.
    assert (row["n"], row["accuracy"], row["auc"]) == (8, pytest.approx(1 / 7), pytest.approx(1.5 / 6))
    # Labels that are missing at a score with labels count as negative ones.
    losses = [-np.log(0.3) - np.log(0.7), 0.0, -np.log(1e-7), -np.log(1e-7), -np.log(1 - 1e-7), -0.25 * np.log(0.8) - 0.75 * np.log(0.2)]
    assert row["log_loss"] == pytest.approx(sum(losses) / 7, rel=1e-6)
    assert metrics.binary_metrics(df.where("label IS NULL")).first().asDict() == {"n": 2, "log_loss": None, "accuracy": 0.0, "auc": None}


def test_scores_move_once_and_packed(spark):
    """Counts are not grouped by score across tasks: stretches leave one row each."""
    df = spark.range(0, 40_000, 1, 4).select((F.col("id") % 3 == 0).cast("float").alias("label"), (F.rand(3)).alias("score"))
    counts = metrics.score_counts(df, 5_000)
    assert counts.count() == 4
    assert 4 <= metrics._ranked(counts, 5_000).count() <= 16


def test_metrics_of_no_rows(spark):
    row = metrics.binary_metrics(spark.createDataFrame([], "label double, score double")).first()
    assert row.asDict() == {"n": 0, "log_loss": None, "accuracy": None, "auc": None}


def test_edges_with_a_far_outlier(spark):
    df = spark.createDataFrame(pd.DataFrame({"feature": "x", "value": OUTLIER}))
    edges = drift.quantile_edges(drift.value_counts(df), 10, cell_rows=400).first()["edges"]
    assert np.allclose(edges, np.percentile(OUTLIER, np.arange(0, 101, 10)), rtol=1e-12)


def test_report_from_merged_states(spark):
    rng = np.random.default_rng(4)
    days = [pd.DataFrame({"feature": rng.choice(["a", "b"], 900), "value": rng.normal(d, 2, 900).round(1)}) for d in range(4)]
    tables = [spark.createDataFrame(d) for d in days]
    whole = drift.drift_report(tables[0].unionAll(tables[1]), tables[2].unionAll(tables[3]), ["a", "b", "c"])
    states = [drift.value_counts(t) for t in tables]
    parts = drift.report_of_states(drift.merged(*states[:2]), drift.merged(*states[2:]), ["a", "b", "c"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    both = pd.concat(days[:2])
    a = both[both["feature"] == "a"]["value"]
    row = whole.where("feature = 'a'").first()
    assert (row["expected_mean"], row["expected_std"]) == (pytest.approx(a.mean(), abs=1e-4), pytest.approx(a.std(ddof=0), abs=1e-4))


@pytest.mark.parametrize("n", [0, 1, 1_234, 2_999, 3_000])
def test_sample_by_further_digits(spark, n):
    df = spark.range(3_000)
    few = sampling.sample_rows(df, n, ["id"], cell_rows=2).collect()
    assert sorted(few) == sorted(sampling.sample_rows(df, n, ["id"]).collect()) and len(few) == n


def test_batches_do_not_depend_on_cells(spark):
    rows = spark.range(4_000).selectExpr("int(id % 300) user_idx", "int(id % 70) item_idx", "float(id % 2) label")
    few, many = (batches.training_batches(rows, 256, cell_rows=c) for c in (10**9, 40))
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    cells = many.select(F.col("batch_id")).distinct().count()
    assert cells == -(-4_000 // 256)
