"""How often the shared steps read and move ratings."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from rankloom.catalog import queries, storage
from rankloom.config import FeatureConfig
from rankloom.operators import batches, sampling, scoring
from rankloom.plans import feature_plan
from tests.conftest import RATINGS, plan_text

CONFIG = FeatureConfig(min_user_ratings=3, min_item_ratings=2)


@pytest.fixture
def counted(spark, random_ratings):
    """Ratings that count how often their rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return random_ratings.mapInArrow(count, RATINGS), seen, random_ratings.count()


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("most", [200_000, 0])
def test_plan_computes_ratings_once(counted, small_items, most):
    ratings, seen, n = counted
    feature_plan.build(ratings, small_items, FeatureConfig(3, 2, max_broadcast_rows=most)).interactions.collect()
    assert seen.value == n


def test_checked_job_computes_ratings_once(counted, small_items, tmp_path):
    ratings, seen, n = counted
    feature_plan.run(ratings, small_items, str(tmp_path / "out"), CONFIG)
    assert seen.value == n


@pytest.fixture
def folder(spark, tmp_path):
    """A star schema of 40 customers, 30 parts and 1,200 lines; ties and a missing order too."""
    day = datetime.datetime(2001, 1, 1)
    lines = [(k // 4, k * k % 31, k % 4, float(k % 50 + 1), day + datetime.timedelta(k % 9)) for k in range(1_200)]
    lines += lines[:40] + [(10_000, 1, 1, 1.0, day)]
    orders = [(k, k * 7 % 40 if k % 50 else None) for k in range(300)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_queries_scan_staged_ratings(spark, folder):
    assert not any("lineitem" in f for f in queries._kept(spark, folder).inputFiles())


@pytest.mark.usefixtures("no_broadcast")
def test_split_of_a_folder(spark, folder):
    """Indices, times and split are those of the whole history's order."""
    got = queries._split(spark, folder)
    assert got.columns == ["user_idx", "item_idx", "timestamp", "split"]
    kept = queries.cold_start.filter_cold_start(queries.binding.ratings(spark, folder), queries.P.MIN_USER, queries.P.MIN_ITEM)
    whole = queries.indexing.remap_ids(queries.splitting.temporal_split(kept, order=queries.CONFIG.history_order))[0].select(got.columns)
    rows = sorted(tuple(r) for r in got.collect())
    assert len(rows) > 900 and rows == sorted(tuple(r) for r in whole.collect())


@pytest.mark.usefixtures("no_broadcast")
def test_pairs_move_once_to_be_sampled(spark):
    rows = [(u, (u * 5 + i * 3) % 40, i, ("train", "train", "val", "test")[i % 4]) for u in range(20) for i in range(9)]
    pairs = spark.createDataFrame(rows, "user_idx int, item_idx int, timestamp bigint, split string").repartition(3)
    pairs.write.mode("overwrite").parquet(path := f"{queries.stage_root(spark)}/pairs")
    stored = spark.read.parquet(path)
    assert plan_text(sampling.labelled_splits(stored, 40)).count("Exchange hashpartitioning") == 1
    assert plan_text(sampling.eval_candidates(stored, 40, 5)).count("Exchange hashpartitioning") == 1


@pytest.mark.usefixtures("no_broadcast")
def test_scored_candidates_lie_by_user(spark):
    factors = spark.range(5).select(F.col("id").cast("int"), F.array(F.lit(1.0)).cast("array<float>").alias("features"), F.lit(0.0).cast("float").alias("bias"))
    pairs = spark.createDataFrame([(u, i) for u in range(5) for i in range(5)], "user_idx int, item_idx int")
    ranks = scoring.mf_score(pairs, factors, factors).groupBy("user_idx").agg(F.max("score"))
    # Two exchanges a join, none for the groups.
    assert plan_text(ranks).count("Exchange ") == 4


@pytest.mark.usefixtures("no_broadcast")
def test_ratings_are_narrow_where_they_are_joined(spark, folder):
    """Casts and calendar are computed before lines move to their orders."""
    bound = queries.binding.ratings(spark, folder)
    moved = [line for line in plan_text(bound.select("userId", "movieId", "rating", "timestamp")).split("+- Exchange") if "Scan" in line]
    assert len(moved) == 2 and all("Project" in m for m in moved)
    above = plan_text(bound).split("Exchange")[0]
    assert "l_shipdate" not in above and "l_quantity" not in above


def test_sort_keys_of_batches_do_not_move(spark):
    """The shuffle key follows from the row: it is computed where rows have come together, as
    sums of the cells before are."""
    rows = spark.createDataFrame([(u, i, float(u % 2)) for u in range(20) for i in range(30)], "user_idx int, item_idx int, label float")
    plan = plan_text(batches.training_batches(rows.repartition(3), 50, cell_rows=100))
    exchanges = [part for part in plan.split("Exchange hashpartitioning(_cell")[1:]]
    assert exchanges and not any("_key" in part.split("HashAggregate")[0].split("Generate")[0] for part in exchanges)


def test_written_histories_leave_ties_behind(spark, folder, tmp_path, monkeypatch):
    staged = {}
    keep = feature_plan.stage
    monkeypatch.setattr(feature_plan, "stage", lambda df, name, **k: staged.setdefault(name, keep(df, name, **k)))
    items = spark.createDataFrame([(m, f"Item {m}", "Noir|War") for m in range(31)], "movieId int, title string, genres string")
    config = FeatureConfig(3, 2, tie_columns=queries.binding.TIE_COLUMNS)
    feature_plan.run(queries.binding.ratings(spark, folder), items, str(tmp_path / "out"), config, checked=False)
    assert set(queries.binding.TIE_COLUMNS) <= set(staged["ratings"].columns)
    assert not set(queries.binding.TIE_COLUMNS) & set(staged["histories"].columns)


def test_lines_are_stored_compressed(spark, folder, tmp_path, monkeypatch):
    """Lines of ratings are written packed and read back whole."""
    ratings = queries.binding.ratings(spark, folder)
    monkeypatch.setattr(storage, "fresh", lambda _: str(tmp_path / "lines"))
    parsed = storage._records(spark, ratings)
    assert parsed.good.count() + parsed.bad.count() == ratings.count()
    files = [f.name for f in (tmp_path / "lines").glob("part-*")]
    assert files and all(f.endswith(".gz") for f in files)
