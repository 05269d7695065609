"""The feature plan for user and item tables that are too large to broadcast."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.config import FeatureConfig
from rankloom.operators import features
from rankloom.plans import feature_plan
from rankloom.sources.staging import bucket_count, scope, stage, stage_bucketed
from tests.conftest import RATINGS, plan_text

PLAIN = FeatureConfig(min_user_ratings=3, min_item_ratings=2)
BUCKETED = replace(PLAIN, max_broadcast_rows=0)


@pytest.fixture
def no_broadcast(spark):
    """Neither hints by size nor the planner's own broadcasts."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def exact(df):
    rounded = [F.round(n, 9).alias(n) if t == "double" else F.col(n) for n, t in sorted(df.dtypes)]
    return Counter(tuple(r) for r in df.select(*rounded).collect())


@pytest.mark.parametrize("scope_of", ["all", "train"])
@pytest.mark.parametrize("limits", [{}, {"max_group_rows": 25}, {"max_item_rows": 4}, {"max_group_rows": 25, "max_item_rows": 4}])
def test_same_rows_as_with_broadcasts(random_ratings, small_items, no_broadcast, scope_of, limits):
    plain = feature_plan.build(random_ratings, small_items, replace(PLAIN, feature_scope=scope_of))
    other = feature_plan.build(random_ratings, small_items, replace(BUCKETED, feature_scope=scope_of, **limits))
    # Rows equal in all of a history's order may change places: they are told apart by nothing.
    columns = [c for c in plain.interactions.columns if c not in ("split", "rating", "rating_deviation")]
    want = exact(plain.interactions.select(columns))
    assert len(want) > 500
    assert exact(other.interactions.select(columns)) == want
    if scope_of == "all":
        assert exact(other.users) == exact(plain.users)
        assert exact(other.items) == exact(plain.items)
        sizes = lambda t: Counter((r["userId"], r["split"]) for r in t.interactions.collect())
        assert sizes(other) == sizes(plain)


def test_ratings_are_shuffled_once_after_the_split(random_ratings, small_items, no_broadcast):
    text = plan_text(feature_plan.build(random_ratings, small_items, BUCKETED).interactions)
    assert text.count("Bucketed: true") == 2
    # One exchange of the ratings and one of the items, both by item; none by user.
    assert text.count("Exchange hashpartitioning(movieId") == text.count("Exchange ") == 2
    assert "Broadcast" not in text and "Python" not in text


def test_dealing_out_items_adds_no_shuffle_of_ratings(random_ratings, small_items, no_broadcast):
    text = plan_text(feature_plan.build(random_ratings, small_items, replace(BUCKETED, max_item_rows=4)).interactions)
    # The short list of hot items is broadcast to both sides.
    assert text.count("Exchange hashpartitioning(movieId") == text.count("Exchange hashpartitioning") == 2
    assert "_part" in text


def test_small_tables_are_broadcast_and_ratings_stay(random_ratings, small_items, no_broadcast):
    text = plan_text(feature_plan.build(random_ratings, small_items, PLAIN).interactions)
    assert text.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in text


def test_sums_by_user_stay_in_their_buckets(spark, random_ratings, small_items):
    histories, small_items = stage_bucketed(random_ratings, "ratings", "userId", bucket_count(spark, 720, 100)), stage(small_items, "items")
    text = plan_text(features.user_features(histories, small_items))
    assert "Bucketed: true" in text and "hashpartitioning(userId" not in text
    assert exact(features.user_features(histories, small_items)) == exact(features.user_features(random_ratings, small_items))


def test_hot_keys_are_dealt_out(spark):
    rng = np.random.default_rng(4)
    keys = [None] * 50 + [7] * 3_000 + [8] * 400 + rng.integers(20, 60, 500).tolist() + [99]
    rows = stage(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "movieId int, n int"), "rows")
    side = spark.createDataFrame([(k, f"s{k}") for k in (7, 8, *range(20, 60))], "movieId int, name string")
    counts = stage(rows.groupBy("movieId").agg(F.count("*").alias("_n")), "counts")
    got = features.join_by_parts(rows, side, "movieId", counts, 100)
    assert got.columns == ["movieId", "n", "name"]
    want = [(k, i, None if k in (None, 99) else f"s{k}") for i, k in enumerate(keys)]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    hot = counts.where("_n > 100 AND movieId IS NOT NULL").select("movieId", F.ceil(F.col("_n") / 100).cast("int").alias("_parts"))
    most = features.dealt(rows, "movieId", hot).where("movieId IS NOT NULL").groupBy("movieId", "_part").count().agg(F.max("count")).first()[0]
    # 30 parts of 100 rows each, give or take what hashing does.
    assert most < 160


def test_keys_without_rows_and_empty_tables(spark):
    rows = stage(spark.createDataFrame([], "movieId int, n int"), "rows")
    side = spark.createDataFrame([(1, "a")], "movieId int, name string")
    counts = stage(rows.groupBy("movieId").agg(F.count("*").alias("_n")), "counts")
    assert features.join_by_parts(rows, side, "movieId", counts, 1).collect() == []
    empty = spark.createDataFrame([], RATINGS)
    tables = feature_plan.build(empty, spark.createDataFrame([], "movieId int, title string, genres string"), replace(BUCKETED, max_broadcast_rows=-1))
    assert tables.interactions.collect() == [] and tables.users.collect() == []


def test_buckets_follow_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bucket_count(spark, 0, 10) == bucket_count(spark, 1, 10) == least
    assert bucket_count(spark, 1_001, 10) == 101
    assert bucket_count(spark, 10**13, 10) == int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))


def test_files_and_catalogue_are_left_clean(spark, random_ratings):
    with scope(spark):
        kept = stage_bucketed(random_ratings, "ratings", "userId", 5)
        assert kept.count() == 720
        folder = kept.inputFiles()[0].rsplit("/", 1)[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert files.exists(path)
    assert not files.exists(path)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("rankloom_stage")]


def test_job_with_buckets_writes_the_same_outputs(spark, random_ratings, small_items, tmp_path, no_broadcast):
    facts = {}
    for name, config in (("plain", PLAIN), ("bucketed", replace(BUCKETED, max_group_rows=25, max_item_rows=4))):
        facts[name] = feature_plan.run(random_ratings, small_items, str(tmp_path / name), config, checked=False)
    assert facts["plain"] == facts["bucketed"]
    assert len(spark.read.parquet(str(tmp_path / "bucketed" / "interactions")).columns) == len(schemas.INTERACTIONS)
