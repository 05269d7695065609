from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.config import BATCH_ROWS
from rankloom.operators import batches, sampling
from rankloom.sources.staging import stage
from tests.conftest import PAIRS, plan_text


def pairs_of(spark, seed, n_users=12, n_items=60, n=300):
    rng = np.random.default_rng(seed)
    rows = list(zip(rng.integers(0, n_users, n).tolist(), rng.integers(0, n_items, n).tolist(), strict=True))
    return rows, spark.createDataFrame(rows, PAIRS)


def by_user(rows):
    out = defaultdict(list)
    for u, i in rows:
        out[u].append(i)
    return out


@pytest.mark.parametrize("n_items", [1, 2, 6, 97, 2_310, 65_537, 1_000_003])
def test_walk_domain_is_close_and_balanced(n_items):
    low, high = sampling.walk_shape(n_items)
    assert n_items <= low * high <= n_items + sampling.WALK_SPARE
    assert low <= high and low >= min(n_items, 2)


@pytest.mark.parametrize("n_items", [1, 5, 97, 1_009])
def test_walk_is_a_permutation_and_its_inverse(spark, n_items):
    walk = sampling.Walk(n_items, 11)
    steps = spark.range(walk.size).select(F.lit(4).alias("user_idx"), F.col("id").alias("k"))
    rows = walk.with_step(walk.with_item(steps, "k")).collect()
    assert sorted(r["item_idx"] for r in rows) == list(range(walk.size))
    assert all(r["_step"] == r["k"] for r in rows)


def test_draws_of_a_user_are_no_lattice(spark):
    n, want = 1_000_003, 400
    users = spark.createDataFrame([(u, 0) for u in range(20)], PAIRS)
    got = by_user((r["user_idx"], r["item_idx"]) for r in sampling.negative_samples(users, n, want).where("label = 0").collect())
    gaps = {u: np.diff(sorted(items)) for u, items in got.items()}
    assert all(len(set(g.tolist())) > want * 0.9 for g in gaps.values())
    # Of uniform draws about a tenth of the gaps is below a tenth of their mean.
    share = np.mean([np.mean(g < n / want / 10) for g in gaps.values()])
    assert 0.06 < share < 0.14
    # Users share no more draws than chance lets them.
    both = [len(set(got[a]) & set(got[b])) for a in got for b in got if a < b]
    assert np.mean(both) < 1


def test_pairs_of_draws_are_uniform(spark):
    """Two draws of 12 free items: every pair about equally often."""
    users = spark.range(6_600).select(F.col("id").cast("int").alias("user_idx"), F.lit(0).alias("item_idx"))
    got = by_user((r["user_idx"], r["item_idx"]) for r in sampling.negative_samples(users, 13, 2).where("label = 0").collect())
    counts = Counter(tuple(sorted(i)) for i in got.values())
    assert len(counts) == 66
    assert sum((c - 100) ** 2 / 100 for c in counts.values()) < 130  # 65 degrees of freedom


@pytest.mark.parametrize("seed", [1, 42, 7_777])
@pytest.mark.parametrize("ratio", [1, 4])
def test_contract(spark, seed, ratio):
    rows, df = pairs_of(spark, seed)
    got = sampling.negative_samples(df, 60, ratio, seed=seed).collect()
    assert Counter((r["user_idx"], r["item_idx"]) for r in got if r["label"] == 1.0) == Counter(rows)
    negatives = by_user((r["user_idx"], r["item_idx"]) for r in got if r["label"] == 0.0)
    for user, items in by_user(rows).items():
        seen = set(items)
        drawn = negatives[user]
        assert len(drawn) == min(ratio * len(seen), 60 - len(seen))
        assert len(set(drawn)) == len(drawn)
        assert not seen & set(drawn)
        assert all(0 <= i < 60 for i in drawn)


def test_seed_decides(spark):
    _, df = pairs_of(spark, 1, n_items=500)
    draws = [
        {tuple(r) for r in sampling.negative_samples(df, 500, 1, seed=s).where("label = 0").collect()}
        for s in (1, 1, 2)
    ]
    assert draws[0] == draws[1]
    assert draws[0] != draws[2]


def test_walk_order_equals_plain_rejection(spark):
    """The gaps between excluded steps are the first free steps of the walk."""
    n = 97
    rows, df = pairs_of(spark, 5, n_users=8, n_items=n, n=200)
    walk = sampling.Walk(n, 3)
    steps = df.select("user_idx").distinct().crossJoin(spark.range(walk.size).withColumnRenamed("id", "k"))
    order = by_user((r["user_idx"], r["item_idx"]) for r in walk.with_item(steps, "k").orderBy("user_idx", "k").collect())
    got = by_user(
        (r["user_idx"], r["item_idx"])
        for r in sampling.negative_samples(df, n, 2, seed=3).where("label = 0").collect()
    )
    for user, items in by_user(rows).items():
        free = [i for i in order[user] if i < n and i not in set(items)]
        assert sorted(got[user]) == sorted(free[: 2 * len(set(items))])


def test_users_who_have_seen_everything(spark):
    df = spark.createDataFrame([(0, i) for i in range(5)] + [(1, 0)], PAIRS)
    got = by_user(
        (r["user_idx"], r["item_idx"])
        for r in sampling.negative_samples(df, 5, 4).where("label = 0").collect()
    )
    assert got.keys() == {1}
    assert sorted(got[1]) == [1, 2, 3, 4]
    one = sampling.negative_samples(spark.createDataFrame([(0, 0)], PAIRS), 1, 4)
    assert [tuple(r) for r in one.collect()] == [(0, 0, 1.0)]


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_long_walks_in_stretches(spark, stretch):
    """A user of a third of all rows; tasks never order more than ``stretch`` steps."""
    _, some = pairs_of(spark, 9, n_items=900, n=300)
    hot = spark.range(150).select(F.lit(99).alias("user_idx"), (F.col("id") * 5).cast("int").alias("item_idx"))
    df = some.unionByName(hot)
    plain = sampling.negative_samples(df, 900, 4)
    cut = sampling.negative_samples(df, 900, 4, max_group_rows=stretch)
    assert plain.exceptAll(cut).isEmpty()
    assert cut.exceptAll(plain).isEmpty()


def test_only_long_users_walk_in_stretches(spark):
    """A long catalogue alone is no reason for joins and a second reading of the pairs."""
    _, some = pairs_of(spark, 9, n_items=900, n=300)
    assert "Join" not in plan_text(sampling.negative_samples(some, 900, 4, max_group_rows=200))
    hot = spark.range(180).select(F.lit(99).alias("user_idx"), (F.col("id") * 5).cast("int").alias("item_idx"))
    df = stage(some.unionByName(hot), "pairs")
    assert [tuple(r) for r in sampling.long_users(df, ["user_idx"], 100).collect()] == [(99,)]
    assert sampling.long_users(df, ["user_idx"], 180) is None
    cut, plain = (sampling.negative_samples(df, 900, 4, max_group_rows=most) for most in (200, 5_000_000))
    assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty()


def test_long_walks_where_partitions_are_unlike(spark):
    """Nothing is broadcast, and the parts of a union end in unlike numbers of partitions."""
    rows = [(u, i * 7 % 900) for u in range(3_000) for i in range(u % 9 + 1)]
    df = stage(spark.createDataFrame(rows, PAIRS).repartition(8), "pairs")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        demand = df.distinct().groupBy("user_idx").agg(F.count("*").alias("n_excluded"), (F.count("*") * 4).alias("want"))
        drawn = sampling.sample_unseen(df.distinct(), demand, 900, max_group_rows=300)
        assert drawn.count() == 4 * len(set(rows)) and drawn.join(df, ["user_idx", "item_idx"]).isEmpty()
        assert sampling.negative_samples(df, 900, 4, max_group_rows=28).where("label = 0").count() == 4 * len(set(rows))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_draws_are_spread(spark):
    users = spark.range(2_000).select(F.col("id").cast("int").alias("user_idx"), F.lit(0).alias("item_idx"))
    counts = [r["count"] for r in sampling.negative_samples(users, 101, 5).where("label = 0").groupBy("item_idx").count().collect()]
    # 10,000 draws over 100 free items.
    assert len(counts) == 100
    assert max(counts) < 160 and min(counts) > 50


def test_draws_are_not_shuffled(spark):
    _, df = pairs_of(spark, 1)
    text = plan_text(sampling.negative_samples(df, 60, 4))
    # Operators above the generators come first in the plan.
    assert "Exchange" not in text[: text.index("Generate")]
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_pairs_move_twice(spark):
    """Once to drop their repeats, once by user; no join."""
    _, df = pairs_of(spark, 1)
    text = plan_text(sampling.sample_in_proportion(sampling.distinct_pairs(df), F.lit(4), 60))
    assert text.count("Exchange") == 2 and "Join" not in text


@pytest.mark.parametrize("n_items", [60, 61, 97])
def test_both_ways_draw_the_same(spark, n_items):
    _, df = pairs_of(spark, 2)
    pairs = stage(sampling.distinct_pairs(df), "pairs")
    near = sampling.sample_in_proportion(pairs, F.lit(4), n_items)
    far = sampling.sample_in_proportion(pairs, F.lit(4), n_items, max_group_rows=20)
    assert near.exceptAll(far).isEmpty() and far.exceptAll(near).isEmpty() and not near.isEmpty()


def interactions(spark):
    rows = []
    for u in range(6):
        for t in range(20):
            rows.append((u, (u * 7 + t * 3) % 150, t, "train" if t < 16 else "val" if t < 18 else "test"))
    rows.append((6, 1, 5, "train"))
    rows.append((7, 9, 5, "test"))
    rows.append((7, 4, 5, "test"))
    return rows, spark.createDataFrame(rows, "user_idx int, item_idx int, timestamp bigint, split string")


def test_labelled_splits_use_their_own_positives(spark):
    rows, df = interactions(spark)
    got = sampling.labelled_splits(df, 150).collect()
    for split, ratio in (("train", 4), ("val", 1)):
        positives = {(u, i) for u, i, _, s in rows if s == split}
        part = [r for r in got if r["split"] == split]
        assert {(r["user_idx"], r["item_idx"]) for r in part if r["label"] == 1} == positives
        assert sum(r["label"] == 0 for r in part) == ratio * len(positives)


def test_eval_candidates(spark):
    rows, df = interactions(spark)
    got = sampling.eval_candidates(df, 150, 99).collect()
    held_out = {r["user_idx"]: r["item_idx"] for r in got if r["is_positive"]}
    # Users without test items are not evaluated; the smaller item wins a tie in time.
    assert held_out.keys() == {0, 1, 2, 3, 4, 5, 7}
    assert held_out[7] == 4
    assert all(held_out[u] == (u * 7 + 18 * 3) % 150 for u in range(6))
    others = by_user((r["user_idx"], r["item_idx"]) for r in got if not r["is_positive"])
    for u, drawn in others.items():
        seen = {i for v, i, _, s in rows if v == u and s != "test"}
        assert len(set(drawn)) == len(drawn) == 99
        assert not (seen | {held_out[u]}) & set(drawn)
    # No cap unless asked for.
    capped = sampling.eval_candidates(df, 150, 99, max_users=3)
    assert capped.select("user_idx").distinct().count() == 3
    # 30 items: fewer than 99 are left.
    short = sampling.eval_candidates(df.where("item_idx < 30"), 30, 99)
    assert short.where("NOT is_positive").groupBy("user_idx").count().agg(F.max("count")).first()[0] < 30


def test_batches(spark):
    rows = [(u, i, 1.0 if i < 3 else 0.0) for u in range(40) for i in range(30)]
    rows += [(1, 1, 1.0)] * 700  # one pair with over a third of all rows
    df = spark.createDataFrame(rows, "user_idx int, item_idx int, label float")
    got = batches.training_batches(df, 128).collect()
    assert Counter((r["user_idx"], r["item_idx"], r["label"]) for r in got) == Counter(rows)
    sizes = Counter(r["batch_id"] for r in got)
    assert sorted(sizes) == list(range(15))
    assert all(sizes[b] == 128 for b in range(14)) and sizes[14] == 1_900 - 14 * 128
    # Users are mixed: the first batch is no block of one user.
    assert len({r["user_idx"] for r in got if r["batch_id"] == 0}) > 5
    assert BATCH_ROWS == 4_096


@pytest.mark.parametrize("n", [0, 1, 700, 2_000, 5_000])
def test_row_sample(spark, n):
    df = spark.range(2_000).withColumn("twice", F.col("id") * 2)
    got = sampling.sample_rows(df, n, ["id"]).collect()
    assert len(got) == min(n, 2_000)
    assert len({r["id"] for r in got}) == len(got)
    assert sorted(got) == sorted(sampling.sample_rows(df.repartition(7), n, ["id"]).collect())


def test_random_split(spark):
    parts = sampling.random_split(spark.range(10_000), ["id"], 0.8)
    share = parts.where("split = 'train'").count() / 10_000
    assert share == pytest.approx(0.8, abs=0.02)
