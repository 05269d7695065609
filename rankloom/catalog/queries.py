"""One callable per operator: (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalog import parameters as P
from rankloom.config import COVERAGE_USERS, FeatureConfig, RANK_CUTOFFS
from rankloom.operators import (
    batches,
    cold_start,
    drift,
    features,
    fitting,
    indexing,
    manifest,
    metrics,
    models,
    quality,
    ranking,
    runs,
    sampling,
    scoring,
    splitting,
    strata,
)
from rankloom.operators.learners import MatrixLearner, NetworkLearner
from rankloom.plans import feature_plan, monitoring_plan, training_plan
from rankloom.sources import binding
from rankloom.sources.staging import stage, stage_all, stage_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CONFIG = FeatureConfig(
    min_user_ratings=P.MIN_USER, min_item_ratings=P.MIN_ITEM, tie_columns=binding.TIE_COLUMNS
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """DOUBLE columns rounded, so sums taken in another order compare equal.

    Six digits; three for a mean of epoch seconds, which has nine before the point.
    """
    digits = {"user_avg_timestamp": 3}
    return df.withColumns({n: F.round(n, digits.get(n, 6)) for n, t in df.dtypes if t == "double"})


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return cold_start.filter_stored(binding.ratings(spark, folder), P.MIN_USER, P.MIN_ITEM)[0]


def _split(spark: SparkSession, folder: str) -> DataFrame:
    """(user_idx, item_idx, timestamp, split) of kept ratings.

    Ratings move with these columns alone: rows that tie in time and item are equal in all of
    them, so the rest of the history's order decides nothing. Users are indexed before the
    split, whose shuffle by user serves both.
    """
    ratings = binding.ratings(spark, folder).select("userId", "movieId", "timestamp")
    kept, per_user, _ = cold_start.filter_stored(ratings, P.MIN_USER, P.MIN_ITEM)
    users, items = stage_all(
        users=indexing.index_map(kept, "userId", "user_idx"), items=indexing.index_map(kept, "movieId", "item_idx")
    )
    split = splitting.temporal_split(kept.join(users, "userId"), user_counts=per_user)
    return stage(split.join(items, "movieId").select("user_idx", "item_idx", "timestamp", "split"), "interactions")


def _n_items(interactions: DataFrame) -> int:
    return indexing.index_bounds(interactions).first()["n_items"]


def _factors(ids: DataFrame, column: str, side: str, dim: int, name: str = "features") -> DataFrame:
    n = F.col(column).cast("bigint")
    terms = [
        ((n * m + a) % q - q // 2) / F.lit(P.SCALE) for m, a, q in P.vector_terms(side, dim)
    ]
    return ids.select(
        F.col(column).alias("id"),
        F.array(*terms).cast("array<float>").alias(name),
        ((n % 7 - 3) / F.lit(P.SCALE)).cast("float").alias("bias"),
    )


def _factor_tables(interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    users = interactions.select("user_idx").distinct()
    items = interactions.select("item_idx").distinct()
    return _factors(users, "user_idx", "user", P.MF_DIM), _factors(items, "item_idx", "item", P.MF_DIM)


def _towers(ids: DataFrame, column: str, side: str) -> DataFrame:
    both = _factors(ids, column, side, 2 * P.NCF_DIM)
    return both.select(
        "id",
        F.slice("features", 1, P.NCF_DIM).alias("gmf"),
        F.slice("features", P.NCF_DIM + 1, P.NCF_DIM).alias("mlp"),
    )


def _network() -> scoring.FusionNetwork:
    layers = tuple(scoring.DenseLayer(**w, epsilon=P.NCF_EPSILON) for w in P.dense_weights())
    return scoring.FusionNetwork(layers, P.output_weights(), P.OUTPUT_BIAS)


def _scored_candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    interactions = _split(spark, folder)
    candidates = sampling.eval_candidates(interactions, _n_items(interactions))
    users, items = _factor_tables(interactions)
    return scoring.mf_score(candidates, users, items, P.MF_INTERCEPT, P.MF_DIM), interactions


def _eras(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    """Monitored feature values of the ratings before, and from, the dividing epoch."""
    ratings = binding.ratings(spark, folder).select("userId", "movieId", "rating", "timestamp")
    items = binding.items(spark, folder)
    early = F.col("timestamp") < P.DRIFT_EPOCH
    parts = stage_all(early=ratings.where(early), late=ratings.where(~early))
    values = [
        features.distributions(features.user_features(p, items), features.item_features(p, items))
        for p in parts
    ]
    return stage_all(baseline=values[0], current=values[1])


def _fitted(spark: SparkSession, folder: str) -> training_plan.TrainingData:
    return training_plan.prepare(_split(spark, folder))


# --- loading and quality -------------------------------------------------------


@query
def load_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return binding.ratings(spark, folder)


@query
def load_items(spark: SparkSession, folder: str) -> DataFrame:
    return binding.items(spark, folder)


@query
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.summary(binding.ratings(spark, folder))


@query
def quality_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicates(binding.ratings(spark, folder))


@query
def quality_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return quality.orphan_summary(binding.ratings(spark, folder), binding.items(spark, folder))


@query
def quality_year_range(spark: SparkSession, folder: str) -> DataFrame:
    return quality.year_histogram(binding.ratings(spark, folder))


@query
def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files and rows of the tables the engine reads; sizes and dates depend on the machine."""
    tables = [binding.table(spark, folder, t) for t in ("lineitem", "orders", "part", "events")]
    return reduce(DataFrame.unionByName, map(manifest.file_manifest, tables)).select("file_name", "n_rows")


# --- features ------------------------------------------------------------------


@query
def cold_start_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder)


@query
def user_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.user_features(stage(_kept(spark, folder), "kept"), binding.items(spark, folder)))


@query
def item_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.item_features(stage(_kept(spark, folder), "kept"), binding.items(spark, folder)))


@query
def interaction_features(spark: SparkSession, folder: str) -> DataFrame:
    kept, items = stage(_kept(spark, folder), "kept"), binding.items(spark, folder)
    users, catalogue = features.user_features(kept, items), features.item_features(kept, items)
    return rounded(features.interaction_features(kept, users, catalogue))


@query
def remap_ids(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.remap_ids(stage(_kept(spark, folder), "kept"))[0]


@query
def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.temporal_split(stage(_kept(spark, folder), "kept"), order=CONFIG.history_order)


@query
def split_manifest(spark: SparkSession, folder: str) -> DataFrame:
    kept = stage(_kept(spark, folder), "kept")
    return manifest.split_manifest(stage(splitting.temporal_split(kept, order=CONFIG.history_order), "split"))


@query
def feature_distributions(spark: SparkSession, folder: str) -> DataFrame:
    kept, items = stage(_kept(spark, folder), "kept"), binding.items(spark, folder)
    return rounded(
        features.distributions(features.user_features(kept, items), features.item_features(kept, items))
    )


@query
def enriched_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """All feature stages in one plan: filter, features, indices, split."""
    tables = feature_plan.build(binding.ratings(spark, folder), binding.items(spark, folder), CONFIG)
    return rounded(tables.interactions)


@query
def enriched_interactions_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the plan for tables too large to broadcast: histories and users bucketed by
    user, long histories apart, hot items dealt out."""
    config = replace(CONFIG, max_broadcast_rows=0, max_group_rows=P.LONG_HISTORY, max_item_rows=P.HOT_ITEM)
    tables = feature_plan.build(binding.ratings(spark, folder), binding.items(spark, folder), config)
    return rounded(tables.interactions)


@query
def train_scope_features(spark: SparkSession, folder: str) -> DataFrame:
    """User features that see the training part of each history only."""
    config = FeatureConfig(P.MIN_USER, P.MIN_ITEM, feature_scope="train", tie_columns=binding.TIE_COLUMNS)
    tables = feature_plan.build(binding.ratings(spark, folder), binding.items(spark, folder), config)
    return rounded(tables.users)


# --- sampling ------------------------------------------------------------------


@query
def index_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.index_bounds(indexing.remap_ids(stage(_kept(spark, folder), "kept"))[0])


@query
def row_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed-size sample of all ratings, split 80/20 at random."""
    keys = list(binding.TIE_COLUMNS)
    rows = sampling.sample_rows(stage(binding.ratings(spark, folder), "ratings"), P.SAMPLE_ROWS, keys)
    return sampling.random_split(rows, keys, seed=P.SPLIT_SEED)


@query
def seen_pairs(spark: SparkSession, folder: str) -> DataFrame:
    interactions = _split(spark, folder)
    return sampling.seen_pairs(interactions.where("split = 'train'"), interactions.where("split = 'val'"))


@query
def negative_samples(spark: SparkSession, folder: str) -> DataFrame:
    interactions = _split(spark, folder)
    return sampling.negative_samples(interactions, _n_items(interactions))


@query
def labelled_splits(spark: SparkSession, folder: str) -> DataFrame:
    interactions = _split(spark, folder)
    return sampling.labelled_splits(interactions, _n_items(interactions))


@query
def training_batches(spark: SparkSession, folder: str) -> DataFrame:
    interactions = _split(spark, folder)
    train = interactions.where("split = 'train'")
    labelled = sampling.negative_samples(train, _n_items(interactions))
    return batches.training_batches(stage(labelled, "labelled"))


@query
def eval_candidates(spark: SparkSession, folder: str) -> DataFrame:
    interactions = _split(spark, folder)
    return sampling.eval_candidates(interactions, _n_items(interactions))


@query
def eval_candidates_capped(spark: SparkSession, folder: str) -> DataFrame:
    interactions = _split(spark, folder)
    return sampling.eval_candidates(interactions, _n_items(interactions), max_users=P.CAPPED_USERS)


# --- scoring and ranking -------------------------------------------------------


@query
def mf_score(spark: SparkSession, folder: str) -> DataFrame:
    interactions, _, _ = indexing.remap_ids(stage(_kept(spark, folder), "kept"))
    users, items = _factor_tables(interactions)
    pairs = interactions.select("user_idx", "item_idx")
    return rounded(scoring.mf_score(pairs, users, items, P.MF_INTERCEPT, P.MF_DIM))


@query
def ncf_score(spark: SparkSession, folder: str) -> DataFrame:
    interactions, user_map, item_map = indexing.remap_ids(stage(_kept(spark, folder), "kept"))

    pairs = interactions.select("user_idx", "item_idx")
    users, items = _towers(user_map, "user_idx", "user"), _towers(item_map, "item_idx", "item")
    return rounded(scoring.ncf_score(pairs, users, items, _network()))


@query
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    interactions = _split(spark, folder)
    labelled = sampling.labelled_splits(interactions, _n_items(interactions)).drop("split")
    users, items = _factor_tables(interactions)
    scored = scoring.mf_score(labelled, users, items, P.MF_INTERCEPT, P.MF_DIM)
    return rounded(metrics.binary_metrics(scored))


@query
def hit_rate_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.hit_rate_at_k(_scored_candidates(spark, folder)[0], 10))


@query
def ndcg_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.ndcg_at_k(_scored_candidates(spark, folder)[0], 10))


@query
def rank_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scored, _ = _scored_candidates(spark, folder)
    return rounded(ranking.rank_metrics(ranking.user_ranks(scored), RANK_CUTOFFS))


@query
def top_items(spark: SparkSession, folder: str) -> DataFrame:
    interactions, _, _ = indexing.remap_ids(stage(_kept(spark, folder), "kept"))
    return rounded(ranking.top_items(*_factor_tables(interactions), sample_users=COVERAGE_USERS))


@query
def coverage_at_k(spark: SparkSession, folder: str) -> DataFrame:
    interactions, _, item_map = indexing.remap_ids(stage(_kept(spark, folder), "kept"))
    top = ranking.top_items(*_factor_tables(interactions), sample_users=COVERAGE_USERS)
    return rounded(ranking.coverage(top, item_map.count()))


@query
def ncf_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of the network's own top lists."""
    _, user_map, item_map = indexing.remap_ids(stage(_kept(spark, folder), "kept"))
    towers = _towers(user_map, "user_idx", "user"), _towers(item_map, "item_idx", "item")
    return ranking.coverage(ranking.top_items(*towers, sample_users=COVERAGE_USERS, score=ranking.network_scores(_network())), item_map.count())


@query
def ranking_report(spark: SparkSession, folder: str) -> DataFrame:
    scored, interactions = _scored_candidates(spark, folder)
    top = ranking.top_items(*_factor_tables(interactions), sample_users=COVERAGE_USERS)
    return ranking.ranking_report(scored, top, _n_items(interactions))


# --- estimators ----------------------------------------------------------------


def _fit_facts(model: models.FactorModel | models.NcfModel | models.NetworkModel, data: training_plan.TrainingData) -> DataFrame:
    """What must hold of any fit: every validation row has a probability, and the training
    rows are explained better than by their rate of positives alone."""
    scored = model.score(data.validation).agg(
        F.count("score").alias("n_scored"), F.bool_and(F.col("score").between(0, 1)).alias("in_range")
    )
    rate = data.train.agg(F.avg("label")).scalar()
    constant = -(rate * F.log(rate) + (1 - rate) * F.log(1 - rate))
    loss = metrics.binary_metrics(model.score(data.train)).select((F.col("log_loss") < constant).alias("beats_constant"))
    return scored.crossJoin(loss)


@query
def mf_fit(spark: SparkSession, folder: str) -> DataFrame:
    data = _fitted(spark, folder)
    model = models.fit_mf(data.train, data.n_users, data.n_items, dim=8, max_iter=6)
    ids = spark.range(1).select(model.users.agg(F.count_distinct("id")).scalar().alias("n_users"), model.items.agg(F.count_distinct("id")).scalar().alias("n_items"))
    return ids.crossJoin(_fit_facts(model, data))


@query
def als_fit(spark: SparkSession, folder: str) -> DataFrame:
    data = _fitted(spark, folder)
    model = models.fit_als(data.train.where("label = 1"), dim=16, max_iter=5)
    report = training_plan.evaluate(model, data)
    # The other rows are numbers of users.
    shares = F.col("metric").contains("@") & ~F.col("metric").endswith("users")
    return report.agg(
        F.max(F.when(F.col("metric") == "n_users", F.col("value"))).cast("bigint").alias("n_users"),
        F.count_if(shares).alias("n_metrics"),
        F.bool_and(F.when(shares, F.col("value").between(0, 1))).alias("in_range"),
    )


@query
def ncf_fit(spark: SparkSession, folder: str) -> DataFrame:
    data = _fitted(spark, folder)
    factors = models.fit_als(data.train.where("label = 1"), dim=8, max_iter=5)
    return _fit_facts(models.fit_ncf(data.train, factors, hidden=(32, 16), max_iter=20), data)


@query
def mf_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Loss and accuracy of one pass over all training pairs, a cell a minibatch, from factors
    that are functions of the indices."""
    data = _fitted(spark, folder)
    learner = MatrixLearner(P.PASS_DIM, P.PASS_L2, batch_rows=strata.CELL_PAIRS)
    cells = strata.Cells.of(data.train, P.PASS_BLOCKS)
    ids = [spark.range(n).withColumnRenamed("id", "n") for n in (data.n_users, data.n_items)]
    given = [
        _factors(df, "n", side, P.PASS_DIM).select("id", F.concat("features", F.array("bias")).alias("given"))
        for df, side in zip(ids, ("user", "item"), strict=True)
    ]
    start = strata.start_from(*given, np.array([P.MF_INTERCEPT, 0.0]), learner, cells, data.n_users, data.n_items)
    done = strata.run_pass(start, learner, cells, P.PASS_STEP, seed=0)
    row = [(done.n, round(done.loss / done.n, 5), round(done.correct / done.n, 5), round(float(done.shared[0]), 5))]
    return spark.createDataFrame(row, "n bigint, log_loss double, accuracy double, intercept double")


@query
def ncf_joint_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings and network trained together."""
    data = _fitted(spark, folder)
    learner = NetworkLearner(8, 8, (32, 16))
    path = f"{stage_root(spark)}/rankloom/run-{uuid.uuid4().hex}"
    found = fitting.fit(learner, data.train, data.validation, data.n_users, data.n_items, path, fitting.FitConfig(epochs=2, step=0.05))
    return _fit_facts(found.model, data)


@query
def fit_loop(spark: SparkSession, folder: str) -> DataFrame:
    """Steps per metric in the run log of a watched run."""
    data = _fitted(spark, folder)
    path = f"{stage_root(spark)}/rankloom/run-{uuid.uuid4().hex}"
    config = fitting.FitConfig(epochs=P.LOOP_EPOCHS)
    fitting.fit(MatrixLearner(8), data.train, data.validation, data.n_users, data.n_items, path, config, log=f"{path}/log")
    return runs.training_curves(runs.read_log(spark, f"{path}/log")).select("metric", "n_steps")


# --- monitoring and runs -------------------------------------------------------


@query
def psi(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(drift.psi(*_eras(spark, folder)))


@query
def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    return drift.drift_report(*_eras(spark, folder))


@query
def drift_gate(spark: SparkSession, folder: str) -> DataFrame:
    return drift.drift_gate(drift.drift_report(*_eras(spark, folder)))


@query
def training_curves(spark: SparkSession, folder: str) -> DataFrame:
    return runs.training_curves(binding.run_metrics(spark, folder))


@query
def run_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return runs.leaderboard(binding.run_metrics(spark, folder))


@query
def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    return runs.latest_version(binding.model_versions(spark, folder))


@query
def production_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return runs.production_metrics(binding.run_metrics(spark, folder), binding.model_versions(spark, folder))


@query
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Newest registered run against the one in production."""
    log, versions = binding.run_metrics(spark, folder), binding.model_versions(spark, folder)
    newest = runs.latest_version(versions).select("run_id")
    candidate = runs.last_values(log.where(F.col("run_id") == newest.scalar())).select("metric", "value")
    return rounded(runs.model_comparison(runs.production_metrics(log, versions), candidate))


@query
def promotion_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Every run as a candidate against the run in production."""
    log, versions = binding.run_metrics(spark, folder), binding.model_versions(spark, folder)
    return runs.promotion_gate(runs.last_values(log), runs.production_metrics(log, versions))


@query
def promotion_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Promotion gate and drift gate together."""
    log, versions = binding.run_metrics(spark, folder), binding.model_versions(spark, folder)
    return monitoring_plan.decide(
        *_eras(spark, folder),
        runs.last_values(log),
        runs.production_metrics(log, versions),
    )
