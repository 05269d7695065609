"""Raw ratings to indexed, split, feature-enriched interactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.config import SPLIT_STRATEGY, FeatureConfig
from rankloom.operators import quality
from rankloom.operators.cold_start import filter_cold_start, key_counts
from rankloom.operators.features import distributions, interaction_features, item_features, user_features
from rankloom.operators.ordering import dense_index
from rankloom.operators.splitting import split_parts
from rankloom.sources.staging import broadcast_if_small, bucket_count, is_small, scope, stage, stage_all, stage_bucketed
from rankloom.sources.writers import write_manifest, write_table


@dataclass(frozen=True)
class FeatureTables:
    """Lazy results of the feature plan; ``users`` and ``items`` carry the indices."""

    users: DataFrame
    items: DataFrame
    interactions: DataFrame

    @property
    def baseline(self) -> DataFrame:
        return distributions(self.users, self.items)


def build(
    ratings: DataFrame, items: DataFrame, config: FeatureConfig = FeatureConfig(), *, staged: bool = False, keep_ties: bool = True
) -> FeatureTables:
    """Compose the plan.

    Ratings are staged first unless they are ``staged`` already: they are read three times, and
    may be dear to compute. Then they move once: filtered, shuffled by user while they are still narrow,
    split, and written as a stage table. The files then hold whole histories, so
    the sums per user that follow are nearly finished before their shuffle. User and
    item tables carry features and index in one row, and interactions meet two joins
    in all.

    Where there are too many users to broadcast, histories and users are written in the same
    buckets by user: sums per user and the user join take no shuffle, and a shuffle by item is
    the only one that rows with features take. Histories of more than
    ``max_group_rows`` rows are no part of the buckets; their few users are attached apart.

    Tie columns order histories; without ``keep_ties`` they end with the split.
    """
    ratings = ratings.select(*schemas.RATINGS.names, *config.tie_columns)
    if not staged:
        ratings = stage(ratings, "ratings")
    per_user, per_item = stage_all(
        user_counts=key_counts(ratings, "userId"), item_counts=key_counts(ratings, "movieId")
    )
    kept = filter_cold_start(
        ratings,
        config.min_user_ratings,
        config.min_item_ratings,
        user_counts=per_user,
        item_counts=per_item,
    )
    buckets = None
    if not is_small(per_user, config.max_broadcast_rows):
        n_rows = per_user.agg(F.sum("_n")).first()[0] or 0
        buckets = bucket_count(ratings.sparkSession, n_rows, config.bucket_rows)
    usual, large = split_parts(
        kept,
        config.train_fraction,
        config.val_fraction,
        order=config.history_order,
        user_counts=per_user,
        max_group_rows=config.max_group_rows,
        buckets=buckets,
    )
    if not keep_ties:
        usual, large = (part if part is None else part.drop(*config.tie_columns) for part in (usual, large))
    if buckets is None:
        histories = stage(usual if large is None else usual.unionByName(large), "histories")
    else:
        usual = histories = stage_bucketed(usual, "histories", "userId", buckets)
        if large is not None:
            large = stage(large, "long-histories")
            histories = usual.unionByName(large)
    train_only = config.feature_scope == "train"
    source = histories.where("split = 'train'") if train_only else histories
    users, catalogue = user_features(source, items), item_features(source, items)
    if train_only:
        # Ids that only later splits contain get an index and no features.
        users = histories.select("userId").distinct().join(users, "userId", "left")
        catalogue = histories.select("movieId").distinct().join(catalogue, "movieId", "left")
    users, catalogue = dense_index(users, "userId", "user_idx"), dense_index(catalogue, "movieId", "item_idx")
    if buckets is None:
        users, catalogue = stage_all(users=users, items=catalogue)
    else:
        users, catalogue = stage_bucketed(users, "users", "userId", buckets), stage(catalogue, "items")

    few_items = is_small(catalogue, config.max_broadcast_rows)
    side = F.broadcast(catalogue) if few_items else catalogue

    def enriched(rows: DataFrame, of: DataFrame) -> DataFrame:
        counts = None if few_items else per_item
        return interaction_features(rows, of, side, item_counts=counts, group_rows=config.max_item_rows)

    if buckets is None:
        return FeatureTables(users, catalogue, enriched(histories, broadcast_if_small(users, config.max_broadcast_rows)))
    interactions = enriched(usual, users)
    if large is not None:
        # At most one user in max_group_rows ratings.
        names = per_user.where(F.col("_n") > config.max_group_rows).select("userId")
        busiest = broadcast_if_small(stage(users.join(names, "userId", "left_semi"), "busiest-users"))
        interactions = interactions.unionByName(enriched(large, busiest))
    return FeatureTables(users, catalogue, interactions)


def check(ratings: DataFrame, items: DataFrame) -> dict[str, object]:
    """The loading contract and the quality report of raw tables: raises when the contract
    is broken, otherwise reports what the later stages tolerate."""
    report = quality.summary(ratings).first().asDict()
    quality.enforce(report, min_rows=1)
    quality.enforce_items(items)
    repeated = quality.duplicates(ratings).agg(F.count("*").alias("n")).first()["n"]
    orphans = quality.orphan_summary(ratings, items).first()["orphan_movie_ids"]
    years = quality.outside_years(ratings).count()
    return {"n_raw_ratings": report["total_ratings"], "n_duplicates": repeated, "n_orphan_items": orphans, "n_outside_years": years}


def run(
    ratings: DataFrame,
    items: DataFrame,
    output: str,
    config: FeatureConfig = FeatureConfig(),
    *,
    checked: bool = True,
    quarantined: DataFrame | None = None,
    staged: bool = False,
) -> dict[str, object]:
    """Write all outputs of the plan below ``output`` and return the manifest.

    Ratings are staged once for the checks and the plan, unless they are ``staged`` already.

    With ``checked`` the raw tables must keep the loading contract first. ``quarantined``
    (line, reason) are the records that could not be read (``sources/quarantine.py``): they
    are written below quarantine/, one folder per reason, and counted in the manifest.

    interactions/   one table, one directory per split
    user_features/, item_features/, baseline_distributions/, feature_manifest/
    """
    spark = ratings.sparkSession
    with scope(spark):
        if not staged:
            ratings = stage(ratings, "ratings")
        found = check(ratings, items) if checked else {}
        facts = _write(build(ratings, items, config, staged=True, keep_ties=False), output)
    if quarantined is not None:
        one = F.count(F.lit(1))
        facts |= write_table(quarantined, f"{output}/quarantine", partition_by=["reason"], counts={"n_quarantined": one})
    facts |= found | {
        "split_strategy": SPLIT_STRATEGY,
        "train_frac": config.train_fraction,
        "val_frac": config.val_fraction,
        "test_frac": round(1 - config.train_fraction - config.val_fraction, 10),
        "min_user_ratings": config.min_user_ratings,
        "min_item_ratings": config.min_item_ratings,
    }
    write_manifest(spark, f"{output}/feature_manifest", facts)
    return facts


def _write(tables: FeatureTables, output: str) -> dict[str, object]:
    """Write the tables; every count comes out of the write itself."""
    split_counts = {f"{s}_count": F.count_if(F.col("split") == s) for s in ("train", "val", "test")}
    facts: dict[str, object] = dict(
        write_table(
            schemas.conform(tables.interactions, schemas.INTERACTIONS),
            f"{output}/interactions",
            partition_by=["split"],
            counts=split_counts,
        )
    )
    one = F.count(F.lit(1))
    users = schemas.conform(tables.users, schemas.USER_FEATURES)
    facts |= write_table(users, f"{output}/user_features", counts={"n_users": one})
    catalogue = schemas.conform(tables.items, schemas.ITEM_FEATURES)
    facts |= write_table(catalogue, f"{output}/item_features", counts={"n_items": one})
    write_table(tables.baseline, f"{output}/baseline_distributions")
    return facts
