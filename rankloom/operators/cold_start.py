"""Removal of users and items with too little history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import MIN_ITEM_RATINGS, MIN_USER_RATINGS
from rankloom.sources.staging import broadcast_if_small, stage, stage_all

# Rare keys that are broadcast: a column of integers.
MAX_RARE_ROWS = 1_000_000


def key_counts(ratings: DataFrame, key: str) -> DataFrame:
    """(key, _n): ratings per key. Map-side sums absorb hot keys."""
    return ratings.groupBy(key).agg(F.count("*").alias("_n"))


def filter_cold_start(
    ratings: DataFrame,
    min_user: int = MIN_USER_RATINGS,
    min_item: int = MIN_ITEM_RATINGS,
    *,
    user_counts: DataFrame | None = None,
    item_counts: DataFrame | None = None,
) -> DataFrame:
    """Keep ratings whose user and item are both frequent enough in the *input*.

    One pass, not an iterated core: a survivor may end below a threshold. The rare
    keys are anti-joined rather than the frequent ones semi-joined, because that
    list holds no hot key and is usually the short one. ``user_counts`` and
    ``item_counts`` are staged :func:`key_counts`; with them the list's length is
    known before the join, and a short list is broadcast so that ratings stay where
    they are.
    """
    kept = ratings.where("userId IS NOT NULL AND movieId IS NOT NULL")
    for key, minimum, counts in (("userId", min_user, user_counts), ("movieId", min_item, item_counts)):
        source = key_counts(ratings, key) if counts is None else counts
        rare = source.where(F.col("_n") < minimum).select(key)
        kept = kept.join(rare if counts is None else broadcast_if_small(rare, MAX_RARE_ROWS), key, "left_anti")
    return kept.select(ratings.columns)


def filter_stored(
    ratings: DataFrame, min_user: int = MIN_USER_RATINGS, min_item: int = MIN_ITEM_RATINGS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`filter_cold_start` of ratings that are dear to compute: they are staged once, and
    both counts and every reader of the result scan the stage table. Also returns the counts."""
    ratings = stage(ratings, "ratings")
    per_user, per_item = stage_all(user_counts=key_counts(ratings, "userId"), item_counts=key_counts(ratings, "movieId"))
    return filter_cold_start(ratings, min_user, min_item, user_counts=per_user, item_counts=per_item), per_user, per_item
