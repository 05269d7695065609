"""Contiguous zero-based indices for user and item ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordering import dense_index
from rankloom.sources.staging import stage


def index_map(df: DataFrame, id_column: str, index_column: str) -> DataFrame:
    """(id, index) over the distinct ids of ``df``, which are staged: numbering reads them twice."""
    return dense_index(stage(df.select(id_column).distinct(), "ids"), id_column, index_column)


def remap_ids(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add ``user_idx`` and ``item_idx``; also return the two maps.

    Their row counts are the numbers of users and items.
    """
    users = index_map(df, "userId", "user_idx")
    items = index_map(df, "movieId", "item_idx")
    return df.join(users, "userId", "left").join(items, "movieId", "left"), users, items


def index_bounds(interactions: DataFrame) -> DataFrame:
    """One row (n_users, n_items): largest index plus one, over all splits given."""
    return interactions.agg(
        (F.max("user_idx") + 1).alias("n_users"), (F.max("item_idx") + 1).alias("n_items")
    )
