"""Chronological train / validation / test split inside every user's history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import MAX_GROUP_ROWS, TRAIN_FRACTION, VAL_FRACTION
from rankloom.operators.cold_start import key_counts
from rankloom.sources.staging import broadcast_if_small, stage

#: Fewest rows of a partition of long histories; it holds as many ranges as their size asks for.
RANGE_ROWS = 131_072


def _label(position: Column, total: Column, train: float, val: float) -> Column:
    return (
        F.when(position <= F.floor(total * F.lit(train)), "train")
        .when(position <= F.floor(total * F.lit(train + val)), "val")
        .otherwise("test")
    )


def temporal_split(
    df: DataFrame,
    train_fraction: float = TRAIN_FRACTION,
    val_fraction: float = VAL_FRACTION,
    *,
    user: str = "userId",
    order: Sequence[str] = ("timestamp", "movieId"),
    user_counts: DataFrame | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``split``: the first 80 % of a user's rows train, the next 10 % validate.

    ``order`` lists columns of any sortable type that should order each history totally, so
    a row never depends on how ties happen to fall. Users of up to ``max_group_rows`` rows
    are ranked by a window. Histories that must not sit in one task are dealt out in ranges
    of their order and numbered across them; either way the parts have the same sizes and,
    where the order is total, the same rows. ``user_counts`` (user, _n) saves counting rows
    per user again; counts of a larger table serve too, they only decide which way a user
    takes.
    """
    usual, large = split_parts(
        df, train_fraction, val_fraction, user=user, order=order, user_counts=user_counts, max_group_rows=max_group_rows
    )
    return usual if large is None else usual.unionByName(large)


def split_parts(
    df: DataFrame,
    train_fraction: float = TRAIN_FRACTION,
    val_fraction: float = VAL_FRACTION,
    *,
    user: str = "userId",
    order: Sequence[str] = ("timestamp", "movieId"),
    user_counts: DataFrame | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    buckets: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The two parts of :func:`temporal_split`: histories of up to ``max_group_rows`` rows, and
    longer ones (``None`` if there are none).

    With ``buckets`` the first part is shuffled into as many partitions by user, so that it
    can be staged in buckets without another shuffle.
    """
    counts = user_counts if user_counts is not None else key_counts(df, user)
    large = counts.where(F.col("_n") > max_group_rows).select(user)
    if large.isEmpty():
        return _split_by_window(df, user, order, train_fraction, val_fraction, buckets), None
    large = broadcast_if_small(stage(large, "large-users"))
    usual = _split_by_window(
        df.join(large, user, "left_anti"), user, order, train_fraction, val_fraction, buckets
    )
    rows = stage(df.join(large, user, "left_semi"), "large-histories")
    return usual, _split_by_ranges(rows, user, order, train_fraction, val_fraction, max_group_rows)


def _split_by_window(
    df: DataFrame, user: str, order: Sequence[str], train: float, val: float, buckets: int | None = None
) -> DataFrame:
    if buckets:
        df = df.repartition(buckets, user)
    history = Window.partitionBy(user)
    placed = df.withColumn("_place", F.row_number().over(history.orderBy(*order)))
    sized = placed.withColumn("_total", F.count("*").over(history))
    labelled = sized.withColumn("split", _label(F.col("_place"), F.col("_total"), train, val))
    return labelled.drop("_place", "_total")


def _split_by_ranges(
    df: DataFrame, user: str, order: Sequence[str], train: float, val: float, max_group_rows: int
) -> DataFrame:
    """The split of large users: a range partitioning sorts them, and positions are the rows
    of the ranges before plus the place inside the own range.

    A range has at most half of ``max_group_rows`` rows. Partitions are cut into ranges where
    ranges are small, so that tasks and files follow the rows. Equal rows are told apart by a number each row gets from its place in the staged table,
    so that a crowd of ties is cut into ranges as well.
    """
    size = max(1, max_group_rows // 2)
    parts = max(2, -(-df.count() // max(size, RANGE_ROWS)))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(parts, user, *order, "_tie").sortWithinPartitions(user, *order, "_tie")
    # Partition in the upper bits, row of the sorted partition in the lower ones.
    ranged = stage(ordered.withColumn("_range", F.floor(F.monotonically_increasing_id() / size)), "ranges")
    # One row per user and range.
    counts = ranged.groupBy(user, "_range").agg(F.count("*").alias("_rows"))
    ranges = Window.partitionBy(user).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns(
        {
            "_before": F.coalesce(F.sum("_rows").over(ranges), F.lit(0)),
            "_total": F.sum("_rows").over(Window.partitionBy(user)),
        }
    ).drop("_rows")
    inside = Window.partitionBy(user, "_range").orderBy(*order, "_tie")
    placed = ranged.withColumn("_place", F.row_number().over(inside)).join(starts, [user, "_range"])
    place = F.col("_before") + F.col("_place")
    return placed.withColumn("split", _label(place, F.col("_total"), train, val)).select(*df.columns, "split")
