"""Data-quality reports on the ratings table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import RATING_RANGE, YEAR_RANGE
from rankloom.functions.time import epoch_year


def summary(ratings: DataFrame) -> DataFrame:
    """One row: totals, rows without user, item or rating, rating range, ratings out of range, distinct users and items.

    The distinct counts come out of per-key partial sums, so the scan is not
    multiplied the way several ``count(distinct)`` in one aggregate would.
    """
    low, high = RATING_RANGE
    # The names of the report's columns.
    incomplete = F.col("userId").isNull() | F.col("movieId").isNull() | F.col("rating").isNull()
    per_user = ratings.groupBy("userId").agg(
        F.count("*").alias("n"),
        F.count_if(incomplete).alias("nulls"),
        F.count_if(~F.col("rating").between(low, high)).alias("outside"),
        F.min("rating").alias("lo"),
        F.max("rating").alias("hi"),
    )
    n_items = ratings.select("movieId").distinct().agg(F.count("movieId"))
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_ratings"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("ratings_null_count"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("ratings_out_of_range"),
        F.min("lo").alias("min_rating"),
        F.max("hi").alias("max_rating"),
        F.count("userId").alias("total_users"),
    ).withColumn("total_movies", n_items.scalar())


def duplicates(ratings: DataFrame) -> DataFrame:
    """(user, item, timestamp) triples that occur more than once, with their counts."""
    return (
        ratings.groupBy("userId", "movieId", "timestamp")
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
    )


def orphans(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Rated items that the item table lacks, with the number of ratings they hold.

    Ratings are counted per item before the anti join: at most one row per item moves.
    """
    rated = ratings.where("movieId IS NOT NULL").groupBy("movieId").agg(F.count("*").alias("n_ratings"))
    return rated.join(items.select("movieId"), "movieId", "left_anti")


def orphan_summary(ratings: DataFrame, items: DataFrame) -> DataFrame:
    return orphans(ratings, items).agg(
        F.count("*").alias("orphan_movie_ids"),
        F.coalesce(F.sum("n_ratings"), F.lit(0)).alias("orphan_ratings"),
    )


def year_histogram(ratings: DataFrame) -> DataFrame:
    """Ratings per UTC year; ``in_range`` tells whether the year is plausible."""
    first, last = YEAR_RANGE
    return (
        ratings.groupBy(epoch_year(F.col("timestamp")).alias("rating_year"))
        .agg(F.count("*").alias("n_ratings"))
        .withColumn("in_range", F.col("rating_year").between(first, last))
    )


def outside_years(ratings: DataFrame) -> DataFrame:
    """Ratings whose year is missing or implausible."""
    first, last = YEAR_RANGE
    plausible = epoch_year(F.col("timestamp")).between(first, last)
    return ratings.where(~F.coalesce(plausible, F.lit(False)))


def enforce(report: Mapping[str, object], *, min_rows: int = 0) -> None:
    """Raise when a :func:`summary` row (as a mapping) breaks the loading contract."""
    problems = []
    if report["total_ratings"] < min_rows:
        problems.append(f"{report['total_ratings']} ratings, expected at least {min_rows}")
    if report["ratings_null_count"]:
        problems.append(f"{report['ratings_null_count']} ratings without a user, item or rating")
    if report["ratings_out_of_range"]:
        problems.append(f"{report['ratings_out_of_range']} ratings outside {RATING_RANGE}")
    if problems:
        raise ValueError("; ".join(problems))


def enforce_items(items: DataFrame, *, min_rows: int = 1) -> int:
    """Number of items; raises when there are fewer than ``min_rows`` or one has no id."""
    row = items.agg(F.count("*").alias("n"), F.count_if(F.col("movieId").isNull()).alias("nulls")).first()
    if row["n"] < min_rows or row["nulls"]:
        raise ValueError(f"{row['n']} items, expected at least {min_rows}; {row['nulls']} of them without an id")
    return row["n"]
