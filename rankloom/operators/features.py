"""User, item and cross features of a ratings table."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import (
    MAX_ITEM_ROWS,
    MONITORED_ITEM_FEATURES,
    MONITORED_USER_FEATURES,
    POSITIVE_RATING,
    RECENCY_DECAY,
)
from rankloom.functions.time import epoch_day
from rankloom.operators.ordering import dense_rank_desc
from rankloom.schemas import ITEM_FEATURES, ITEM_JOIN_COLUMNS, USER_FEATURES, USER_JOIN_COLUMNS
from rankloom.sources.staging import broadcast_if_small, stage

GENRE_SEPARATOR = r"\|"
# Genre sets are kept as bits up to this vocabulary size (17 words per item), as rows beyond
# it; both forms give the same numbers.
MAX_GENRES = 1_024
BITS_PER_WORD = 63


def genres_of(column: str = "genres") -> Column:
    return F.split(column, GENRE_SEPARATOR)


def genre_words(items: DataFrame) -> DataFrame | None:
    """(movieId, _g0, _g1 ...): an item's genres as bits, 63 to a word.

    Genres are a small vocabulary, so a set of them fits in a few numbers and the
    genres of a user are the bitwise OR over their items. ``None`` when the
    vocabulary is larger than ``MAX_GENRES``.
    """
    vocabulary = items.select(F.explode(genres_of()).alias("genre")).distinct()
    # At most MAX_GENRES + 1 short strings reach the driver.
    found = sorted(r["genre"] for r in vocabulary.limit(MAX_GENRES + 1).collect())
    if len(found) > MAX_GENRES:
        return None
    own = F.array_distinct(genres_of())
    words = []
    for start in range(0, max(len(found), 1), BITS_PER_WORD):
        names = found[start : start + BITS_PER_WORD]
        bits = F.create_map(*[F.lit(x) for i, g in enumerate(names) for x in (g, 1 << i)]) if names else None
        word = F.lit(0).cast("bigint") if bits is None else _or_bits(own, bits)
        words.append(word.alias(f"_g{len(words)}"))
    # One row per item whatever the table holds: a repeated item must not repeat its ratings.
    merged = [F.bit_or(f"_g{i}").alias(f"_g{i}") for i in range(len(words))]
    return items.select("movieId", *words).groupBy("movieId").agg(*merged)


def _or_bits(genres: Column, bits: Column) -> Column:
    known = F.coalesce(genres, F.array().cast("array<string>"))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        known, zero, lambda acc, g: acc.bitwiseOR(F.coalesce(F.try_element_at(bits, g).cast("bigint"), zero))
    )


def genre_diversity(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct genres per user for vocabularies of any size.

    Ratings are exploded to genres before the shuffle, so that the map side can drop
    the repeats of users whose rows lie together.
    """
    rated = ratings.join(items.select("movieId", "genres"), "movieId")
    single = rated.select("userId", F.explode(genres_of()).alias("genre")).distinct()
    return single.groupBy("userId").agg(F.count("genre").cast("int").alias("user_genre_diversity"))


def user_features(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """One row per user: activity, taste and breadth, normally in a single aggregation."""
    when = F.col("timestamp")
    rated = F.count("rating")
    activity = [
        F.avg("rating").alias("user_avg_rating"),
        rated.cast("int").alias("user_rating_count"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("user_rating_stddev"),
        (epoch_day(F.max(when)) - epoch_day(F.min(when))).alias("user_active_days"),
        F.avg(when).alias("user_avg_timestamp"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("rating") >= POSITIVE_RATING), rated), F.lit(0.0)
        ).alias("user_positive_ratio"),
    ]
    words = genre_words(items)
    if words is None:
        users = ratings.groupBy("userId").agg(*activity)
        breadth = genre_diversity(ratings, items).withColumnRenamed("userId", "_user")
        # Null-safe: ratings without a user are a group of their own in both forms.
        users = users.join(breadth, F.col("userId").eqNullSafe(F.col("_user")), "left")
        return users.fillna(0, ["user_genre_diversity"]).select(USER_FEATURES.names)
    names = [c for c in words.columns if c != "movieId"]
    diversity = reduce(
        add, [F.coalesce(F.bit_count(F.bit_or(n)), F.lit(0)) for n in names]
    ).alias("user_genre_diversity")
    users = ratings.join(words, "movieId", "left").groupBy("userId").agg(*activity, diversity)
    return users.select(USER_FEATURES.names)


def item_features(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """One row per rated item: reception, recency, popularity."""
    reception = ratings.groupBy("movieId").agg(
        F.avg("rating").alias("item_avg_rating"),
        F.count("rating").alias("_n"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("item_rating_stddev"),
        F.max("timestamp").alias("_last"),
    )
    latest = ratings.agg(F.max("timestamp")).scalar()
    # Distinct counts sum to at most the number of ratings N, so there are fewer than
    # sqrt(2 N) of them; broadcast only where that is few.
    ranks = broadcast_if_small(stage(dense_rank_desc(reception, "_n", "item_popularity_rank"), "ranks"))
    # Repeated item rows must not multiply ratings later on.
    genre_counts = items.groupBy("movieId").agg(F.max(F.size(genres_of())).alias("item_genre_count"))
    return (
        reception.join(ranks, "_n")
        .join(genre_counts, "movieId", "left")
        .fillna(0, ["item_genre_count"])
        .withColumn("item_rating_count", F.col("_n").cast("int"))
        .withColumn("item_recency_score", F.exp(F.lit(-RECENCY_DECAY) * (latest - F.col("_last"))))
        .select(ITEM_FEATURES.names)
    )


def cross_features() -> dict[str, Column]:
    """Columns that need both sides. The product is taken in 64 bits."""
    return {
        "rating_deviation": F.col("rating") - F.col("user_avg_rating"),
        "popularity_alignment": F.col("user_rating_count").cast("bigint") * F.col("item_rating_count"),
    }


def dealt(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` with ``_part``: 0, or one of the ``_parts`` of a key that ``hot`` lists."""
    # The partition number is that of a file's split, the same when a task runs again; it tells
    # equal rows of different files apart.
    known = rows.withColumn("_at", F.spark_partition_id()).join(hot, key, "left")
    part = F.pmod(F.xxhash64(*rows.columns, "_at"), F.col("_parts")).cast("int")
    return known.withColumn("_part", F.coalesce(part, F.lit(0))).drop("_parts", "_at")


def join_by_parts(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, group_rows: int) -> DataFrame:
    """``rows`` left-joined with ``side`` (one row per key) in one shuffle of the rows, where no
    more than about ``group_rows`` rows of a key meet in a task.

    ``counts`` (key, _n) is staged. A key of more rows is dealt out in parts and its row of
    ``side`` goes to each of them; equal rows of one file stay together. Null keys find
    nothing and are no group. Without such keys this is the plain join.
    """
    hot = counts.where((F.col("_n") > group_rows) & F.col(key).isNotNull())
    if hot.isEmpty():
        return rows.join(side, key, "left")
    parts = F.ceil(F.col("_n") / group_rows).cast("int").alias("_parts")
    hot = broadcast_if_small(stage(hot.select(key, parts), "hot-keys"))
    every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = side.join(hot, key, "left").withColumn("_part", F.explode(every)).drop("_parts")
    return dealt(rows, key, hot).join(right, [key, "_part"], "left").drop("_part")


def interaction_features(
    ratings: DataFrame,
    users: DataFrame,
    items: DataFrame,
    *,
    item_counts: DataFrame | None = None,
    group_rows: int = MAX_ITEM_ROWS,
) -> DataFrame:
    """Ratings with their user's and item's features and the cross features.

    Users come first: ratings and users that are bucketed alike are joined where they lie,
    so that ratings are shuffled once, for their items, or not at all. No side is hinted
    here: without a caller's hint the planner broadcasts what it measures as small. With
    ``item_counts`` (movieId, _n; staged, the item side being too large to broadcast) hot
    items are dealt out over several tasks.
    """
    extra_user = [c for c in ("user_idx",) if c in users.columns]
    extra_item = [c for c in ("item_idx",) if c in items.columns]
    known = ratings.join(users.select("userId", *USER_JOIN_COLUMNS, *extra_user), "userId", "left")
    side = items.select("movieId", *ITEM_JOIN_COLUMNS, *extra_item)
    if item_counts is None:
        both = known.join(side, "movieId", "left")
    else:
        both = join_by_parts(known, side, "movieId", item_counts, group_rows)
    return both.withColumns(cross_features())


def distributions(users: DataFrame, items: DataFrame) -> DataFrame:
    """(feature, value) rows of the monitored features; no row passes the driver."""
    def long(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
        wide = df.select(*[F.col(n).cast("double").alias(n) for n in names])
        return wide.unpivot([], list(names), "feature", "value")

    return long(users, MONITORED_USER_FEATURES).unionByName(long(items, MONITORED_ITEM_FEATURES))
