"""Table contracts, and the check that enforces them on write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

INT, BIGINT, FLOAT, DOUBLE = IntegerType(), LongType(), FloatType(), DoubleType()
STRING, BOOLEAN, FLOATS = StringType(), BooleanType(), ArrayType(FloatType())
TEXTS = MapType(StringType(), StringType())


def struct(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


# Column names and types of the exchanged tables.
RATINGS = struct(
    userId=INT,
    movieId=INT,
    rating=FLOAT,
    timestamp=BIGINT,
)
ITEMS = struct(
    movieId=INT,
    title=STRING,
    genres=STRING,
)
TAGS = struct(
    userId=INT,
    movieId=INT,
    tag=STRING,
    timestamp=BIGINT,
)
LINKS = struct(
    movieId=INT,
    imdbId=STRING,
    tmdbId=INT,
)
USER_FEATURES = struct(
    userId=INT,
    user_avg_rating=DOUBLE,
    user_rating_count=INT,
    user_rating_stddev=DOUBLE,
    user_active_days=INT,
    user_genre_diversity=INT,
    user_avg_timestamp=DOUBLE,
    user_positive_ratio=DOUBLE,
)
ITEM_FEATURES = struct(
    movieId=INT,
    item_avg_rating=DOUBLE,
    item_rating_count=INT,
    item_rating_stddev=DOUBLE,
    item_genre_count=INT,
    item_recency_score=DOUBLE,
    item_popularity_rank=INT,
)
INTERACTIONS = struct(
    userId=INT,
    movieId=INT,
    rating=FLOAT,
    timestamp=BIGINT,
    user_avg_rating=DOUBLE,
    user_rating_count=INT,
    user_rating_stddev=DOUBLE,
    user_genre_diversity=INT,
    user_avg_timestamp=DOUBLE,
    user_positive_ratio=DOUBLE,
    item_avg_rating=DOUBLE,
    item_rating_count=INT,
    item_rating_stddev=DOUBLE,
    item_genre_count=INT,
    item_recency_score=DOUBLE,
    item_popularity_rank=INT,
    rating_deviation=DOUBLE,
    popularity_alignment=BIGINT,
    user_idx=INT,
    item_idx=INT,
    split=STRING,
)
LABELLED = struct(
    user_idx=INT,
    item_idx=INT,
    label=FLOAT,
)
CANDIDATES = struct(
    user_idx=INT,
    item_idx=INT,
    is_positive=BOOLEAN,
)
FACTORS = struct(
    id=INT,
    features=FLOATS,
    bias=FLOAT,
)
DISTRIBUTIONS = struct(
    feature=STRING,
    value=DOUBLE,
)
RUN_METRICS = struct(
    run_id=STRING,
    model_type=STRING,
    metric=STRING,
    value=DOUBLE,
    step=BIGINT,
)
RUNS = struct(run_id=STRING, status=STRING, parameters=TEXTS, tags=TEXTS)

USER_JOIN_COLUMNS = tuple(c for c in USER_FEATURES.names if c not in ("userId", "user_active_days"))
ITEM_JOIN_COLUMNS = tuple(c for c in ITEM_FEATURES.names if c != "movieId")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail on the driver, before any job, when ``df`` lacks a column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; found {df.columns}")
    return df


def conform(df: DataFrame, contract: StructType) -> DataFrame:
    """Project ``df`` onto ``contract``: order and types as declared, extra columns dropped."""
    require_columns(df, *contract.names)
    return df.to(contract)
