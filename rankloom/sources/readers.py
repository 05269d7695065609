"""Typed scans. Nothing here counts or collects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from rankloom import schemas

CORRUPT_COLUMN = "_corrupt_record"


def read_csv(
    spark: SparkSession, path: str, schema: StructType, *, keep_corrupt: bool = False, header: bool = True
) -> DataFrame:
    """CSV under an explicit schema; every file has a header line unless ``header`` is false.

    A malformed field stops the job, unless ``keep_corrupt`` asks for the raw line
    of each bad row in ``_corrupt_record``. Doubled quotes inside quoted fields are
    read as one quote.
    """
    reader = spark.read.option("header", header).option("escape", '"')
    if keep_corrupt:
        schema = StructType([*schema.fields, StructField(CORRUPT_COLUMN, StringType())])
        reader = reader.option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", CORRUPT_COLUMN
        )
    else:
        reader = reader.option("mode", "FAILFAST")
    return reader.schema(schema).csv(path)


def load_ratings(spark: SparkSession, path: str, *, keep_corrupt: bool = False) -> DataFrame:
    return read_csv(spark, path, schemas.RATINGS, keep_corrupt=keep_corrupt)


def load_items(spark: SparkSession, path: str, *, keep_corrupt: bool = False) -> DataFrame:
    return read_csv(spark, path, schemas.ITEMS, keep_corrupt=keep_corrupt)


def load_tags(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TAGS)


def load_links(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LINKS)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV with guessed types: reads the input twice, meant for small files."""
    return spark.read.option("header", True).option("escape", '"').csv(path, inferSchema=True)


def csv_row_count(spark: SparkSession, path: str) -> int:
    """Records in a headed CSV, header not counted, quoted line breaks respected."""
    return spark.read.option("header", True).option("escape", '"').csv(path).count()


def load_interactions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Interactions written by the feature plan.

    ``split`` becomes a partition filter: the other splits' files are not opened.
    """
    df = schemas.require_columns(spark.read.parquet(path), "user_idx", "item_idx")
    return df if split is None else df.where(df["split"] == split)
