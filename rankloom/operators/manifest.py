"""Lineage: which files, rows and bytes a table is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_manifest(table: DataFrame) -> DataFrame:
    """One row per source file of a file-based scan: name, bytes, last change, rows."""
    return (
        table.select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_size").alias("n_bytes"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
        .groupBy("file_path", "file_name", "n_bytes", "modified_at")
        .agg(F.count("*").alias("n_rows"))
    )


def split_manifest(interactions: DataFrame) -> DataFrame:
    """(split, n_rows, n_users, n_items) of an interactions table.

    Distinct users and items are counted from deduplicated keys, one narrow pass each.
    """

    def distinct(column: str, name: str) -> DataFrame:
        keys = interactions.select("split", column).distinct()
        return keys.groupBy("split").agg(F.count(column).alias(name))

    rows = interactions.groupBy("split").agg(F.count("*").alias("n_rows"))
    return rows.join(distinct("userId", "n_users"), "split").join(distinct("movieId", "n_items"), "split")
