"""Sinks: Parquet tables and one-row JSON manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(
    df: DataFrame,
    path: str,
    *,
    partition_by: Sequence[str] = (),
    counts: Mapping[str, "F.Column"] | None = None,
) -> dict[str, int]:
    """Overwrite a snappy Parquet table; return ``counts`` measured by the same pass."""
    observation = None
    if counts:
        observation = Observation()
        df = df.observe(observation, *[c.alias(name) for name, c in counts.items()])
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return dict(observation.get) if observation else {}


def write_manifest(spark: SparkSession, path: str, facts: Mapping[str, object]) -> None:
    """Write ``facts`` as a single JSON record."""
    names = list(facts)
    record = spark.range(1).select(*[F.lit(facts[n]).alias(n) for n in names])
    record.coalesce(1).write.mode("overwrite").json(path)
