"""Malformed records of delimited files, set aside with their line and a reason.

A record that does not fit its schema neither stops a job nor turns into nulls: good rows and
bad lines come out as two tables, and every line of the file is in exactly one of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rankloom.sources.readers import CORRUPT_COLUMN, read_csv
from rankloom.sources.staging import stage

FIELDS = "number of fields"


@dataclass(frozen=True)
class Records:
    """``good`` has the schema's columns, ``bad`` (line, reason)."""

    good: DataFrame
    bad: DataFrame

    def report(self) -> DataFrame:
        """(reason, n): bad lines by reason, and the good rows under a null reason."""
        good = self.good.agg(F.lit(None).cast("string").alias("reason"), F.count("*").alias("n"))
        return good.unionByName(self.bad.groupBy("reason").agg(F.count("*").alias("n")))


def reason_of(line: str, schema: StructType) -> F.Column:
    """Why a line is malformed: its number of fields, or the first field of another type."""
    texts = StructType([StructField(f.name, StringType()) for f in schema] + [StructField(CORRUPT_COLUMN, StringType())])
    fields = F.from_csv(F.col(line), texts.simpleString()[len("struct<") : -1].replace(":", " "), {"escape": '"', "columnNameOfCorruptRecord": CORRUPT_COLUMN})
    wrong = [
        F.when(fields[f.name].isNotNull() & fields[f.name].try_cast(f.dataType).isNull(), f"{f.name} is no {f.dataType.simpleString()}") for f in schema
    ]
    return F.when(fields[CORRUPT_COLUMN].isNotNull(), FIELDS).otherwise(F.coalesce(*wrong, F.lit("other")))


def read_records(spark: SparkSession, path: str, schema: StructType, *, header: bool = True) -> Records:
    """Parse once, stage what was parsed, and tell good rows from bad lines.

    An empty file has neither. An empty field is a null, not a malformed one.
    """
    parsed = stage(read_csv(spark, path, schema, keep_corrupt=True, header=header), "records")
    corrupt = F.col(CORRUPT_COLUMN)
    good = parsed.where(corrupt.isNull()).drop(CORRUPT_COLUMN)
    bad = parsed.where(corrupt.isNotNull()).select(corrupt.alias("line"), reason_of(CORRUPT_COLUMN, schema).alias("reason"))
    return Records(good, bad)
