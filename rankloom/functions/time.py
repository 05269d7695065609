"""Calendar arithmetic on epoch seconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def epoch_day(seconds: Column) -> Column:
    """UTC day number of an epoch-seconds column."""
    return F.floor(seconds / F.lit(SECONDS_PER_DAY)).cast("int")


def epoch_year(seconds: Column) -> Column:
    return F.year(F.date_from_unix_date(epoch_day(seconds)))


def epoch_seconds(timestamp: Column) -> Column:
    """Epoch seconds of a zone-less timestamp read as UTC."""
    days = F.unix_date(timestamp.cast("date")).cast("bigint")
    return (
        days * SECONDS_PER_DAY
        + F.hour(timestamp) * 3_600
        + F.minute(timestamp) * 60
        + F.floor(F.second(timestamp)).cast("int")
    )
