"""Ranks and prefix sums over a whole table or over very large groups.

An ordered window without a partition, or with a hot one, puts all its rows in one
task. The helpers here cut the values into cells, add the cells up first (a small
table) and order rows only inside a cell. Integer ids and hashes fill even cells
evenly; other values are cut where the data is, however they are spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.staging import discard, stage

# Rows that a cell holds, about.
CELL_ROWS = 65_536
# Ids that share a cell: a 32-bit id range gives at most 65,536 cells of 65,536 ids.
ID_CELL_BITS = 16


def prefix_sums(
    df: DataFrame,
    value: str | Sequence[str],
    weights: Sequence[str],
    cell: Column,
    keys: Sequence[str] = (),
    descending: bool = False,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ``<w>_before``: the sum of ``w`` over rows of the group with a smaller ``value``.

    ``value`` names one column or several that are compared in turn. ``df`` holds one
    row per (keys, value). ``cell`` maps values to bounded integers
    without breaking their order. With ``descending`` "smaller" reads "larger". ``derived``
    are columns of the order that follow from the others: they are computed where a cell's rows
    have come together, and do not move. Sums of the cells before are attached there as well.
    """
    direction = F.desc if descending else F.asc
    df = df.withColumn("_cell", cell)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_cell").agg(*[F.sum(w).alias(f"_{w}_cell") for w in weights])
    across = before.partitionBy(*keys).orderBy(direction("_cell"))
    starts = totals.select(
        *keys,
        "_cell",
        *[F.coalesce(F.sum(f"_{w}_cell").over(across), F.lit(0)).alias(f"_{w}_start") for w in weights],
    )
    values = [value] if isinstance(value, str) else value
    inside = before.partitionBy(*keys, "_cell").orderBy(*[direction(v) for v in values])
    moved = df.repartition(*keys, "_cell").withColumns(derived) if derived else df
    summed = moved.withColumns({f"{w}_before": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    joined = summed.join(starts, [*keys, "_cell"])
    return joined.withColumns({f"{w}_before": F.col(f"_{w}_start") + F.col(f"{w}_before") for w in weights}).drop(
        "_cell", *[f"_{w}_start" for w in weights]
    )


def cells_for(rows: int, cell_rows: int = CELL_ROWS) -> int:
    """How many cells of about ``cell_rows`` rows; one at least."""
    return max(1, -(-rows // cell_rows))


def range_cells(df: DataFrame, order: Sequence[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``_cell``: its rows cut by the order of some columns into cells of about
    ``cell_rows`` rows. Borders come from a sample of the rows themselves, so values may crowd
    anywhere; rows with equal columns share a cell. The result is a stage table."""
    rows = stage(df, "values")
    ranged = rows.repartitionByRange(cells_for(rows.count(), cell_rows), *order)
    cut = stage(ranged.withColumn("_cell", F.spark_partition_id()), "cells")
    discard(rows)
    return cut


def dense_index(df: DataFrame, id_column: str, index_column: str) -> DataFrame:
    """Number the distinct integer ids of ``df`` 0, 1, 2 ... in id order.

    ``df`` holds each id once. No task orders more than 65,536 rows.
    """
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    indexed = prefix_sums(counted, id_column, ["_one"], F.shiftright(F.col(id_column), ID_CELL_BITS))
    return indexed.withColumn(index_column, F.col("_one_before").cast("int")).drop("_one", "_one_before")


def dense_rank_desc(counts: DataFrame, value: str, rank_column: str) -> DataFrame:
    """(value, rank) with rank 1 for the largest of the distinct BIGINT values of ``counts``."""
    distinct = counts.select(value).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(
        distinct, value, ["_one"], F.shiftright(F.col(value), ID_CELL_BITS), descending=True
    )
    return ranked.select(value, (F.col("_one_before") + 1).cast("int").alias(rank_column))
