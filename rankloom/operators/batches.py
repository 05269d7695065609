"""Shuffled fixed-size training batches as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import BATCH_ROWS, SEED
from rankloom.functions.hashing import seeded_hash
from rankloom.operators.ordering import CELL_ROWS, cells_for, prefix_sums

# Copies of one row that are placed together in the shuffled order.
COPY_RUN = 256
# Bits of the shuffle key.
KEY_BITS = 31


def training_batches(labelled: DataFrame, batch_rows: int = BATCH_ROWS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Put labelled pairs in a seeded random order and cut it into batches.

    Adds ``batch_id``; all batches but the last hold ``batch_rows`` rows. Equal rows
    are counted first, so copies of one row never pile up in a task, and placed in
    runs of at most ``COPY_RUN``. Rows are ordered only inside cells of the shuffle key,
    whose number follows the number of rows (read from file footers where ``labelled`` is
    stored). Beyond 2**31 cells rows of one key order by their columns.
    """
    bits = min(KEY_BITS, (cells_for(labelled.count(), cell_rows) - 1).bit_length())
    counted = labelled.groupBy("user_idx", "item_idx", "label").agg(F.count("*").alias("_n"))
    last_run = F.floor((F.col("_n") - 1) / COPY_RUN)
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), last_run)))
    runs = runs.withColumn(
        "_n", F.least(F.lit(COPY_RUN).cast("bigint"), F.col("_n") - F.col("_run") * COPY_RUN)
    )
    key = seeded_hash(seed, "user_idx", "item_idx", "int(label)", "_run")
    order = ["_key", "user_idx", "item_idx", "label", "_run"]
    placed = prefix_sums(runs, order, ["_n"], F.shiftright(key, KEY_BITS - bits), derived={"_key": key})
    copies = placed.withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    )
    batch = F.floor((F.col("_n_before") + F.col("_copy")) / batch_rows)
    return copies.select("user_idx", "item_idx", "label", batch.alias("batch_id"))
