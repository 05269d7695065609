"""Shards of bounded size by extendible hashing.

A directory maps prefixes of a row's hash bits to shards. Only a shard over the byte limit
splits, on its next bit, until every shard fits. Which shards split follows from byte sums
over prefixes, so a round moves one row of sums per directory cell and no texts.

Bits come from a hash of the id, then from a hash of the text, so that one id with very
many rows splits as well; equal rows beyond the limit are dealt out by number.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import fresh_name, keep, scratch

#: Bits of one hash, and of a round beyond those that the mean shard needs.
WORD_BITS = 60
SPARE_BITS = 4

#: Bytes of a shard.
SHARD_BYTES = 16 * 2**20


def hash_word(value: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a non-negative integer."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit(""))), 1, WORD_BITS // 4), 16, 10).cast("bigint")


def bit_text(number: Column, width: Column) -> Column:
    return F.when(width > 0, F.lpad(F.bin(number), width, F.lit("0"))).otherwise(F.lit(""))


def shifted(number: Column | str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(number) if isinstance(number, str) else number, by.cast("int"))


def _round(rows: DataFrame, width: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """One extension of the directory by ``width`` bits below every open shard.

    rows: shard, cell, n_bytes. Returns (shard, cell, depth) of the cells whose shard now
    fits, and (shard, cell, bytes) of the cells still over the limit.
    """
    cells = keep(rows.groupBy("shard", "cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n_rows")), "cells")
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(width))))
    sums = levels.groupBy("shard", "depth", shifted("cell", width - F.col("depth")).alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows")
    )
    # A single row over the limit stays a shard of its own.
    fits = keep(sums.where((F.col("bytes") <= limit) | (F.col("n_rows") == 1)).select("shard", "depth", "prefix"), "fits")
    parents = fits.select("shard", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    leaves = fits.withColumn("parent", shifted("prefix", F.lit(1))).join(parents, ["shard", "depth", "parent"], "left_anti")
    below = F.call_function("shiftleft", F.lit(1).cast("bigint"), (width - F.col("depth")).cast("int"))
    covered = leaves.select(
        "shard", F.explode(F.sequence(F.col("prefix") * below, (F.col("prefix") + 1) * below - 1)).alias("cell"), "depth"
    )
    over = cells.where((F.col("bytes") > limit) & (F.col("n_rows") > 1)).select("shard", "cell", "bytes")
    return covered.join(cells.select("shard", "cell"), ["shard", "cell"], "left_semi"), over


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    """Equal rows over the limit: dealt out by running number, as many to a shard as fit.

    Numbers run inside each partition of the kept table and go on from the partitions
    before, so no task holds all copies.
    """
    rows = keep(rows, "equal_rows").withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("n_bytes")) - 1
    rows = rows.withColumn("own", own).join(counts.drop("count"), ["shard", "part"])
    fit = F.greatest(F.lit(1), F.floor(limit / F.col("n_bytes")))
    number = F.floor((F.col("before") + F.col("own")) / fit)
    return rows.withColumn("shard", F.concat_ws("/", "shard", number.cast("string"))).drop("by_id", "by_text", "part", "own", "before")


def assign(docs: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, n_bytes, shard, depth of every row; the shard is named by its bits. With ``row``
    that column, a key of the rows, comes last.

    Null texts count as empty; null ids hash like empty ones; equal rows are assigned one
    by one; a row over the limit is alone in its shard; an empty table gives no rows.
    Other columns are ignored. Texts are read once and never shuffled.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.lit("").alias("shard"),
        hash_word(F.col(doc_id).cast("string")).alias("by_id"),
        hash_word(F.col(text)).alias("by_text"),
        *([] if row is None else [F.col(row).alias("row")]),
    )
    kept = ["doc_id", "n_bytes", "shard", *([] if row is None else ["row"])]
    rows = keep(rows, "sizes")
    done = []
    left = rows.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    shards = 1
    for word in ("by_id", "by_text"):
        used = 0
        while used < WORD_BITS:
            width = min(WORD_BITS - used, SPARE_BITS + math.ceil(math.log2(max(2, left / limit / shards))))
            mask = (1 << width) - 1
            celled = rows.withColumn("cell", shifted(word, F.lit(WORD_BITS - used - width)).bitwiseAND(F.lit(mask)))
            closed, over = _round(celled, width, limit)
            fitting = celled.join(closed, ["shard", "cell"])
            bits = bit_text(shifted("cell", width - F.col("depth")), F.col("depth"))
            done.append(fitting.withColumn("shard", F.concat("shard", bits)).select(*kept))
            used += width
            open_ = over.agg(F.sum("bytes").alias("n"), F.count("*").alias("cells")).first()
            if not open_["cells"]:
                return _result(done)
            left, shards = open_["n"], open_["cells"]
            inner = celled.join(over.drop("bytes"), ["shard", "cell"], "left_semi")
            rows = inner.withColumn("shard", F.concat("shard", bit_text(F.col("cell"), F.lit(width)))).select(*kept, "by_id", "by_text")
    done.append(_numbered(rows, limit).select(*kept))
    return _result(done)


def _result(parts: list[DataFrame]) -> DataFrame:
    depth = F.length(F.element_at(F.split("shard", "/"), 1))
    whole = reduce(DataFrame.unionAll, parts)
    return whole.select("doc_id", "n_bytes", "shard", depth.alias("depth"), *[c for c in whole.columns if c == "row"])


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> str:
    """The documents as Parquet with all their columns, one folder per shard; the name of the
    column that tells the shards (``shard``, or with underscores before it where the documents
    have such a column).

    Rows are told apart by a number of their own, so every row is written once: rows without an
    id, rows that share one and equal rows too. Null texts count as empty. A copy of the table
    is kept in the shared folder while the shards are written.
    """
    row, shard = fresh_name(docs, "row"), fresh_name(docs, "shard")
    with scratch():
        numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        names = assign(numbered, limit, doc_id, text, row).select(F.col("row").alias(row), F.concat(F.lit("b"), F.replace("shard", F.lit("/"), F.lit("-"))).alias(shard))
        numbered.join(names, row).drop(row).repartition(shard).write.partitionBy(shard).parquet(path)
    return shard
