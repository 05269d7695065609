"""Stage tables: written once in shared storage, read back as plain scans.

A stage table replaces a cache or a checkpoint. It survives the loss of executors as a
checkpoint does; unlike one, later readers prune its columns, its row count is in the file
footers, and it can be deleted as soon as its last reader is done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS

CHECKPOINT_CONF = "spark.checkpoint.dir"


def stage_root(spark: SparkSession) -> str:
    """The shared folder of the session: its checkpoint folder, set by configuration or by
    ``setCheckpointDir``; where there is none, a folder in the warehouse, which is shared too."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        given = spark._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stage"
    return root.rstrip("/")


# Paths written inside the innermost scope of this thread of work. Jobs that run side by
# side have scopes of their own.
_scope: ContextVar[list[str] | None] = ContextVar("stage_scope", default=None)


def stage(df: DataFrame, name: str, *, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return a scan of it.

    ``partition_by`` gives a folder per value; those columns come last in the scan.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/rankloom/{name}-{uuid.uuid4().hex}"
    owned = _scope.get()
    if owned is not None:
        owned.append(path)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``stage`` with one file per bucket of ``key``: what is bucketed alike is joined, and
    grouped by the key, where it lies.

    The catalogue entry that carries the buckets goes at once; the scan keeps them.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/rankloom/{name}-{uuid.uuid4().hex}"
    owned = _scope.get()
    if owned is not None:
        owned.append(path)
    table = f"rankloom_stage_{uuid.uuid4().hex}"
    try:
        df.repartition(buckets, key).write.bucketBy(buckets, key).saveAsTable(table, format="parquet", path=path)
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def bucket_count(spark: SparkSession, rows: int, bucket_rows: int) -> int:
    """Buckets for so many rows: at least the partitions of a shuffle, as the planner would
    shuffle again for more tasks otherwise, and at most what Spark allows."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(max(least, -(-rows // bucket_rows)), most)


def discard(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, before its scope ends."""
    spark = staged.sparkSession
    root = f"{stage_root(spark)}/rankloom/"
    for file in staged.inputFiles()[:1]:
        at = file.rindex("/rankloom/") + len("/rankloom/")
        remove(spark, root + file[at:].split("/")[0])


def stage_all(**tables: DataFrame) -> tuple[DataFrame, ...]:
    """Stage independent tables at the same time, so that one's last tasks leave no core idle."""
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(len(tables)) as pool:
        jobs = [
            pool.submit(copy_context().run, inheritable_thread_target(spark)(stage), df, name)
            for name, df in tables.items()
        ]
        return tuple(job.result() for job in jobs)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what it holds; nothing if it is gone already."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the stage tables written inside the block when it ends.

    For jobs whose results are written out by then; a lazy result that still reads a
    stage table must not leave the block.
    """
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in own:
            remove(spark, path)


def staged_bytes(staged: DataFrame) -> int:
    """Bytes of a staged table's files, as the planner knows them from the listing."""
    return int(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(staged: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a staged table has at most ``max_rows`` rows and ``max_bytes`` bytes of files;
    both are known without reading it."""
    return staged_bytes(staged) <= max_bytes and staged.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(staged: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when a staged table is small."""
    return F.broadcast(staged) if is_small(staged, max_rows, max_bytes) else staged
