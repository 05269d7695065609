"""What several text operators share: byte words, columns, shared-folder tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: A-Z to a-z, every other byte as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: As FOLD, and every ASCII byte that is no letter or digit becomes a space. Bytes from
#: 0x80 on belong to words, so UTF-8 characters beyond ASCII stay whole.
FOLD_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def utf8(text: str | Column) -> Column:
    """The text as UTF-8 bytes: Python then gets bytes, with no decoding to pay for."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; where that is unset, a folder in the
    warehouse, which is shared as well.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stage"
    return root.rstrip("/")


_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def keep(df: DataFrame, name: str, *, lasting: bool = False) -> DataFrame:
    """Write a table in the shared folder and scan it: cuts lineage, outlives executors.

    Inside ``scratch`` it is deleted at the end of the block, unless it is ``lasting``.
    """
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept, owned = df.sparkSession.read.schema(df.schema).parquet(path), _scratch.get()
    if owned is not None and not lasting:
        owned.append(kept)
    return kept


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables kept inside the block when it ends; what reads them must be done."""
    owned: list[DataFrame] = []
    token = _scratch.set(owned)
    try:
        yield
    finally:
        _scratch.reset(token)
        for table in owned:
            drop_kept(table)


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a table written by ``keep`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# What this Python worker keeps between batches.
_resident: dict[Hashable, object] = {}


def resident[T](key: Hashable, build: Callable[[], T]) -> T:
    """A table that a worker builds once. Workers live on from stage to stage, so what another
    operator left behind goes first: a worker holds the tables of one operator."""
    if key not in _resident:
        release()
        _resident[key] = build()
    return _resident[key]


def release() -> None:
    _resident.clear()


def quoted(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    escaped = name.replace("`", "``")
    return F.col(f"`{escaped}`").alias(name)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of a column over all rows."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def pieces_of(total: int, size: int) -> int:
    """How many parts of about ``size`` hold ``total``; one at least."""
    return max(1, math.ceil(total / size))


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each of several adjoining runs, and the end of the last."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the runs ``starts[i] .. starts[i] + lengths[i] - 1``, run by run."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def bounded[T: (str, bytes)](texts: Iterable[T], most: int) -> Iterator[list[T]]:
    """The texts in order, in parts of at most ``most`` characters or bytes;
    a longer text goes alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
