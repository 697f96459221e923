"""Helpers shared by the corpus operators: reading, stored tables, text slices."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lexiscope.operators.util import checkpointed

#: text handled at once inside a task; a single longer text is one slice
SLICE_BYTES = 1 << 20


#: Spark's default and ours: rows and bytes of an Arrow batch; rows here are whole texts
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m"),
}


def small_batches(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run ``query(spark, ...)`` with Arrow batches fit for long texts, unless the session has set its own."""
    @functools.wraps(query)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        for key, (default, ours) in ARROW_BATCH.items():
            if spark.conf.get(key, None) == default:
                spark.conf.set(key, ours)
        return query(spark, *args, **options)
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back."""
    return checkpointed(df)


#: tasks that every core gets at least, where there are as many partitions
TASKS_PER_CORE = 3


def few_tasks(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` in no more tasks than its ``rows`` need at ``per_task`` rows each, or than keep every core busy.

    Small tables after a shuffle of many partitions would otherwise spend their time on starting tasks and files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(TASKS_PER_CORE * cores, ceil(rows / per_task)))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive rows that hold at most ``limit`` together (or one row)."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts of a column as UTF-8 bytes (null is empty), in lists of at most ``limit`` bytes or one text."""
    data = texts.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(data), 0).to_pylist()
    for a, z in slices(sizes, limit):
        yield [t or b"" for t in data.slice(a, z - a).to_pylist()]


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    counts = np.asarray(counts, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - counts, counts)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` once to the shared folder in buckets of ``key``; joins on it then leave these rows in place."""
    from uuid import uuid4

    from lexiscope.session import scratch_path

    spark, name = df.sparkSession, f"lexiscope_{uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", scratch_path(spark, name)).saveAsTable(name)
    rows = spark.table(name)
    rows.schema  # resolved here: the plan keeps the files and buckets
    spark.sql(f"DROP TABLE {name}")  # the entry goes; the files of a table with a path stay
    return rows


def discard(rows: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    from lexiscope.session import _delete

    for folder in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        _delete(rows.sparkSession, folder)


def release_memory() -> None:
    """Give freed memory back to the machine: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass
