"""What the corpus operators share: table access, the shared folder and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage, remove, shared_path, table  # noqa: F401
from tessera.session import written as to_path

#: Stands in for a null doc_id while ids are compared, so that such rows come after all others.
NULL_ID = 2**63 - 1


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the frame as a table in the shared folder, read again."""
    out = cut_lineage(df, name)
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables of one operator in the shared folder, by name, removed when they are read no more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = shared_path(self.spark, name)
        out = to_path(df, self.paths[name])
        release(self.spark)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows and bytes that a Python worker turns into objects at once.
ROWS, BYTES = 1024, 1 << 22


def slices(items: Iterable[pa.RecordBatch], column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a bounded size by a column of strings, a row at least. What the worker gathered goes back to the system at the end."""
    for batch in items:
        at = 0
        if batch.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            start = ends[at - 1] if at else 0
            to = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, start + BYTES, "right"))))
            yield batch.slice(at, to - at)
            at = to
    trim()


def batches(items: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_id and text of Arrow batches as Python lists."""
    for batch in slices(items):
        yield batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()


def trim() -> None:
    """Gives freed memory back to the system: Spark uses a Python worker for many tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
