"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tracewell.session import BROADCAST_BYTES, measured, prepare, stored

__all__ = [
    "BROADCAST_BYTES", "with_fields", "broadcast_if_bounded", "measured", "prepare", "releasing",
    "replaced", "stored", "table", "words_of",
]

# White space of every contract here: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Number of words in ``text``; null counts as no text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def with_fields(schema: StructType, added: Iterable[tuple[str, DataType]]) -> StructType:
    """``schema`` without the added names, then the added columns: an operator's own columns win a clash."""
    added = list(added)
    names = {name for name, _ in added}
    kept = [f for f in schema.fields if f.name not in names]
    return StructType(kept + [StructField(name, kind, True) for name, kind in added])


def replaced(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with the added columns at its end, in the order that ``with_fields`` gives."""
    names = [n for n in batch.schema.names if n not in added]
    columns = [batch.column(batch.schema.names.index(n)) for n in names]
    return pa.RecordBatch.from_arrays(columns + list(added.values()), names=names + list(added))


def release_memory() -> None:
    """Give the system what the allocators of this process keep free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function for mapInArrow, that releases memory after each batch and at the end of the task.

    Workers outlive their tasks, and what one stage leaves in them counts while the next ones run.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield batch
                del batch
                release_memory()
        finally:
            release_memory()

    return task


def broadcast_if_bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint where its content was measured below the limit, else unchanged.

    Without the hint Spark shuffles both sides and adaptive execution splits a hot key.
    """
    _, size = measured(df)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
