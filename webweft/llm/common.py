"""Helpers shared by the operators: tables in the cluster's shared folder, input projection."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.stored import Stored, release_shuffles, shared_dir  # noqa: F401


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): extra columns, clashing names among them, never enter a plan. Null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: str | Column, n: int) -> Column:
    """crc32(id as text) mod n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n) if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _trim() -> None:
    """Gives memory that is free back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; what a partition took is given back at its end, as workers live on and there may be several
    idle ones for a busy one."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return wrapped
