"""Python functions of a row over Arrow batches, of which a worker never holds all rows as Python objects."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F

#: Rows that are Python objects at once: of a batch of pages, their markup and all that is taken from it would be many times the batch.
ROWS = 64


def trim() -> None:
    """Gives memory that is free back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def in_parts(one: Callable, kind: pa.DataType) -> Callable[..., pa.Array]:
    """one of each row of some Arrow columns, as an Arrow column of a type; ROWS rows at a time are taken out of Arrow."""

    def take(*columns: pa.Array) -> pa.Array:
        parts = [pa.array([one(*row) for row in zip(*(c.slice(k, ROWS).to_pylist() for c in columns))], kind) for k in range(0, len(columns[0]), ROWS)]
        out = pa.concat_arrays(parts) if parts else pa.array([], kind)
        del parts
        trim()
        return out

    return take


def by_row(one: Callable, kind: pa.DataType, ddl: str):
    """one as a function of columns; kind and ddl are the type of what it gives."""
    return F.arrow_udf(in_parts(one, kind), ddl)
