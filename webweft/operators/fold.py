"""Folds over each key's rows in order, for rules whose next step depends on the last: state is a few values a key.

Rows are dealt by key and sorted on disk as need be; Python sees them in Arrow batches and holds one key's state,
never its rows. A key's rows are one task's work, as their order is the rule; its length is not bounded by memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are handed on together.
BATCH = 10_000


def fold(log: DataFrame, key: str, order: tuple[str, ...], columns: tuple[str, ...], start: Callable[[], Any], step: Callable[..., tuple | None], finish: Callable[[Any, Any], tuple | None], schema: str, dealt: bool = False) -> DataFrame:
    """Rows of schema from step(state, key, *order, *columns) for each row and finish(state, key) after each key's last.

    start gives a new state, which step changes in place; either may give no row. Rows of equal order are taken as
    they come. A null key is a key; a null in order comes first. An empty log gives no rows. dealt: the log lies by key
    and in order already, and a partition's rows of a key are folded by themselves.
    """
    rows = log.select(key, *order, *columns)
    rows = rows if dealt else rows.repartition(key).sortWithinPartitions(key, *order)
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = None
        last: Any = None

        def batch() -> pa.RecordBatch:
            cols = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, types)], names=types.names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or row[0] != last:
                    if state is not None and (end := finish(state, last)) is not None:
                        out.append(end)
                    state, last = start(), row[0]
                if (got := step(state, *row)) is not None:
                    out.append(got)
                if len(out) >= BATCH:
                    yield batch()
                    out = []
        if state is not None and (end := finish(state, last)) is not None:
            out.append(end)
        if out:
            yield batch()

    return rows.mapInArrow(run, schema)
