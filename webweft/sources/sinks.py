"""Sinks of standard records: JSON lines or one JSON array, CSV, the Parquet store, memory; and a saver that retries.

A write saves a table whole or not at all, and is counted as it runs: no sink evaluates its input twice.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from webweft.operators.store import FIELDS, PageStore, validate
from webweft.stored import Stored


class StorageError(OSError):
    """A table that could not be written; another try may do."""


@contextmanager
def storage_errors() -> Iterator[None]:
    """What Spark raises when a write fails, as StorageError. A table without a record's columns stays a ValueError."""
    try:
        yield
    except (Py4JError, PySparkException) as e:
        raise StorageError(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else 'write failed'}") from e


class Sink:
    """write() saves a table and gives the number of rows; close() ends the sink, and is called when its block is left."""

    closed = False

    def write(self, records: DataFrame) -> int:
        raise NotImplementedError

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Sink:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


class MemorySink(Sink):
    """Rows on the driver, for tests and small results: no more than `most`, else a write fails. The first fail_times writes fail."""

    def __init__(self, fail_times: int = 0, most: int = 100_000):
        self.rows: list = []
        self.fail_times, self.most = fail_times, most

    def write(self, records: DataFrame) -> int:
        if self.fail_times > 0:
            self.fail_times -= 1
            raise StorageError("failure asked for")
        room = self.most - len(self.rows)
        with storage_errors():
            got = records.limit(room + 1).collect()
        if len(got) > room:
            raise StorageError(f"more than {self.most} rows")
        self.rows += got
        return len(got)


def jsonable(records: DataFrame) -> DataFrame:
    """Records with the time as ISO text in UTC."""
    return records.withColumn("crawled_at", F.date_format(F.col("crawled_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


def _counted(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    seen = Observation()
    with storage_errors():
        write(rows.observe(seen, F.count(F.lit(1)).alias("n")))
        return seen.get["n"]


class JsonLinesSink(Sink):
    """A folder of JSON lines, written by the executors."""

    def __init__(self, path: str, append: bool = False):
        self.path, self.mode = path, "append" if append else "overwrite"

    def write(self, records: DataFrame) -> int:
        good, _ = validate(records)
        return _counted(jsonable(good).select(*FIELDS), lambda rows: rows.write.mode(self.mode).json(self.path, ignoreNullFields=False))


class CsvSink(Sink):
    """A folder of CSV with headers, quotes doubled; links as JSON in a cell, null as nothing, no NUL signs."""

    def __init__(self, path: str, delimiter: str = ",", append: bool = False):
        if len(delimiter) != 1:
            raise ValueError("delimiter must be one sign")
        self.path, self.delimiter, self.mode = path, delimiter, "append" if append else "overwrite"

    def write(self, records: DataFrame) -> int:
        good, _ = validate(records)
        rows = jsonable(good).select(*FIELDS).withColumn("links", F.to_json("links"))
        rows = rows.select(*[F.translate(F.col(c), "\0", "").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
        how = {"header": True, "escape": '"', "quoteAll": False, "sep": self.delimiter, "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        return _counted(rows, lambda rows: rows.write.mode(self.mode).csv(self.path, **how))


class StoreSink(Sink):
    """Upserts into a Parquet page store."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = PageStore(spark, path)

    def write(self, records: DataFrame) -> int:
        with storage_errors():
            return self.store.save(records)


class SingleFileSink(Sink):
    """One local file, JSON array, JSON lines or CSV in any encoding, written on the driver row by row.

    For small artefacts: rows come to the driver a partition at a time, and none is held once it is written. Signs
    that the encoding lacks become question marks; utf-8-sig writes its mark once. With append a JSON array is opened
    again, and a last line without an end gets one.
    """

    def __init__(self, path: str, kind: str = "json", lines: bool = False, indent: int | None = 2, encoding: str = "utf-8", delimiter: str = ",", append: bool = False):
        if kind not in ("json", "csv"):
            raise ValueError("kind must be json or csv")
        self.path, self.kind, self.lines, self.indent, self.encoding, self.delimiter, self.append = path, kind, lines, indent, encoding, delimiter, append

    def _rows(self, records: DataFrame) -> Iterator[dict]:
        for r in jsonable(records).select(*FIELDS).toLocalIterator():
            d = r.asDict(recursive=True)
            d["metadata"] = json.loads(d["metadata"]) if d["metadata"] else {}
            yield d

    def _csv_line(self, cells: list) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=self.delimiter, lineterminator="\n").writerow(cells)
        return out.getvalue()

    def _cells(self, d: dict) -> list:
        return ["" if d[c] is None else json.dumps(d[c], ensure_ascii=False) if c in ("links", "metadata") else str(d[c]).replace("\0", "") for c in FIELDS]

    def _texts(self, rows: Iterator[dict], fresh: bool, any_before: bool) -> Iterator[tuple[str, int]]:
        """Pieces of the file, and the rows that each ends."""
        if self.kind == "csv":
            if fresh:
                yield self._csv_line(list(FIELDS)), 0
            for d in rows:
                yield self._csv_line(self._cells(d)), 1
        elif self.lines:
            for d in rows:
                yield json.dumps(d, ensure_ascii=False) + "\n", 1
        else:
            if fresh:
                yield "[", 0
            gap = "" if self.indent is None else "\n" + " " * self.indent
            for d in rows:
                text = json.dumps(d, ensure_ascii=False, indent=self.indent)
                yield ("," if any_before else "") + gap + text.replace("\n", gap), 1
                any_before = True
            yield ("" if self.indent is None or not any_before else "\n") + "]\n", 0

    def _copy_old(self, to) -> bool:
        """Copies the file that is there, in blocks, so that rows can follow; whether an array had rows."""
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            if self.kind == "json" and not self.lines:
                # the array's end is within the last signs; what stands before it is kept
                f.seek(max(0, size - 64))
                tail = f.read()
                at = tail.rfind("]".encode(self.encoding if self.encoding != "utf-8-sig" else "utf-8"))
                if at < 0:
                    raise StorageError(f"{self.path} is no JSON array")
                keep, f_before = size - len(tail) + at, tail[:at].rstrip()
                keep -= at - len(f_before)
                f.seek(0)
                while keep > 0 and (block := f.read(min(keep, 1 << 20))):
                    to.write(block)
                    keep -= len(block)
                return not f_before.endswith(b"[")
            last = b""
            while block := f.read(1 << 20):
                to.write(block)
                last = block[-1:]
            if last not in (b"", b"\n"):
                to.write(b"\n")
            return False

    def write(self, records: DataFrame) -> int:
        good, _ = validate(records)
        there = self.append and os.path.exists(self.path) and os.path.getsize(self.path) > 0
        tmp, n = f"{self.path}.part", 0
        with storage_errors(), open(tmp, "wb") as f:
            before = self._copy_old(f) if there else False
            encoder = codecs.getincrementalencoder("utf-8" if there and self.encoding == "utf-8-sig" else self.encoding)("replace")
            for text, rows in self._texts(self._rows(good), not there, before):
                f.write(encoder.encode(text))
                n += rows
        os.replace(tmp, self.path)
        return n


class Saver:
    """Saves tables by a sink, with retries, and accounts for each row: saved, failed or pending.

    A table is pending until it is written. `every` tables are written together by flush(); one that cannot be written
    is kept, stored, and tried once more at close(). Storage errors never raise; they are counted, and named in errors.
    """

    def __init__(self, sink: Sink, retries: int = 3, delay: float = 0.2, every: int = 1, sleep: Callable[[float], None] = time.sleep):
        self.sink, self.retries, self.delay, self.every, self.sleep = sink, retries, delay, every, sleep
        self.saved, self.tries, self.errors = 0, 0, []
        self._pending: list[DataFrame] = []
        self._lost: list[tuple[Stored, int]] = []

    def save(self, records: DataFrame) -> None:
        self._pending.append(records)
        if len(self._pending) >= self.every:
            self.flush()

    def flush(self) -> int:
        """Writes what is pending and gives the number of rows written."""
        if not self._pending:
            return 0
        rows = self._pending[0]
        for r in self._pending[1:]:
            rows = rows.unionByName(r)
        self._pending = []
        n = self._write(rows)
        if n is None:
            kept = Stored(rows, "lost")
            self._lost.append((kept, kept.df.count()))
        return n or 0

    def _write(self, rows: DataFrame) -> int | None:
        for k in range(self.retries + 1):
            try:
                n = self.sink.write(rows)
            except OSError as e:
                self.errors.append(str(e))
                if k == self.retries:
                    return None
                self.sleep(self.delay * 2**k)
                self.tries += 1
            else:
                self.saved += n
                return n
        return None

    def stats(self) -> dict:
        return {"saved": self.saved, "failed": sum(n for _, n in self._lost), "retries": self.tries, "pending": len(self._pending), "errors": list(self.errors)}

    def close(self) -> dict:
        """Flushes, tries lost tables once more, and closes the sink. Gives the last stats."""
        self.flush()
        lost, self._lost = self._lost, []
        for kept, n in lost:
            if self._write(kept.df) is None:
                self._lost.append((kept, n))
            else:
                kept.drop()
        self.sink.close()
        return self.stats()

    def __enter__(self) -> Saver:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def save(sink: Sink, records: DataFrame, retries: int = 3, delay: float = 0.2) -> dict:
    """Writes one table with retries, the pause doubling; never raises for storage errors. Gives saved, failed, retries, error."""
    saver = Saver(sink, retries, delay)
    saver.save(records)
    s = saver.stats()
    return {"saved": s["saved"], "failed": s["failed"], "retries": s["retries"], "error": s["errors"][-1] if s["failed"] or not s["saved"] and s["errors"] else None}
