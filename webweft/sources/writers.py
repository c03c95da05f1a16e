"""Records as df.write.format(...): JSON lines or one JSON array, CSV, and the page store, whole or not at all.

Tasks write parts into a folder of their own beside the target; once all have, the driver puts the parts in place, and where any fails
it removes them, so that what was there before stays as it was. A part of a task that was lost or ran twice is never taken.
Register with register(spark). The path lies on a disk that the driver and all executors share.
"""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from webweft.operators import store

#: Bytes that are copied at once where parts become one file.
BLOCK = 1 << 20


def local(path: str | None) -> str:
    if not path:
        raise ValueError("a path is needed")
    at = path.removeprefix("file://")
    if "://" in at:
        raise ValueError(f"{path}: the path must be one that all executors have mounted")
    return os.path.abspath(at)


def plain(value):
    """A value as JSON has it: times as ISO text in UTC."""
    if isinstance(value, datetime):
        return (value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return value.decode("utf-8", "replace")
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """parts in a staging folder; put() places them."""

    suffix = ""

    def __init__(self, path: str, schema: StructType, overwrite: bool, options: dict):
        self.path, self.schema, self.overwrite, self.options = path, schema, overwrite, options
        self.staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"

    def begin(self) -> _Writer:
        """Makes the staging folder, here and not in a task: one that is late finds none and fails, rather than leave its part."""
        os.makedirs(self.staging)
        return self

    def write_part(self, at: str, batches: Iterator[pa.RecordBatch], number: int) -> int:
        raise NotImplementedError

    def put(self, parts: list[Part]) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{uuid.uuid4().hex}{self.suffix}"
        return Part(number, name, self.write_part(f"{self.staging}/{name}", iterator, number))

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        try:
            self.put(parts)
        finally:
            self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes the staging folder, though tasks that are about to end may yet put a file into it."""
        for _ in range(100):
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                return
            time.sleep(0.05)

    def _folder(self, parts: list[Part]) -> None:
        """The parts that count become the folder, or join it."""
        wanted = {p.name for p in parts}
        for name in os.listdir(self.staging):
            if name not in wanted:
                os.remove(f"{self.staging}/{name}")
        if self.overwrite or not os.path.exists(self.path):
            old = f"{self.staging}-old"
            if os.path.exists(self.path):
                os.rename(self.path, old)
            os.rename(self.staging, self.path)
            shutil.rmtree(old, ignore_errors=True)
        else:
            for p in parts:
                os.rename(f"{self.staging}/{p.name}", f"{self.path}/{p.name}")
        open(f"{self.path}/_SUCCESS", "w").close()

    def _file(self, parts: list[Part], first: bytes, between: bytes, last: bytes) -> None:
        """The parts, one after another, as one file in place of the one that was there."""
        made = f"{self.staging}/whole"
        with open(made, "wb") as out:
            out.write(first)
            any_ = False
            for p in parts:
                if p.rows:
                    out.write(between if any_ else b"")
                    any_ = True
                    with open(f"{self.staging}/{p.name}", "rb") as f:
                        shutil.copyfileobj(f, out, BLOCK)
            out.write(last)
        os.replace(made, self.path)


class _Text(_Writer):
    def __init__(self, *args):
        super().__init__(*args)
        self.single = self.options.get("single", "false").lower() == "true"
        self.encoding = self.options.get("encoding", "utf-8")
        # the mark of an encoding stands once, before all parts
        self.mark = "".encode(self.encoding)
        self.of_parts = "utf-8" if self.encoding == "utf-8-sig" else self.encoding
        self.columns = [f.name for f in self.schema.fields]
        if self.single and not self.overwrite:
            raise ValueError("a single file is written in mode overwrite")


class JsonWriter(_Text):
    suffix = ".json"

    def write_part(self, at: str, batches: Iterator[pa.RecordBatch], number: int) -> int:
        end, n = ",\n" if self.single else "\n", 0
        with open(at, "w", encoding=self.of_parts, errors="replace", newline="") as f:
            for b in batches:
                for row in b.to_pylist():
                    f.write((end if n and self.single else "") + json.dumps(plain(row), ensure_ascii=False) + ("" if self.single else end))
                    n += 1
        return n

    def put(self, parts: list[Part]) -> None:
        if self.single:
            self._file(parts, self.mark + "[\n".encode(self.of_parts), ",\n".encode(self.of_parts), "\n]\n".encode(self.of_parts))
        else:
            self._folder(parts)


class CsvWriter(_Text):
    suffix = ".csv"

    def __init__(self, *args):
        super().__init__(*args)
        self.delimiter = self.options.get("delimiter", self.options.get("sep", ","))

    def _line(self, cells: list) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=self.delimiter, lineterminator="\n").writerow(cells)
        return out.getvalue()

    def _cell(self, value) -> str:
        value = plain(value)
        if value is None:
            return ""
        return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value).replace("\0", "")

    def write_part(self, at: str, batches: Iterator[pa.RecordBatch], number: int) -> int:
        n = 0
        with open(at, "w", encoding=self.of_parts if self.single else self.encoding, errors="replace", newline="") as f:
            if not self.single:
                f.write(self._line(self.columns))
            for b in batches:
                for row in b.to_pylist():
                    f.write(self._line([self._cell(row[c]) for c in self.columns]))
                    n += 1
        return n

    def put(self, parts: list[Part]) -> None:
        if self.single:
            self._file(parts, self.mark + self._line(self.columns).encode(self.of_parts, "replace"), b"", b"")
        else:
            self._folder(parts)


class StoreWriter(_Writer):
    """A save into a page store, in mode append; the latest of a URL wins, also within the save."""

    suffix = ".parquet"

    def __init__(self, path: str, schema: StructType, overwrite: bool, options: dict):
        super().__init__(path, schema, overwrite, options)
        if overwrite:
            raise ValueError("a store is written in mode append")
        if missing := [c for c in store.FIELDS if c not in schema.names]:
            raise ValueError(f"records lack {', '.join(missing)}")
        saves = [int(x.split("=")[1]) for x in os.listdir(path) if x.startswith(("base=", "delta="))] if os.path.isdir(path) else []
        self.turn = max(saves, default=0) + 1
        self.kinds = pa.schema(
            [("id", pa.int64()), ("seq", pa.int64()), ("domain", pa.string()), ("url", pa.string()), ("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("metadata", pa.string()), ("crawled_at", pa.timestamp("us", tz="UTC")), ("status_code", pa.int32()), ("content_type", pa.string())]
        )

    def write_part(self, at: str, batches: Iterator[pa.RecordBatch], number: int) -> int:
        from webweft.sources.live import domain_of

        n = 0
        with pq.ParquetWriter(at, self.kinds) as f:
            for b in batches:
                rows = [r for r in b.to_pylist() if r["url"] and r["links"] is not None and (r["metadata"] or "").lstrip().startswith("{")]
                seq = [(self.turn << 44) + (number << 30) + n + k for k in range(len(rows))]
                f.write_table(pa.Table.from_pylist([{**{c: r[c] for c in store.FIELDS}, "id": s, "seq": s, "domain": domain_of(r["url"])} for r, s in zip(rows, seq)], schema=self.kinds))
                n += len(rows)
        return n

    def put(self, parts: list[Part]) -> None:
        wanted = {p.name for p in parts}
        for name in os.listdir(self.staging):
            if name not in wanted:
                os.remove(f"{self.staging}/{name}")
        # rows of one URL are not put together here, so readers have to
        for mark in (store.RAW, "_SUCCESS"):
            open(f"{self.staging}/{mark}", "w").close()
        os.makedirs(self.path, exist_ok=True)
        os.rename(self.staging, f"{self.path}/delta={self.turn}")


def _source(title: str, made: type[_Writer]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def writer(self, schema: StructType, overwrite: bool) -> _Writer:
            return made(local(self.options.get("path")), schema, overwrite, dict(self.options)).begin()

    return Source


#: Options of the first two: single (one file; else a folder of parts), encoding; of CSV also delimiter.
FORMATS = {"webweft_json": JsonWriter, "webweft_csv": CsvWriter, "webweft_store": StoreWriter}


def register(spark: SparkSession) -> None:
    for title, made in FORMATS.items():
        spark.dataSource.register(_source(title, made))
