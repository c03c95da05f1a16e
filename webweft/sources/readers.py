"""Readers of stored records: JSON (array or lines), CSV and Parquet, all to the standard columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.operators.store import FIELDS, RECORD


def _typed(rows: DataFrame, when: Column | None = None) -> DataFrame:
    have = [c for c in FIELDS if c in rows.columns]
    return rows.select(*have)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array or of JSON lines, told apart by the first sign. metadata stays JSON text."""
    schema = RECORD.replace("crawled_at timestamp", "crawled_at string")
    first = spark.read.text(path, wholetext=False).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0].value.lstrip("﻿ \t").startswith("[")
    rows = spark.read.schema(schema).json(path, multiLine=array)
    return _typed(rows.withColumn("crawled_at", F.to_timestamp("crawled_at")))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Records of CSV with a header; links are JSON in a cell, empty cells of numbers and times are null."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=delimiter, encoding=encoding.replace("utf-8-sig", "UTF-8"), maxCharsPerColumn=-1)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    cast = {
        "links": F.coalesce(F.from_json("links", "array<string>"), F.array().cast("array<string>")),
        "status_code": F.col("status_code").try_cast("int") if "status_code" in rows.columns else F.lit(None).cast("int"),
        "crawled_at": F.try_to_timestamp("crawled_at") if "crawled_at" in rows.columns else F.lit(None).cast("timestamp"),
    }
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "text", "content_type") if c in rows.columns}
    return _typed(rows.withColumns({k: v for k, v in cast.items() if k in rows.columns} | text))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.parquet(path))


def snapshot(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Bodies of distinct URLs that the snapshot has: one equi-join, the URLs made distinct before it."""
    return urls.select("url").distinct().join(pages, "url")
