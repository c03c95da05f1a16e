"""Fetching from a snapshot: bodies by an equi-join, and parsed pages with failures as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.functions import errors, html_tree


def fetch(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, html, status_code, content_type, kind, error) of distinct URLs: what the snapshot (url, html, status_code
    [, content_type]) answers.

    A URL that it lacks is a NetworkError; a status of 400 or more is classified and has no body. A null status is
    200. Null URLs take no part.
    """
    of = F.col("content_type") if "content_type" in pages.columns else F.lit("text/html")
    there = pages.select("url", "html", "status_code", of.alias("content_type"), F.lit(True).alias("__there"))
    got = urls.where("url is not null").select("url").distinct().join(there, "url", "left")
    status = F.coalesce(F.col("status_code"), F.when(F.col("__there"), F.lit(200)))
    kind = F.when(F.col("__there").isNull(), "NetworkError").otherwise(errors.classify_status(status))
    why = F.when(F.col("__there").isNull(), "no answer").when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
    return got.select("url", F.when(kind.isNull(), F.col("html")).alias("html"), status.alias("status_code"), F.coalesce("content_type", F.lit("")).alias("content_type"), kind.alias("kind"), why.alias("error"))


def fetched(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, html) of the distinct URLs that are answered."""
    return fetch(urls, pages).where("kind is null").select("url", "html")


def parse_answers(got: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """got's url and keep with page: all fields; those of a failure are empty, and page.errors says why."""
    parsed = html_tree.parse_pages(got, keep=tuple(dict.fromkeys((*keep, "kind", "error"))))
    why = F.when(F.col("kind").isNull(), F.col("page.errors")).otherwise(F.array_append(F.col("page.errors"), F.concat(F.lit("fetch: "), "error")))
    return parsed.withColumn("page", F.col("page").withField("errors", why))


def fetch_and_parse(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, kind, page): all fields of each page that the snapshot answers, and why others have none."""
    return parse_answers(fetch(urls, pages)).select("url", "kind", "page")


def error_stats(failed: DataFrame) -> DataFrame:
    """(kind, urls, statuses) of failures (url, kind, status_code)."""
    return failed.where("kind is not null").groupBy("kind").agg(F.count("*").alias("urls"), F.count_distinct("status_code").alias("statuses"))


def failed_urls(failed: DataFrame) -> DataFrame:
    """(url, kind, error, status_code) of failures, one a URL."""
    return failed.where("kind is not null").groupBy("url").agg(F.min_by(F.struct("kind", "error", "status_code"), F.coalesce("error", F.lit(""))).alias("r")).select("url", "r.*")
