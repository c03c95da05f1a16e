"""Crawl statistics over page events (url, ok, status, error, size[, ts])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweft.functions import urls
from webweft.operators import retry

EVENT = "url string, ok boolean, status int, error string, size long, ts timestamp"


def summary(events: DataFrame, elapsed: Column | None = None) -> DataFrame:
    """One row of counts and rates; bytes_total counts characters of extracted text, as size does."""
    got = events.agg(
        F.count("*").alias("total_pages"),
        F.count_if("ok").alias("successful"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))), F.lit(0)).cast("long").alias("bytes_total"),
        F.coalesce((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6, F.lit(0.0)).alias("span"),
    )
    seconds = F.col("span") if elapsed is None else elapsed
    rate = F.coalesce(F.try_divide("successful", "total_pages"), F.lit(0.0))
    speed = F.when(seconds > 0, F.col("total_pages") / seconds).otherwise(F.lit(0.0))
    return got.select("total_pages", "successful", "failed", F.round(rate, 4).alias("success_rate"), F.round(seconds, 3).alias("elapsed_seconds"), F.round(speed, 3).alias("pages_per_second"), "bytes_total")


def status_codes(events: DataFrame) -> DataFrame:
    return events.where("status is not null").groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def errors(events: DataFrame) -> DataFrame:
    return events.where("not ok").groupBy(F.coalesce("error", F.lit("unknown")).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error")


def top_domains(events: DataFrame, n: int = 10, first: str = "ts", domain: Column | None = None) -> DataFrame:
    """Domains by pages, those seen first before others of the same count."""
    d = urls.netloc(F.col("url")) if domain is None else domain
    got = events.groupBy(d.alias("domain")).agg(F.count("*").alias("pages"), F.min(first).alias("first")).where("domain <> ''")
    return got.orderBy(F.desc("pages"), "first", "domain").limit(n).select("domain", "pages")


def pages_by_site(pages: DataFrame) -> DataFrame:
    return pages.groupBy(urls.normalize_domain(F.col("url")).alias("site")).agg(F.count("*").alias("pages"))


def storage_stats(records: DataFrame, saved: DataFrame) -> DataFrame:
    """One row: records that are saved, and those that are not."""
    left = records.select("url").distinct().join(saved.select("url").distinct().withColumn("there", F.lit(True)), "url", "left")
    return left.agg(F.count_if(F.col("there").isNotNull()).alias("saved"), F.count_if(F.col("there").isNull()).alias("failed"))


def crawl_stats(visited: DataFrame, elapsed: float | None = None, queued: int = 0, in_progress: int = 0) -> DataFrame:
    """One row of counts and the rate from frontier.crawl(). A crawl that has ended has nothing queued or in progress."""
    rate = F.try_divide(F.count("*").cast("double"), F.lit(elapsed)) if elapsed else F.lit(0.0)
    return visited.agg(
        F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"), F.lit(queued).cast("long").alias("queued"), F.lit(in_progress).cast("long").alias("in_progress"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.lit(elapsed or 0.0).alias("elapsed_seconds"), F.coalesce(rate, F.lit(0.0)).alias("pages_per_second"),
    )


#: Failed URLs that a report names.
MOST_NAMED = 1_000


def error_stats(attempts: DataFrame, failed: DataFrame, breakers: DataFrame | None = None) -> dict:
    """Errors by class, retries, failed URLs with their reasons (MOST_NAMED at most, the first by URL; n_failed_urls counts
    all) and breakers, for the report.

    attempts: retry.attempt_log(). failed: fetch.failed_urls(). breakers: breaker.breaker_states(); those that ever
    opened are named.
    """
    named = failed.orderBy("url").limit(MOST_NAMED).collect()
    opened = breakers.where("opened_times > 0").orderBy(F.desc("opened_times"), F.col(breakers.columns[0])).limit(MOST_NAMED).collect() if breakers is not None else []
    return {
        "errors_by_type": {r.kind: r.n for r in retry.errors_by_type(attempts).orderBy(F.desc("n"), "kind").collect()},
        "retry": retry.retry_stats(attempts).first().asDict(),
        "permanent": [r.url for r in retry.permanent_urls(attempts).orderBy("url").limit(MOST_NAMED).collect()],
        "n_failed_urls": failed.count(),
        "failed": {r.url: r.error or r.kind for r in named},
        "breaker": [{"domain": r[0], "state": r.state, "opened_times": r.opened_times} for r in opened],
    }


def as_dict(events: DataFrame, top_n: int = 10, elapsed: Column | None = None) -> dict:
    """All statistics as one dict, for the reports: a few small aggregates are collected."""
    row = summary(events, elapsed).first().asDict()
    return row | {
        "status_codes": {str(r.status): r.n for r in status_codes(events).collect()},
        "top_domains": [r.asDict() for r in top_domains(events, top_n).collect()],
        "errors": {r.error: r.n for r in errors(events).orderBy(F.desc("n"), "error").limit(1000).collect()},
    }
