"""Retries as a relation: each request's outcomes by attempt, cut at the first success or the last allowed try."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.functions import errors


def attempt_log(outcomes: DataFrame, most: int = 3, base: float = 1.0, factor: float = 2.0, most_delay: float = 30.0, by_kind: dict | None = None, by_status: dict | None = None) -> DataFrame:
    """(url, n, kind, status, last, delay): the attempts that are made, from outcomes (url, n, kind, status, retry_after).

    outcomes says how attempt n (from 0) of a URL would end; kind is null for success. An attempt is made if
    every one before it failed in a way that is tried again, within its own limit.
    """
    kind, status, n = F.col("kind"), F.col("status"), F.col("n")
    again = errors.should_retry(kind) & (n < errors.retry_limit(status, kind, most, by_status, by_kind))
    rows = outcomes.withColumn("again", F.coalesce(again, F.lit(False)))
    stop = rows.where(~F.col("again")).groupBy("url").agg(F.min("n").alias("stop"))
    made = rows.join(stop, "url", "left").where(F.col("stop").isNull() | (n <= F.col("stop")))
    delay = errors.backoff(n, status, F.col("retry_after"), base, factor, most_delay)
    return made.select("url", "n", "kind", "status", (~F.col("again")).alias("last"), F.when(F.col("again"), delay).alias("delay"))


def retry_stats(log: DataFrame) -> DataFrame:
    """One row: calls, total_errors, retries, successful_retries, failed_after_retries, avg_retry_delay, permanent."""
    by_url = log.groupBy("url").agg(
        F.count("kind").alias("errors"),
        F.count("delay").alias("retries"),
        F.sum("delay").alias("delay"),
        F.max(F.col("last") & F.col("kind").isNull()).alias("ok"),
        F.max(F.col("last") & (F.col("kind") == "PermanentError")).alias("permanent"),
    )
    return by_url.agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
        F.count_if(F.col("ok") & (F.col("retries") > 0)).alias("successful_retries"),
        F.count_if(~F.col("ok") & (F.col("retries") > 0)).alias("failed_after_retries"),
        F.coalesce(F.try_divide(F.sum("delay"), F.sum("retries")), F.lit(0.0)).alias("avg_retry_delay"),
        F.count_if(F.coalesce(F.col("permanent"), F.lit(False))).alias("permanent_urls"),
    )


def errors_by_type(log: DataFrame) -> DataFrame:
    return log.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def permanent_urls(log: DataFrame) -> DataFrame:
    return log.where(F.col("last") & (F.col("kind") == "PermanentError")).select("url").distinct()
