"""Sitemap trees: index files are expanded level by level, each file once, errors kept by file."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.functions.sitemap import MOST_DEPTH, MOST_URLS, parsed
from webweft.stored import Stored


def payloads_of(files: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """(url, payload) of the asked files (url) in a table of files; payload is null for those that it lacks."""
    return lambda asked: asked.select("url").join(files.select("url", "payload"), "url", "left")


def sitemap_tree(files: DataFrame | Callable[[DataFrame], DataFrame], roots: DataFrame, max_depth: int = MOST_DEPTH, max_urls: int | None = MOST_URLS) -> tuple[DataFrame, DataFrame]:
    """(url, depth, parent, pos) of distinct page URLs, and (sitemap_url, error) with a null error for files that were read.

    files: a table (url, payload), or what answers (url) with (url, payload). roots: (url, pos). A file that is missing
    or can't be read is an error and does not stop the rest. Order is by level, then the parent's place, then the place
    in the file. max_urls: the first so many URLs by that order; None for all. Null roots take no part.
    """
    answer = files if callable(files) else payloads_of(files)
    level = roots.where("url is not null").select("url", F.col("pos").cast("long").alias("parent")).groupBy("url").agg(F.min("parent").alias("parent"))
    seen = level.select("url")
    found, files_read = [], []
    for depth in range(max_depth + 1):
        got = level.join(answer(level.select("url")), "url", "left").select("url", "parent", parsed(F.col("payload"), F.col("url")).alias("s"))
        got = Stored(got, "sitemaps").df
        found.append(got.where("s.kind = 'urls'").select(F.lit(depth).alias("depth"), "parent", F.posexplode("s.locs").alias("pos", "url")))
        children = got.where("s.kind = 'index'")
        too_deep = F.when(F.col("s.kind") == "index", F.lit(f"more than {max_depth} levels of sitemaps")) if depth == max_depth else F.lit(None)
        files_read.append(got.select(F.col("url").alias("sitemap_url"), F.coalesce("s.error", too_deep).alias("error")))
        if depth == max_depth:
            break
        inner = children.select(F.col("parent").alias("up"), F.posexplode("s.locs").alias("pos", "url")).join(seen, "url", "left_anti")
        nxt = inner.groupBy("url").agg(F.min(F.struct("up", "pos")).alias("at")).orderBy("at").select("url", F.monotonically_increasing_id().alias("parent"))
        level = Stored(nxt, "level").df
        if level.isEmpty():
            break
        seen = seen.union(level.select("url"))
    every = reduce(DataFrame.union, found)
    first = every.groupBy("url").agg(F.min(F.struct("depth", "parent", "pos")).alias("at"))
    first = first if max_urls is None else first.orderBy("at").limit(max_urls)
    return first.select("url", "at.*"), reduce(DataFrame.union, files_read)


def sitemap_stats(files_read: DataFrame) -> DataFrame:
    """One row: sitemaps that were fetched, and those that failed."""
    return files_read.agg(F.count_if(F.col("error").isNull()).alias("fetched"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def sitemaps_of(robots: DataFrame) -> DataFrame:
    """(origin, url, pos): a site's sitemaps, those of its robots.txt or else /sitemap.xml."""
    own = F.when(F.size("parsed.sitemaps") > 0, F.col("parsed.sitemaps")).otherwise(F.array(F.concat("origin", F.lit("/sitemap.xml"))))
    return robots.select("origin", F.posexplode(own).alias("pos", "url"))
