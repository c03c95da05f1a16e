"""A live crawl as a stream: its frontier is a folder that a query reads, and to which it adds what it finds.

Everything lies under one path: frontier (url, depth, and the batch that found it), pages by batch, what is known of domains, and the
query's checkpoint. A crawl that was stopped, or has died, goes on where it was: URLs of batches that were committed are not read
again, and a batch whose pages were stored is not fetched again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webweft.functions import urls
from webweft.operators import fetch, frontier
from webweft.sources import live
from webweft.stored import Stored

FRONTIER = "url string, depth int, found int"


class CrawlStream:
    """start() runs without end, as files of URLs come; run() until nothing is left.

    max_pages counts all URLs that are taken up; of a level that goes beyond it those with the smallest hashes stay. exclude, include and
    same_domain_only filter as frontier.crawl() does. answer: what gives (url, html, status_code, ...) for URLs, live fetching by default.
    """

    def __init__(self, spark: SparkSession, path: str, manners: live.Manners = live.Manners(), max_depth: int = 2, max_pages: int = 100, same_domain_only: bool = False, exclude: list[str] | None = None, include: list[str] | None = None, answer: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.manners, self.max_depth, self.max_pages = spark, path.rstrip("/"), manners, max_depth, max_pages
        self.same_domain_only, self.exclude, self.include, self.answer = same_domain_only, exclude, include, answer

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the folders under a name that were written whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(at):
            return []
        found = ((s.getPath(), re.search(r"=(-?\d+)$", s.getPath().getName())) for s in fs.listStatus(at))
        return sorted(int(m[1]) for p, m in found if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def frontier(self) -> DataFrame:
        """(url, depth, found): all URLs that were taken up, with the batch that found them; -1 for seeds."""
        found = self._numbers("frontier")
        if not found:
            return self.spark.createDataFrame([], FRONTIER)
        return self.spark.read.schema(FRONTIER).parquet(*[f"{self.path}/frontier/from={k}" for k in found])

    def seed(self, seeds: list[str]) -> None:
        """Takes up the URLs a crawl starts with; of one that was begun before nothing changes."""
        if not self._numbers("frontier"):
            rows = self.spark.createDataFrame([(u,) for u in seeds], "url string").select(urls.normalize_url(F.col("url")).alias("url")).distinct()
            self._add(rows.where("url is not null").withColumn("depth", F.lit(0)), -1)

    def _add(self, rows: DataFrame, number: int) -> None:
        left = self.max_pages - self.frontier().where(F.col("found") < number).count()
        new = Stored(rows.where(urls.url_filter(F.col("url"), None, self.exclude, self.include)).select("url", "depth"), "new")
        n = new.df.count()
        if min(n, left) > 0:  # a folder without rows would be a batch of its own
            few = new.df if n <= left else new.df.orderBy(F.xxhash64("url"), "url").limit(left)
            few.withColumn("found", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/frontier/from={number}")
        new.drop()

    def _batch(self, batch: DataFrame, number: int) -> None:
        """Fetches a batch's URLs, stores their pages, and takes up what they link to."""
        if number not in self._numbers("pages"):
            asked = batch.select("url", "depth").distinct()
            known = self._numbers("known")
            session = None
            ask = self.answer
            if ask is None:
                before = self.spark.read.schema(live.KNOWN).parquet(f"{self.path}/known/batch={known[-1]}") if known else None
                session = live.LiveSession(self.spark, self.manners, known=before)
                ask = session.fetch
            got = ask(asked.select("url"))
            tries = F.col("attempts") if "attempts" in got.columns else F.lit(1)
            got = got.select("url", "html", "status_code", "content_type", "kind", "error", tries.cast("int").alias("attempts")).join(asked, "url")
            parsed = fetch.parse_answers(got, ("depth", "status_code", "content_type", "attempts"))
            if session is not None:
                session.known().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/known/batch={number}")
            parsed.select("url", "depth", F.col("kind").isNull().alias("ok"), "status_code", "content_type", "kind", "error", "attempts", "page").write.mode("overwrite").parquet(f"{self.path}/pages/batch={number}")
            if session is not None:
                session.close()
        pages = self.spark.read.parquet(f"{self.path}/pages/batch={number}")
        links = pages.where(F.col("ok") & (F.col("depth") < self.max_depth)).select(F.explode(F.transform("page.links", urls.normalize_url)).alias("url"), (F.col("depth") + 1).alias("depth"))
        # nothing that a batch from this one on has found: it may be here for the second time
        seen = self.frontier().where(F.col("found") < number)
        new = links.where("url is not null").groupBy("url").agg(F.min("depth").alias("depth")).join(seen.select("url"), "url", "left_anti")
        if self.same_domain_only:
            new = frontier.within(new, seen.where("depth = 0").select(F.col("url").alias("domain")).distinct(), "url")
        self._add(new, number)

    def start(self, **trigger) -> StreamingQuery:
        """The query; trigger as DataStreamWriter.trigger() takes it."""
        rows = self.spark.readStream.schema(FRONTIER).parquet(f"{self.path}/frontier/from=*")
        writer = rows.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def run(self) -> int:
        """Goes on until no URL is left; gives the number of pages that are stored."""
        while True:
            before = self._numbers("pages"), self._numbers("frontier")
            self.start(availableNow=True).awaitTermination()
            if (self._numbers("pages"), self._numbers("frontier")) == before:
                return self.pages().count()

    def pages(self) -> DataFrame:
        """(url, depth, ok, status_code, content_type, kind, error, attempts, page) of all batches so far."""
        done = self._numbers("pages")
        if not done:
            raise ValueError("nothing was fetched yet")
        return self.spark.read.parquet(*[f"{self.path}/pages/batch={k}" for k in done])
