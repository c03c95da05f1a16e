"""A whole crawl, over a snapshot or live: seeds and sitemaps, traversal, parsing, store, statistics, reports."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.functions import robots, urls
from webweft.operators import fetch, frontier, stats, store
from webweft.plans import config, progress, report
from webweft.sources import live, sinks
from webweft.sources.sitemaps import sitemap_stats, sitemap_tree
from webweft.stored import Stored


#: Why a page that robots.txt forbids has failed.
BARRED = "robots.txt forbids it"


@dataclass
class Result:
    visited: DataFrame  # url, depth, rank, ok, status_code, content_type, kind, error, page
    records: DataFrame  # standard records of the pages that were found
    events: DataFrame  # page events
    sitemap_files: DataFrame | None  # sitemap_url, and the error of those that could not be read
    blocked: DataFrame | None  # URLs that robots.txt forbids
    saved: dict | None
    elapsed: float = 0.0
    tables: list[Stored] = field(default_factory=list)
    session: live.LiveSession | None = None  # of a live crawl: what it knows of its domains

    def stats(self, top_n: int = 10) -> dict:
        """Figures of the pages, the crawl, retries, sitemaps, robots and storage."""
        out = stats.as_dict(self.events, top_n, F.lit(self.elapsed))
        out["crawl"] = stats.crawl_stats(self.visited, self.elapsed).first().asDict()
        out["retries"] = self.visited.agg(F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0))).first()[0]
        out["sitemaps"] = sitemap_stats(self.sitemap_files).first().asDict() if self.sitemap_files is not None else {"fetched": 0, "failed": 0}
        out["blocked"] = self.blocked.count() if self.blocked is not None else 0
        out["storage"] = self.saved
        return out

    def failed(self) -> DataFrame:
        return fetch.failed_urls(self.visited)

    def attempts(self) -> DataFrame:
        """Each page's last attempt as retry.attempt_log() has it, for the error report."""
        return self.visited.select("url", F.greatest(F.col("attempts") - 1, F.lit(0)).alias("n"), "kind", F.col("status_code").alias("status"), F.lit(True).alias("last"), F.lit(None).cast("double").alias("delay"))

    def breakers(self) -> DataFrame | None:
        """State of each domain's breaker at the end of a live crawl, as breaker.breaker_states() has it of a log."""
        return self.session.breaker_states() if self.session is not None and self.session.manners.breaker else None

    def close(self) -> None:
        """Deletes the run's tables; its DataFrames can't be read any more. A second call does nothing."""
        for t in self.tables:
            t.drop()
        self.tables = []
        if self.session is not None:
            self.session.close()

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


class CrawlJob:
    """Runs settings (plans.config) over a snapshot table (url, html, status_code, content_type), or live without one.

    sink: another than the settings name. manners: for live fetching, another than the settings give (other retries, a
    breaker of one's own). page_callback gets each level's pages as a DataFrame, on_retry(url, attempt, kind, pause)
    each new try of a live request; it runs on the executors. progress gets a line of text after each level.
    """

    def __init__(self, spark: SparkSession, settings: dict | None = None, sink: sinks.Sink | None = None, manners: live.Manners | None = None, page_callback: Callable[[DataFrame], None] | None = None, on_retry: Callable | None = None, progress: Callable[[str], None] | None = None):
        self.spark, self.sink, self.page_callback, self.on_retry, self.progress = spark, sink, page_callback, on_retry, progress
        self.cfg = config.settings(settings or {})
        self.own_manners = manners

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, overrides: dict | None = None, **how) -> CrawlJob:
        return cls(spark, config.settings(config.read_file(path), overrides or {}), **how)

    @property
    def manners(self) -> live.Manners:
        c = self.cfg["crawler"]
        agents = (c["user_agent"],) if c["user_agent"] else live.Manners().agents
        return self.own_manners or live.Manners(agents, c["max_concurrent"], c["max_per_domain"], c["rate_limit"], connect_timeout=c["connect_timeout"], read_timeout=c["read_timeout"], retries=c["max_retries"])

    def _sink(self) -> sinks.Sink | None:
        kind, path = self.cfg["storage"]["type"], self.cfg["storage"]["path"]
        if self.sink is not None or kind == "none":
            return self.sink
        if kind in ("sqlite", "parquet"):
            return sinks.StoreSink(self.spark, path)
        return sinks.SingleFileSink(path, kind, lines=path.endswith((".jsonl", ".ndjson")))

    def _listed(self, found: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(zip(found, range(len(found)))), "url string, pos int")

    def run(self, snapshot: DataFrame | None = None, sitemap_files: DataFrame | None = None, robots_files: DataFrame | None = None) -> Result:
        """snapshot: (url, html[, status_code, content_type]); sitemap_files: (url, payload); robots_files: (origin, status, body).

        What is None is fetched live. With a snapshot nothing is: settings that need sitemaps or robots then need their
        tables, too.
        """
        began = time.monotonic()
        c, f = self.cfg["crawler"], self.cfg["filters"]
        if snapshot is not None:
            for needed, table, name in ((c["respect_robots"], robots_files, "robots_files"), (self.cfg["sitemaps"], sitemap_files, "sitemap_files")):
                if needed and table is None:
                    raise config.ConfigError(f"over a snapshot these settings need a table of {name}")
        tables: list[Stored] = []

        def kept(df: DataFrame, tag: str) -> DataFrame:
            tables.append(Stored(df, tag))
            return tables[-1].df

        # one session for the whole crawl: breakers, slots and pauses hold from its sitemaps to its last level
        session = live.LiveSession(self.spark, self.manners, on_retry=self.on_retry) if snapshot is None else None
        parts, files_read = [self._listed(self.cfg["start_urls"])], None
        if self.cfg["sitemaps"]:
            payloads = sitemap_files if sitemap_files is not None else lambda asked: session.fetch(asked).select("url", "payload")
            found, files_read = sitemap_tree(payloads, self._listed(self.cfg["sitemaps"]))
            parts.append(found.orderBy("depth", "parent", "pos").select("url", F.monotonically_increasing_id().alias("pos")))
        seeds = kept(frontier.seed_union(*parts).orderBy("part", "pos").select("url", F.monotonically_increasing_id().alias("pos")), "seeds")

        answer = self._answer(snapshot, robots_files, kept, session)
        visited = frontier.crawl(answer, seeds, c["max_pages"], c["max_depth"], c["same_domain_only"], None, f["exclude_patterns"], f["include_patterns"], self._level_seen(began))
        records = kept(store.make_record(visited.where("ok").select("page", "status_code", "content_type")), "records")
        size = F.when(F.col("ok"), F.length("page.text")).otherwise(F.lit(0)).cast("long")
        events = visited.select("url", "ok", F.col("status_code").alias("status"), F.col("kind").alias("error"), size.alias("size"), F.lit(None).cast("timestamp").alias("ts"))
        sink, saved = self._sink(), None
        if sink is not None:
            with sinks.Saver(sink) as saver:
                saver.save(records)
            saved = saver.stats()
        blocked = visited.where(F.col("error") == BARRED).select("url") if c["respect_robots"] else None
        result = Result(visited, records, events, files_read, blocked, saved, time.monotonic() - began, tables, session)
        wanted = self.cfg["report"]
        if wanted["json"] or wanted["html"]:
            figures = result.stats()
            if wanted["json"]:
                report.to_json(figures, wanted["json"])
            if wanted["html"]:
                report.save_html(figures, wanted["html"])
        return result

    def _level_seen(self, began: float) -> Callable[[DataFrame], None]:
        """What is told of each level: its pages to page_callback, and how far the crawl is to progress."""
        so_far = {"done": 0, "failed": 0}

        def tell(level: DataFrame) -> None:
            if self.progress is not None:
                n, failed = level.agg(F.count("*"), F.count_if(~F.col("ok"))).first()
                so_far["done"] += n
                so_far["failed"] += failed
                self.progress(progress.line(total=self.cfg["crawler"]["max_pages"], elapsed=time.monotonic() - began, **so_far))
            if self.page_callback is not None:
                self.page_callback(level)

        return tell

    def _answer(self, snapshot: DataFrame | None, robots_files: DataFrame | None, kept: Callable[[DataFrame, str], DataFrame], session: live.LiveSession | None) -> Callable[[DataFrame], DataFrame]:
        """What a level's URLs are answered with: by the snapshot or live, those that robots.txt forbids failing unasked."""
        c = self.cfg["crawler"]
        if snapshot is None:
            ask = session.fetch
        else:
            has = set(snapshot.columns)
            status = (F.col("status_code") if "status_code" in has else F.lit(200)).cast("int")
            kind = F.col("content_type") if "content_type" in has else F.lit("text/html")
            of = F.struct("html", status.alias("status_code"), kind.alias("content_type"))
            # one row a URL, so that a level's join makes no copies
            pages = snapshot.groupBy(urls.normalize_url(F.col("url")).alias("url")).agg(F.max_by(of, F.coalesce("html", F.lit(""))).alias("r")).select("url", "r.*")
            ask = partial(fetch.fetch, pages=kept(pages, "pages"))
        if not c["respect_robots"]:
            return ask
        agent = c["user_agent"] or "*"
        known: list[DataFrame] = []
        given = robots.robots_table(robots_files) if robots_files is not None else None

        def rules(asked: DataFrame) -> DataFrame:
            if given is not None:
                return given
            new = asked.select(urls.origin(F.col("url")).alias("origin")).distinct()
            for k in known:
                new = new.join(k, "origin", "left_anti")
            known.append(kept(robots.robots_table(live.robots_files(new, self.manners)), "robots"))
            out = known[0]
            for k in known[1:]:
                out = out.union(k)
            return out

        def obedient(asked: DataFrame) -> DataFrame:
            table = rules(asked)
            seen = kept(robots.can_fetch(asked.where("url is not null").select("url").distinct(), table, agent), "allowed")
            delay = table.select(F.col("origin").alias("__origin"), robots.crawl_delay(F.col("parsed"), agent).alias("crawl_delay"))
            free = seen.where("allowed").join(delay, urls.origin(F.col("url")) == F.col("__origin"), "left").select("url", F.coalesce("crawl_delay", F.lit(0.0)).alias("crawl_delay"))
            none = F.lit(None).cast("string")
            barred = seen.where("not allowed").select("url", none.alias("html"), F.lit(None).cast("int").alias("status_code"), F.lit("").alias("content_type"), F.lit("PermanentError").alias("kind"), F.lit(BARRED).alias("error"))
            got = ask(free)
            tries = F.col("attempts") if "attempts" in got.columns else F.lit(1)
            return got.select(*barred.columns, tries.cast("int").alias("attempts")).union(barred.withColumn("attempts", F.lit(0)))

        return obedient
