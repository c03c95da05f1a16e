"""spark-submit entry: webweft.plans.cli URL... [--config FILE] [--snapshot PATH] [overrides]. Exit 0, 2 for wrong settings, 130 when interrupted."""

from __future__ import annotations

import argparse
import logging
import sys
from logging.handlers import RotatingFileHandler

from pyspark.sql import SparkSession

from webweft.functions.urls import format_of_path
from webweft.operators.stats import error_stats
from webweft.plans import config, report
from webweft.plans.job import CrawlJob


def setup_logging(cfg: dict) -> logging.Logger:
    """A log file that rotates by size, and warnings on the console."""
    log = logging.getLogger("webweft")
    close_logging()
    log.setLevel(cfg["level"])
    if cfg["file"]:
        file = RotatingFileHandler(cfg["file"], maxBytes=cfg["max_bytes"], backupCount=cfg["backup_count"], encoding="utf-8")
        file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(file)
    console = logging.StreamHandler()
    console.setLevel("WARNING")
    log.addHandler(console)
    return log


def close_logging() -> None:
    log = logging.getLogger("webweft")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()


def arguments(argv: list[str]) -> argparse.Namespace:
    """The schema's flags, and what is no setting: files, and tables of what was fetched."""
    p = argparse.ArgumentParser(prog="webweft")
    p.add_argument("urls", nargs="*")
    p.add_argument("--config")
    p.add_argument("--output")
    p.add_argument("--snapshot", help="Parquet table of url, html[, status_code, content_type]; without one, pages are fetched live")
    p.add_argument("--robots-files", help="Parquet table of origin, status, body")
    p.add_argument("--sitemap-files", help="Parquet table of url, payload")
    p.add_argument("--progress", action="store_true", help="a line after each level")
    p.add_argument("--errors", help="text file for the error report")
    p.add_argument("--sitemap", action="append", default=[], help="sitemap URL, once for each")
    for name, field in config.SCHEMA.items():
        if field.flag:
            how = {"action": "store_true"} if field.kind is None else {"type": field.kind}
            p.add_argument(field.flag, dest=name, default=None, **how)
    return p.parse_args(argv)


def settings(a: argparse.Namespace) -> dict:
    """The file's settings, with what the command line names in their place."""
    over: dict = {}
    for name in config.SCHEMA:
        if (value := getattr(a, name, None)) is not None:
            section, _, key = name.rpartition(".")
            over.setdefault(section, {})[key] = value
    if a.urls:
        over["start_urls"] = a.urls
    if a.sitemap:
        over["sitemaps"] = a.sitemap
    if a.output:
        over["storage"] = {"type": format_of_path(a.output), "path": a.output}
    return config.settings(config.read_file(a.config) if a.config else {}, over)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = arguments(sys.argv[1:] if argv is None else argv)
        cfg = settings(a)
        if not cfg["start_urls"] and not cfg["sitemaps"]:
            raise config.ConfigError("neither start URLs nor sitemaps")
    except config.ConfigError as e:
        print(f"settings: {e}", file=sys.stderr)
        return 2
    log = setup_logging(cfg["logging"])
    try:
        spark = spark or SparkSession.builder.appName("webweft").getOrCreate()
        tables = (spark.read.parquet(path) if path else None for path in (a.snapshot, a.sitemap_files, a.robots_files))
        with CrawlJob(spark, cfg, progress=print if a.progress else None).run(*tables) as result:
            figures = result.stats()
            if a.errors:
                report.save_error_text(a.errors, error_stats(result.attempts(), result.failed(), result.breakers()), result.saved)
        log.info("visited %d pages, %d failed", figures["total_pages"], figures["failed"])
        print(f"pages {figures['total_pages']}, ok {figures['successful']}, failed {figures['failed']}")
        return 0
    except config.ConfigError as e:
        print(f"settings: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    finally:
        close_logging()


if __name__ == "__main__":
    sys.exit(main())
