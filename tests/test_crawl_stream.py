"""Live crawls as streams: they stop, die and go on, and ask for no page twice."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_live_session import Site, sites  # noqa: F401

from webweft.operators.breaker import Breaker
from webweft.sources import live
from webweft.streaming.crawl import CrawlStream

PAGES = {"/": "<a href=/a>a</a><a href=/b>b</a>", "/a": "<a href=/c>c</a><a href=/>r</a>", "/b": "<a href=/c>c</a><a href='/bad'>x</a><a href='http://else.test/'>e</a>", "/c": "<a href=/d>d</a>", "/d": "<a href=/e>e</a>", "/e": "e"}
QUICK = live.Manners(retries=0, base=0.01, most_delay=0.01)


def paths(df, site):
    return {(r.url.removeprefix(site.url("")), r.depth, r.ok) for r in df.collect()}


def test_a_crawl_that_is_stopped_and_goes_on(spark, sites, tmp_path):  # noqa: F811
    site = sites(pages=PAGES)
    at = str(tmp_path / "crawl")
    one = CrawlStream(spark, at, QUICK, max_depth=3, same_domain_only=True)
    one.seed([site.url("/"), site.url("/#x")])
    q = one.start(availableNow=True)  # the first level alone
    q.awaitTermination()
    assert len(one._numbers("pages")) >= 1 and len(site.seen) < 6
    # another driver, as it were
    two = CrawlStream(spark, at, QUICK, max_depth=3, same_domain_only=True)
    two.seed([site.url("/")])
    assert two.run() == 6
    assert paths(two.pages(), site) == {("/", 0, True), ("/a", 1, True), ("/b", 1, True), ("/c", 2, True), ("/bad", 2, False), ("/d", 3, True)}
    assert two.run() == 6 and set(Counter(s[1] for s in site.seen).values()) == {1}


def test_a_batch_that_dies_after_its_pages_are_stored(spark, sites, tmp_path, monkeypatch):  # noqa: F811
    site = sites(pages=PAGES)
    at = str(tmp_path / "crawl")
    stream = CrawlStream(spark, at, QUICK, max_depth=3, same_domain_only=True)
    stream.seed([site.url("/")])
    add, died = CrawlStream._add, []

    def dies(self, rows, number):
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("the driver dies")
        add(self, rows, number)

    monkeypatch.setattr(CrawlStream, "_add", dies)
    with pytest.raises(Exception, match="dies"):
        stream.run()
    assert died and CrawlStream(spark, at, QUICK, max_depth=3, same_domain_only=True).run() == 6
    assert set(Counter(s[1] for s in site.seen).values()) == {1}


def test_budget_and_breakers_outlive_a_stop(spark, sites, tmp_path):  # noqa: F811
    site = sites(pages={"/": "".join(f"<a href=/bad{k}>x</a>" for k in range(4)) + "<a href=/ok>y</a>", "/ok": "<a href=/late>z</a>"})
    manners = live.Manners(retries=0, base=0.01, most_delay=0.01, breaker=Breaker(0.5, 3, 6, 60_000_000))
    at = str(tmp_path / "crawl")
    CrawlStream(spark, at, manners, max_depth=2).seed([site.url("/")])
    while len(site.seen) < 2:
        CrawlStream(spark, at, manners, max_depth=2).start(availableNow=True).awaitTermination()
    got = CrawlStream(spark, at, manners, max_depth=2)
    got.run()
    kinds = {r.url.rpartition("/")[2]: r.kind for r in got.pages().collect()}
    assert "CircuitOpenError" in kinds.values() and not site.asked("/late") or kinds.get("ok") == "CircuitOpenError"
    few = CrawlStream(spark, str(tmp_path / "few"), manners, max_pages=2)
    few.seed([site.url("/ok")])
    assert few.run() == 2 and few.frontier().count() == 2
    with pytest.raises(ValueError):
        CrawlStream(spark, str(tmp_path / "none")).pages()


def test_a_stream_of_urls(spark, sites, tmp_path):  # noqa: F811
    site = sites()
    spark.dataSource.register(live.HttpSource)
    urls = [site.url(f"/{k}") for k in range(10)]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def go():
        rows = spark.readStream.format("webweft_http").option("urls", json.dumps(urls)).option("per_batch", 4).load()
        rows.select("url", "status_code", F.length("html").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    go()
    first = len(site.seen)
    assert 4 <= first <= 10
    for _ in range(4):
        go()
    assert Counter(s[1] for s in site.seen) == Counter(f"/{k}" for k in range(10))
    assert {r.url for r in spark.read.parquet(out).collect()} == set(urls)
