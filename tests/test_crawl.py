"""Traversal, whole jobs and the command line, over graphs of our own: cycles, diamonds, dead ends, ties in the budget."""

import json
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from webweft.operators import fetch, frontier
from webweft.plans import cli, config, progress, report
from webweft.plans.job import BARRED, CrawlJob
from webweft.streaming import events

HOST = "https://garden.example"
#: A diamond (rose, iris to bulb), a cycle (bulb to the gate), a lost page, one that answers 503, and a guest site.
GARDEN = {
    "/gate": ["rose", "./iris", "/gate#here", "https://guest.example/in"],
    "/rose": ["bulb?x=1", "thorn"],
    "/iris": ["bulb?x=1", "/weed"],
    "/bulb?x=1": ["/gate", "/root"],
    "/root": ["/seed"],
    "/seed": [],
    "/weed": ["/never"],
    "/never": [],
}
STATUS = {"/weed": 503}


def page(hrefs):
    return "<title>t</title><body>" + " ".join(f"<a href='{h}'>to</a>" for h in hrefs)


@pytest.fixture(scope="module")
def garden(spark):
    rows = [(HOST + p, page(h), STATUS.get(p, 200)) for p, h in GARDEN.items()] + [("https://guest.example/in", page([]), 200)]
    return spark.createDataFrame(rows, "url string, html string, status_code int")


def walk(spark, garden, start="/gate", **how):
    seeds = spark.createDataFrame([(HOST + start, 0)], "url string, pos int")
    got = frontier.crawl(partial(fetch.fetch, pages=garden), seeds, **({"same_domain_only": True, "max_depth": 9} | how))
    return {r.url.removeprefix(HOST): r for r in got.collect()}


def test_levels(spark, garden):
    want = [{"/gate"}, {"/gate", "/rose", "/iris"}, {"/gate", "/rose", "/iris", "/bulb?x=1", "/thorn", "/weed"}]
    for depth, urls in enumerate(want):
        assert set(walk(spark, garden, max_depth=depth)) == urls
    got = walk(spark, garden)
    assert set(got) == set(GARDEN) - {"/never"} | {"/thorn"}
    assert {u for u, r in got.items() if not r.ok} == {"/thorn", "/weed"}
    assert (got["/thorn"].kind, got["/weed"].kind, got["/weed"].status_code) == ("NetworkError", "TransientError", 503)
    assert [got[u].depth for u in ("/bulb?x=1", "/root", "/seed")] == [2, 3, 4]
    assert got["/thorn"].page.errors == ["fetch: no answer"] and got["/gate"].page.title == "t"


@pytest.mark.parametrize("small", [True, False])
def test_budget_order_and_patterns(spark, garden, small, monkeypatch):
    if not small:
        monkeypatch.setattr(frontier, "SMALL", 0)
    # the first links of the first page come first, and failures count
    assert set(walk(spark, garden, max_pages=2)) == {"/gate", "/rose"}
    assert set(walk(spark, garden, max_pages=5)) == {"/gate", "/rose", "/iris", "/bulb?x=1", "/thorn"}
    assert "https://guest.example/in" in walk(spark, garden, same_domain_only=False)
    assert "https://guest.example/in" in walk(spark, garden, allowed_domains=["www.guest.example"])
    assert set(walk(spark, garden, exclude=["bulb"])) == {"/gate", "/rose", "/iris", "/thorn", "/weed"}
    assert set(walk(spark, garden, include=["gate$", "iris$", "weed$"])) == {"/gate", "/iris", "/weed"}
    with pytest.raises(ValueError):
        walk(spark, garden, max_pages=0)


def test_callbacks(spark, garden):
    seen = []

    def tell(level):
        seen.append({r.url.removeprefix(HOST) for r in level.select("url").collect()})
        raise RuntimeError("a listener's trouble")

    walk(spark, garden, max_depth=1, page_callback=tell)
    assert seen == [{"/gate"}, {"/rose", "/iris"}]


@pytest.mark.parametrize("budget", [50, 1 << 30])
def test_edges_with_cycles_nulls_and_nothing(spark, budget):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("a", "a", 1), ("a", None, 2), ("b", "", 3), ("a", "b", 4)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("a", 1), (None, 0), ("", 0), ("z", 2), ("a", 3)], "node string, pos int")
    got = [(r.node, r.depth, r["rank"]) for r in frontier.traverse_edges(edges, seeds, 9, budget).orderBy("depth", "rank").collect()]
    assert [g[:2] for g in got] == [("a", 0), ("z", 0), ("b", 1), ("c", 2)] and got[0][2] < got[1][2]
    assert frontier.traverse_edges(edges.limit(0), seeds.limit(0), 9, budget).count() == 0


def test_priority_queue(spark):
    offers = [("low", 1, 0), ("high", 9, 1), ("low", 7, 2), ("same", 9, 3), ("none", 0, 4)]
    assert [r.item for r in frontier.pop_order(spark.createDataFrame(offers, "item string, priority int, seq int")).collect()] == ["high", "same", "low", "none"]


def settings(tmp_path, **more):
    return {"start_urls": [HOST + "/gate"], "crawler": {"max_pages": 30, "max_depth": 9, "same_domain_only": True}, "storage": {"type": "json", "path": str(tmp_path / "out.json")}} | more


def test_whole_job(spark, garden, tmp_path):
    maps = spark.createDataFrame([(HOST + "/map.xml", f"<urlset><url><loc>{HOST}/never</loc></url></urlset>".encode())], "url string, payload binary")
    cfg = settings(tmp_path, sitemaps=[HOST + "/map.xml", HOST + "/no.xml"], report={"json": str(tmp_path / "s.json"), "html": str(tmp_path / "s.html")})
    with CrawlJob(spark, cfg).run(garden, maps) as got:
        s = got.stats()
        assert (s["total_pages"], s["successful"], s["failed"]) == (9, 7, 2) and s["status_codes"] == {"200": 7, "503": 1}
        assert s["errors"] == {"NetworkError": 1, "TransientError": 1} and s["sitemaps"] == {"fetched": 1, "failed": 1}
        assert s["crawl"]["processed"] == 7 and s["crawl"]["queued"] == 0 and s["crawl"]["pages_per_second"] > 0
        assert s["storage"]["saved"] == 7 and {r.url for r in got.failed().collect()} == {HOST + "/thorn", HOST + "/weed"}
    saved = json.loads((tmp_path / "out.json").read_text())
    assert {r["url"].removeprefix(HOST) for r in saved} == set(GARDEN) - {"/weed"} and saved[0]["metadata"]["title"] == "t"
    assert json.loads((tmp_path / "s.json").read_text())["total_pages"] == 9 and "<html" in (tmp_path / "s.html").read_text()
    got.close()


def test_job_and_robots(spark, garden, tmp_path):
    cfg = settings(tmp_path, storage={"type": "none"})
    cfg["crawler"]["respect_robots"] = True
    with pytest.raises(config.ConfigError):
        CrawlJob(spark, cfg).run(garden)
    robots = spark.createDataFrame([(HOST, 200, "User-agent: *\nDisallow: /iris\nDisallow: /bulb?x\n")], "origin string, status int, body string")
    got = CrawlJob(spark, cfg).run(garden, robots_files=robots)
    assert {r.url.removeprefix(HOST) for r in got.visited.where("ok").collect()} == {"/gate", "/rose"}
    assert {r.url.removeprefix(HOST) for r in got.blocked.collect()} == {"/iris", "/bulb?x=1"} and got.stats()["blocked"] == 2
    assert {r.kind for r in got.visited.where(F.col("error") == BARRED).collect()} == {"PermanentError"}
    nobody = CrawlJob(spark, cfg).run(garden, robots_files=robots.limit(0))
    assert nobody.visited.where("ok").count() == 0


def test_progress_of_a_job(spark, garden, tmp_path):
    lines = []
    CrawlJob(spark, settings(tmp_path, storage={"type": "none"}), progress=lines.append).run(garden)
    assert [x.split()[2] for x in lines] == ["1/30", "3/30", "6/30", "7/30", "8/30"] or len(lines) >= 4
    assert lines[-1].endswith("failed 2")


def test_job_with_its_own_sink(spark, garden, tmp_path):
    from webweft.sources import sinks

    sink = sinks.MemorySink(fail_times=1)
    got = CrawlJob(spark, settings(tmp_path), sink=sink).run(garden)
    assert got.saved["saved"] == len(sink.rows) == 6 and got.saved["retries"] == 1 and sink.closed


WRONG = (
    {"crawlers": {}}, {"crawler": {"speed": 1}}, {"crawler": {"max_pages": 0}}, {"crawler": {"max_depth": 1.5}}, {"crawler": {"max_pages": True}}, {"crawler": {"same_domain_only": "yes"}},
    {"crawler": {"rate_limit": 0}}, {"crawler": []}, {"filters": {"include_patterns": ["("]}}, {"filters": {"exclude_patterns": "x"}}, {"storage": {"type": "tape"}}, {"storage": {"type": "csv", "path": ""}},
    {"logging": {"level": "LOUD"}}, {"start_urls": "x"}, {"start_urls": [1]}, {"sitemaps": ["ftp://x"]}, ["crawler"], {"crawler": {"user_agent": 5}},
)


@pytest.mark.parametrize("bad", WRONG)
def test_wrong_settings(bad):
    with pytest.raises(config.ConfigError):
        config.settings(bad)


def test_layers_of_settings():
    one = config.settings({"crawler": {"max_depth": 7}, "report": None}, {"crawler": {"max_pages": 3}, "logging": {"level": "warning"}})
    assert (one["crawler"]["max_depth"], one["crawler"]["max_pages"], one["crawler"]["max_retries"], one["logging"]["level"]) == (7, 3, 2, "WARNING")
    one["start_urls"].append("x")
    assert config.settings()["start_urls"] == [] and config.settings({"crawler": {"rate_limit": None}})["crawler"]["rate_limit"] is None
    assert config.settings(config.settings(one)) == one


def test_settings_files(tmp_path):
    (tmp_path / "a.yaml").write_text("crawler:\n  max_depth: 6\n")
    (tmp_path / "b.json").write_text('{"start_urls": ["http://x/"]}')
    (tmp_path / "empty.yml").write_text("")
    assert config.read_file(str(tmp_path / "a.yaml")) == {"crawler": {"max_depth": 6}} and config.read_file(str(tmp_path / "empty.yml")) == {}
    assert config.settings(config.read_file(str(tmp_path / "b.json")))["start_urls"] == ["http://x/"]
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "other.ini").write_text("")
    for name in ("broken.json", "other.ini", "none.json"):
        with pytest.raises(config.ConfigError):
            config.read_file(str(tmp_path / name))


def test_command_line(spark, garden, tmp_path):
    snap, robots = str(tmp_path / "snap"), str(tmp_path / "robots")
    garden.write.parquet(snap)
    spark.createDataFrame([(HOST, 200, "User-agent: *\nDisallow: /rose\n")], "origin string, status int, body string").write.parquet(robots)
    assert cli.main(["--snapshot", snap], spark) == 2
    assert cli.main([HOST + "/gate", "--config", str(tmp_path / "none.json")], spark) == 2
    (tmp_path / "c.json").write_text(json.dumps({"crawler": {"max_depth": 9}, "logging": {"file": None}}))
    base = [HOST + "/gate", "--snapshot", snap, "--config", str(tmp_path / "c.json"), "--max-depth", "1", "--same-domain"]
    assert cli.main([*base, "--respect-robots"], spark) == 2
    out, errors = str(tmp_path / "o.csv"), str(tmp_path / "e.txt")
    assert cli.main([*base, "--respect-robots", "--robots-files", robots, "--output", out, "--errors", errors], spark) == 0
    assert len(open(out).read().splitlines()) == 3
    assert f"{HOST}/rose: {BARRED}" in open(errors).read()


def test_reports():
    html = report.to_html({"total_pages": 1, "errors": {"<i>x</i>": 1}, "status_codes": {"200": 8, "503": 1}, "top_domains": [{"domain": "a&b", "pages": 2}]})
    assert "<i>x</i>" not in html and "&lt;i&gt;x" in html and "a&amp;b" in html
    assert report.bar_width(1, 800) == 2 and report.bar_width(8, 8) == 100
    text = report.error_text({"errors_by_type": {"NetworkError": 2}, "retry": {"retries": 1}, "permanent": [], "n_failed_urls": 1, "failed": {"http://x/": "gone"}, "breaker": []}, {"failed": 3, "errors": ["disk"]})
    assert "NetworkError: 2" in text and "http://x/: gone" in text and "failed rows: 3" in text and text.count("  none") == 2


def test_fetch_and_parse(spark, garden):
    asked = spark.createDataFrame([(HOST + "/rose",), (HOST + "/lost",), (HOST + "/rose",), (None,)], "url string")
    got = {r.url.removeprefix(HOST): r for r in fetch.fetch_and_parse(asked, garden).collect()}
    assert set(got) == {"/rose", "/lost"} and got["/rose"].page.links == [HOST + "/bulb?x=1", HOST + "/thorn"] and got["/rose"].page.errors == []
    assert got["/lost"].kind == "NetworkError" and got["/lost"].page.links == []
    assert fetch.fetch_and_parse(asked.limit(0), garden.limit(0)).count() == 0


def test_progress_lines():
    assert progress.line(3, 12, 6.0, 2, 1) == "[#####---------------]  25% 3/12 | 0.5/s | left 18 s | active 2 | failed 1"
    assert "left -" in progress.line(0, 10, 0.0) and "100%" in progress.line(5, 5, 1.0)
    seen = []
    with progress.Monitor(lambda: {"done": 1, "total": 2, "elapsed": 1.0}, 0.01, seen.append):
        time.sleep(0.05)
    assert len(seen) >= 2


def test_batch_progress(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = []
    listener = progress.BatchProgress(10, seen.append)
    spark.streams.addListener(listener)
    events.run_available(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), "append")
    for _ in range(50):
        if seen:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.done == 10 and "10/10" in seen[-1]
