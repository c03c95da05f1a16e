"""robots.txt against the standard library itself, sitemap trees and payloads, over files of our own."""

import gzip
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from webweft.functions import robots, sitemap
from webweft.sources.sitemaps import payloads_of, sitemap_stats, sitemap_tree, sitemaps_of

SITE = "http://r.example"
FILES = {
    "queries and signs": "User-agent: *\nDisallow: /find?q=\nDisallow: /café\nDisallow: /a%2Fb\nAllow: /c d/open\nDisallow: /c d/\nDisallow: /%7Ejoe\nDisallow: /p;x\n",
    "two agents": "User-agent: Alpha\nUser-agent: beta\nDisallow: /one\n\nUser-agent: *\nDisallow: /two\nCrawl-delay: 4\n",
    "order decides": "User-agent: *\nDisallow: /x\nAllow: /x/y\nAllow: /z/y\nDisallow: /z\n",
    "no agent first": "Disallow: /lost\nAllow: /\n\nUser-agent: gamma\nCrawl-delay: 3\nDisallow: /t\nCrawl-delay: 1.5\n",
    "wild": "User-agent: *\nDisallow: /*.pdf\nDisallow: *\n",
    "empty rule": "User-agent: beta\nDisallow:\n\nUser-agent: *\nDisallow: /\n",
    "nothing": "",
    "comments": "# all\nUser-agent: * # any\nDisallow: /one # and below\nSitemap: /rel.xml\nSitemap: http://r.example/m.xml\n",
    "star and name": "User-agent: *\nUser-agent: alpha\nDisallow: /s\n\nUser-agent: alphabet\nAllow: /s\n",
}
AGENTS = ("*", "alpha", "Beta/2.1", "gamma/1", "alphabet soup", "none")
PATHS = ("", "/", "/find", "/find?q=1", "/find?p=1&q=", "/café/1", "/caf%C3%A9", "/a%2Fb/c", "/a/b", "/a%252Fb", "/c%20d/x", "/c d/open/1", "/%7ejoe/", "/~joe", "/one/1", "/two?x#y", "/x/y", "/z/y", "/z", "/t", "/lost", "/doc.pdf", "/*.pdf", "/p;x=1", "/s/1", "?q=1", "/%zz", "/é?ü=ö")


def test_every_file_against_the_library(spark):
    rows = [(f"http://h{i}.example", 200, body) for i, body in enumerate(FILES.values())]
    table = robots.robots_table(spark.createDataFrame(rows, "origin string, status int, body string"))
    pages = spark.createDataFrame([(i, f"http://h{i}.example{p}") for i in range(len(FILES)) for p in PATHS], "i int, url string").repartition(4)
    wrong = []
    for agent in AGENTS:
        parsers = []
        for body in FILES.values():
            p = RobotFileParser()
            p.parse(body.splitlines())
            parsers.append(p)
        got = robots.can_fetch(pages, table, agent).collect()
        assert len(got) == len(FILES) * len(PATHS)
        wrong += [(agent, r.url, r.allowed) for r in got if r.allowed != parsers[r.i].can_fetch(agent, r.url)]
        delays = {r.origin: r.d for r in table.select("origin", robots.crawl_delay(F.col("parsed"), agent).alias("d")).collect()}
        wrong += [(agent, o, d) for (o, _, _), p in zip(rows, parsers) if (d := delays[o]) != float(p.crawl_delay(agent) or 0)]
    assert wrong == []


def test_states_unknown_origins_and_nulls(spark):
    pages = spark.createDataFrame([(SITE + "/one",), (None,), ("http://[x/one",), (SITE + "/one",)], "url string")
    answers = {}
    for status in (200, 301, 404, 410, 429, 500, None):
        table = robots.robots_table(spark.createDataFrame([(SITE, status, FILES["comments"])], "origin string, status int, body string"))
        got = robots.can_fetch(pages, table).collect()
        assert len(got) == 4 and not any(r.allowed for r in got if r.url is None or "[" in r.url)
        answers[status] = {r.allowed for r in got if r.url == SITE + "/one"}
        if status == 200:
            assert robots.describe(table).first().sitemaps == ["/rel.xml", "http://r.example/m.xml"] and robots.describe(table).first().url == SITE + "/robots.txt"
    assert answers == {200: {False}, 301: {False}, 404: {True}, 410: {True}, 429: {False}, 500: {False}, None: {False}}
    assert robots.can_fetch(pages.limit(0), table).count() == 0
    assert [r.allowed for r in robots.can_fetch(pages.limit(1), table.limit(0)).collect()] == [False]


def xml(kind, *locs, ns=' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'):
    item = "sitemap" if kind == "sitemapindex" else "url"
    return (f"<?xml version='1.0'?><{kind}{ns}>" + "".join(f"<{item}><loc> {x} </loc><lastmod>2026</lastmod></{item}>" for x in locs) + f"</{kind}>").encode()


def test_sitemap_tree(spark):
    files = [
        (f"{SITE}/top.xml", xml("sitemapindex", "/left.xml", "right.xml.gz", "/bad.xml", "/gone.xml", "/top.xml", "/deep.xml")),
        (f"{SITE}/left.xml", xml("urlset", "/l1", "/both")),
        (f"{SITE}/right.xml.gz", gzip.compress(xml("urlset", "/both", "https://far.example/r", "mailto:x", ns=""))),
        (f"{SITE}/bad.xml", b"<urlset><url>"),
        (f"{SITE}/deep.xml", xml("sitemapindex", "/list.txt", "/left.xml")),
        (f"{SITE}/list.txt", b"\xef\xbb\xbf/t1\n# none\n\nhttp://far.example/t2\n"),
    ]
    table = spark.createDataFrame(files, "url string, payload binary")
    roots = spark.createDataFrame([(f"{SITE}/top.xml", 0), (None, 1)], "url string, pos int")
    found, read = sitemap_tree(table, roots)
    assert [r.url for r in found.orderBy("depth", "parent", "pos").collect()] == [f"{SITE}/l1", f"{SITE}/both", "https://far.example/r", f"{SITE}/t1", "http://far.example/t2"]
    assert {r.sitemap_url.removeprefix(SITE) for r in read.where("error is not null").collect()} == {"/bad.xml", "/gone.xml"}
    assert sitemap_stats(read).first().asDict() == {"fetched": 5, "failed": 2}
    shallow, read = sitemap_tree(payloads_of(table), roots, max_depth=1)
    assert shallow.count() == 3 and {r.sitemap_url.removeprefix(SITE) for r in read.where("error like 'more than%'").collect()} == {"/deep.xml"}
    assert sitemap_tree(table, roots.limit(0))[0].count() == 0


@pytest.mark.parametrize("data", [b'<!DOCTYPE x [<!ENTITY a "b">]><urlset/>', b"<html/>", b"\x1f\x8bnope", None, b"<urlset"])
def test_payloads_that_are_refused(data):
    got = sitemap.parse_sitemap(data, SITE)
    assert got["error"] and got["locs"] == [] and got["kind"] is None


def test_gunzip_is_bounded():
    assert sitemap.unpack(gzip.compress(b"x" * 1000), 1000) == b"x" * 1000
    with pytest.raises(ValueError):
        sitemap.unpack(gzip.compress(b"x" * 1001), 1000)


def test_table_functions(spark):
    sitemap.SitemapLocations.register(spark)
    got = spark.sql("SELECT loc, error FROM sitemap_locations(CAST('<urlset><url><loc>/x</loc></url></urlset>' AS BINARY), 'http://a/')").collect()
    assert [tuple(r) for r in got] == [("http://a/x", None)]
    robots.RobotsRules.register(spark)
    got = spark.sql("SELECT agent, allow, prefix FROM robots_rules('User-agent: a\nUser-agent: b\nDisallow: /x y\n')").collect()
    assert [tuple(r) for r in got] == [("a", False, "/x%20y"), ("b", False, "/x%20y")]


def test_sitemap_tree_without_a_limit(spark):
    n = sitemap.MOST_URLS + 1
    text = "\n".join(f"http://a.test/{i}" for i in range(n)).encode()
    files = spark.createDataFrame([("http://a.test/s.txt", text)], "url string, payload binary")
    roots = spark.createDataFrame([("http://a.test/s.txt", 0)], "url string, pos int")
    assert sitemap_tree(files, roots)[0].count() == n - 1 and sitemap_tree(files, roots, max_urls=None)[0].count() == n


def test_discovery(spark):
    table = robots.robots_table(spark.createDataFrame([(SITE, 200, FILES["comments"]), ("http://n.example", 404, None)], "origin string, status int, body string"))
    assert {(r.origin, r.url) for r in sitemaps_of(table).collect()} == {(SITE, "/rel.xml"), (SITE, "http://r.example/m.xml"), ("http://n.example", "http://n.example/sitemap.xml")}


def test_queries_over_all_ids(spark, sf, tmp_path):
    from webweft.plans import catalog

    ids = [*range(40), 20_001, 100_000_000, 100_000_001]
    spark.createDataFrame([(i, f"https://a.test/{i}", "") for i in ids], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {f"https://a.test/{i}" for i in ids}
    assert {r.url for r in catalog.QUERIES["url_prefix_pushdown"](spark, str(tmp_path)).collect()} == want
    got = catalog.QUERIES["sitemap_tree"](spark, str(tmp_path)).collect()
    packed = {f"http://gz.test/{i}" for i in range(3)}
    assert {r.url for r in got} == want | packed and len(got) == len(ids) + 3
    log = catalog.request_log(spark, sf)
    calls = sum(-(-r["count"] // 4) for r in log.groupBy("domain").count().collect())
    assert catalog.QUERIES["retry_stats"](spark, sf).collect()[0].calls == calls
    assert catalog.QUERIES["retry_attempts"](spark, sf).select("url").distinct().count() == calls
    assert all(n in catalog.ORACLE for n in catalog.QUERIES)


def test_prefix_trees(spark):
    """The first rule that starts a path, found in a tree, against all rules one after another; ten thousand rules cost what a few do."""
    import random
    import time

    rng = random.Random(5)
    word = lambda: rng.choice(["a", "ab", "b", "%C3%A9", "x-", "~"])
    path = lambda n: "/" + "/".join(word() + word() for _ in range(rng.randrange(n)))
    files = {
        "few": [(rng.choice(["Allow", "Disallow"]), path(4)) for _ in range(12)],
        "many": [(rng.choice(["Allow", "Disallow"]), path(6)) for _ in range(10_000)],
        "deep": [(rng.choice(["Allow", "Disallow"]), "/" + "a/" * n) for n in rng.sample(range(300), 300)],
        "all": [("Allow", "/a"), ("Disallow", "*"), ("Allow", "/ab")],
        "root": [("Disallow", ""), ("Disallow", "/")],
        "none": [],
    }
    rows = [(f"http://{k}", 200, "User-agent: *\n" + "\n".join(f"{how}: {p}" for how, p in v)) for k, v in files.items()]
    table = robots.robots_table(spark.createDataFrame(rows, "origin string, status int, body string"))
    asked = [(f"http://{k}{path(7)}{rng.choice(['', 'zz', '?q=1'])}",) for k in files for _ in range(150)] + [(f"http://deep/{'a/' * n}b",) for n in range(320)] + [("http://other/x",), (None,)]
    parsed = {f"http://{k}": sorted(robots.parse_robots(b)["rules"], key=lambda r: r["ord"]) for (k, _), (_, _, b) in zip(files.items(), rows)}

    def model(url):
        if url is None or (rules := parsed.get("/".join(url.split("/")[:3]))) is None:
            return False
        p = robots.clean_path(url)
        return next((r["allow"] for r in rules if r["prefix"] in ("", "*") or p.startswith(r["prefix"])), True)

    got = {r.url: r.allowed for r in robots.can_fetch(spark.createDataFrame(asked, "url string"), table).collect()}
    assert got == {u: model(u) for u, in asked} and 100 < sum(got.values()) < len(got) - 100
    many = spark.range(20_000).selectExpr("'http://many/ab/' || id AS url")
    start = time.time()
    assert robots.can_fetch(many, table).count() == 20_000
    robots.can_fetch(many, table).agg({"allowed": "count"}).collect()
    assert time.time() - start < 20
