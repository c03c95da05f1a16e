"""URLs and pages: the native expressions against the standard library, the tree parser on pages that are hard to read."""

import random
from urllib.parse import urldefrag, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from webweft.functions import html_native, html_tree, urls

BASE = "http://shop.example:8080/shelf/row/item?n=3"


def each(spark, values, *cols):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] if len(cols) == 1 else tuple(r)[1:] for r in rows.select("i", *(c(F.col("x")) for c in cols)).orderBy("i").collect()]


def test_normalize_against_the_library(spark):
    given = ["HTTP://Shop.Example", "http://shop.example/a/B?Q=1#z", "http://u:P@H:1/x?", "https://h/%7Ea//b/", "http://h?x", "http://h#y", "/rel/path#f", "rel", ""]
    want = []
    for u in given:
        p = urlsplit(u)
        want.append(f"{p.scheme}://{p.netloc.lower()}{p.path or '/'}{'?' + p.query if p.query else ''}" if p.netloc else u.split("#")[0])
    assert each(spark, given, urls.normalize_url) == want


def test_kinds_of_domain(spark):
    got = each(spark, ["https://www.Shop.example:80/x", "WWW.www.b.c", "//h.i/j", "http://WWW/", None], urls.normalize_domain, urls.domain, urls.origin)
    assert [g[0] for g in got] == ["shop.example:80", "www.b.c", "h.i", "www", None]
    assert got[0][1:] == ("www.shop.example:80", "https://www.shop.example:80") and got[4][1:] == (None, None)


def test_filter(spark):
    given = ["http://a.b/x.zip", "https://www.a.b/keep/1", "http://c.d/keep", "ftp://a.b/", "a.b/x", None, "http:///x"]
    assert each(spark, given, urls.url_filter) == [True, True, True, False, False, False, False]
    assert each(spark, given, lambda c: urls.url_filter(c, ["A.b"])) == [True, True, False, False, False, False, False]
    assert each(spark, given, lambda c: urls.url_filter(c, None, ["zip$", "/1"], ["keep", "zip"])) == [False, False, True, False, False, False, False]


def test_resolution_is_the_librarys(spark):
    """RFC 3986's examples, and references made at random."""
    rng = random.Random(4)
    bases = [BASE, "http://a/b/c/d;p?q", "https://Ex.com", "HTTP://x.y/p/", "http://h/a#f", "http://h?x=1"]
    refs = "g:h g ./g g/ /g //g ?y g?y #s g#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g?y/./x http:g http://G/x/../y? HTTP://Q/x /a//b/../c a//b //q? /x%20y a:b/c http:".split()
    refs += ["", "  /sp \n", "a b.html", "/t\tab"] + ["".join(rng.choice(["a", "/", "..", ".", "?", "b", "//", "#", "%2F"]) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    pairs = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(pairs, "b string, h string").select("b", "h", urls.resolve(F.col("b"), F.col("h")).alias("n"), urls.resolve_any(F.col("b"), F.col("h")).alias("p")).collect()
    wrong = [tuple(r) for r in got if r.n != r.p and (r.p or "").lower().startswith("http") and urlsplit(r.p).netloc]
    assert wrong == []
    assert urls.join_url("http://h/", "http://[bad") is None and urls.join_url("http://h/", None) is None


MENU = """<!doctype html><html><head><title> Soup <!-- of --> of the day</title>
<meta name=description content="  Hot &amp; cold "><meta content="soup,bread" name="keywords"><meta name="keywords" content="second">
<style>h1 { content: "<a href='/style'>" }</style></head>
<body><h1>Soup<i> and</i> bread</h1><h2></h2><h3>Thin</h3><h3>Thick</h3>
<noscript>no script</noscript><script>document.write("<a href='/script'>x</a><h1>no</h1>")</script>
<p>One<p>Two <b>bold</b>tail <!-- <a href="/comment">c</a> -->
<a href='leek?a=1&amp;b=2'>1</a> <a title="a > b" href=/root>2</a><a HREF = "../up/">3</a><a href="//cdn.example/x#y">4</a><a href=" mailto:x@y.z">5</a><a href="tel:1">6</a><a href="#in">7</a><a>8</a><a href=leek?a=1&b=2>9</a>
<img src=p.png><img alt="  Bowl " src="//cdn.example/b.jpg"><img src="data:image/png;base64,x" alt=z><img>
<table><caption>Prices</caption><tr><th>Dish<th>Cost<tr><td>Soup<td>3 <i>or</i> 4<tr></tr></table><table><tr></tr></table>
<ol><li>Peel<li>Cut <ul><li>small<li>large</ul></ol><ul></ul></body></html>"""


def test_every_field():
    p = html_tree.parse_page(MENU, BASE)
    shelf = "http://shop.example:8080"
    assert p["errors"] == [] and p["title"] == "Soupof the day" and p["metadata"] == {"title": "Soupof the day", "description": "Hot & cold", "keywords": "soup,bread"}
    assert p["links"] == [f"{shelf}/shelf/row/leek?a=1&b=2", f"{shelf}/root", f"{shelf}/shelf/up/", "http://cdn.example/x"]
    assert html_tree.links(html_tree.tree(MENU), BASE, same_domain_only=True) == p["links"][:3]
    assert p["images"] == [{"src": f"{shelf}/shelf/row/p.png", "alt": ""}, {"src": "http://cdn.example/b.jpg", "alt": "Bowl"}]
    assert p["headings"] == {"h1": ["Soupandbread"], "h2": [""], "h3": ["Thin", "Thick"]}
    assert p["tables"] == [[["Dish", "Cost"], ["Soup", "3 or 4"]]]
    assert p["lists"] == [{"type": "ol", "items": ["Peel", "Cut small large"]}, {"type": "ul", "items": ["small", "large"]}]
    assert p["text"].startswith("Soup and bread Thin Thick One Two bold tail 1 2") and "script" not in p["text"]


@pytest.mark.parametrize("bad", ["<p>ok</p><![foo[x]]>", "<![", "<!DOCTYPE", "<a href=", "<" * 50, "\x00<p>", "&#xFFFFFFFF;", "<p" + " x" * 5000])
def test_pages_that_can_hardly_be_read(bad):
    p = html_tree.parse_page(bad, BASE)
    assert set(p) >= {"title", "text", "links", "lists"} and (p["errors"] == [] or p["errors"][0].startswith("parse: "))


def test_a_malformed_page_does_not_stop_the_rest(spark):
    rows = spark.createDataFrame([(1, BASE, "<p>ok</p><![foo[x]]>"), (2, BASE, "<title>fine</title>"), (3, BASE, None), (4, None, "<a href='/x'>y</a>"), (5, BASE, "<a href='http://[bad'>x</a><h1>h</h1>")], "k int, url string, html string")
    got = {r.k: r.page for r in html_tree.parse_pages(rows, keep=("k",)).collect()}
    assert got[1].errors[0].startswith("parse: AssertionError") and got[1].links == [] and got[1].headings.h1 == [] and got[1].title == ""
    assert got[2].title == "fine" and got[2].errors == [] and got[3].text == "" and got[3].errors == []
    # one extractor that fails has its default and one entry, the others are intact
    assert got[5].links == [] and len(got[5].errors) == 1 and got[5].errors[0].startswith("links: ValueError") and got[5].headings.h1 == ["h"]
    assert html_tree.parse_pages(rows.limit(0)).count() == 0


def test_rows_cells_and_selectors():
    root = html_tree.tree("<table><tr><td>a<table><tr><td>in<td>ner</table><tr><td>b</table><div class='x y'><p id=q>deep</p></div><p>p")
    assert html_tree.tables(root, BASE) == [[["a in ner", "in", "ner"], ["in", "ner"], ["b"]], [["in", "ner"]]]
    assert html_tree.text(root, BASE, ".y p") == "deep" and html_tree.text(root, BASE, "#q") == "deep" and html_tree.text(root, BASE, "p") == "deep p"


def test_native_links_of_all_forms(spark):
    rows = spark.createDataFrame([(1, BASE, MENU), (2, BASE, None), (3, BASE, ""), (4, None, MENU)], "page_id int, url string, html string")
    got = [r.link for r in html_native.links(rows).where("page_id = 1").orderBy("pos").collect()]
    assert got == html_tree.parse_page(MENU, BASE)["links"]
    assert html_native.links(rows).where("page_id in (2, 3)").count() == 0
    assert each(spark, ["leek?a=1"], lambda c: urls.resolve(F.lit(BASE), c)) == [urldefrag(urljoin(BASE, "leek?a=1"))[0]]


def test_a_tag_that_never_ends(spark):
    endless = "<a " + "word " * 100_000
    rows = spark.createDataFrame([(1, BASE, endless), (2, BASE, "<a " + " ".join(f"k{i}=v" for i in range(40)) + " href=/x>y</a>")], "page_id int, url string, html string")
    assert [(r.page_id, r.link) for r in html_native.links(rows).collect()] == [(2, "http://shop.example:8080/x")]


def test_native_equals_tree(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    native = {r.page_id: (r.title, r.text) for r in pages.select("page_id", html_native.title(F.col("html")).alias("title"), html_native.text(F.col("html")).alias("text")).collect()}
    links = {}
    for r in html_native.links(pages).orderBy("pos").collect():
        links.setdefault(r.page_id, []).append(r.link)
    for r in html_tree.parse_pages(pages, keep=("page_id",)).collect():
        assert native[r.page_id][0] == r.page.title
        assert native[r.page_id][1].split() == r.page.text.split()
        assert links.get(r.page_id, []) == r.page.links


def test_link_unwrap_and_formats(spark):
    got = spark.sql("SELECT struct(CAST(NULL AS STRING) AS url, 'h' AS href) AS a").select(urls.unwrap_link(F.col("a"))).first()[0]
    assert got == "h" and [urls.format_of_path(x) for x in ("a.CSV", "b.db", "c.sqlite3", "d.txt")] == ["csv", "sqlite", "sqlite", "json"]
    agents = [r[0] for r in spark.range(4).orderBy("id").select(urls.user_agent(["one", "two", "three"], F.col("id"))).collect()]
    assert agents == ["one", "two", "three", "one"]
    for bad in ([], [" "], [1]):
        with pytest.raises(ValueError):
            urls.user_agent(bad, F.lit(0))
