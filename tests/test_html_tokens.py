"""The tokenizer, and native links that use it where a page is not plain, against the standard library's parser and the tree."""

import random
from html import unescape
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from webweft.functions import html_native, html_tokens, html_tree

BASE = "http://x.test/b"


def test_entities_in_attributes():
    cases = {
        "a&amp;b": "a&b", "a&b=1&c": "a&b=1&c", "?x&copy=1": "?x&copy=1", "?x&copy;=1": "?x©=1", "?x&copy": "?x©", "&copy!": "©!", "&copyx": "&copyx", "&#38;&#x26;&#38": "&&&", "&eacute;&notin;&notit;": "é∉&notit;", "&lt&gt": "<>",
        "&ampb": "&ampb", "&amp&amp": "&&", "&;&#;&": "&;&#;&", "&NotEqualTilde;": "≂̸", "&#0;&#xD800;": "��", "": "",
    }
    assert {k: html_tokens.attribute_text(k) for k in cases} == cases


def test_tokens():
    t = lambda h: list(html_tokens.tokens(h))
    assert t("a<B C=d e>f&amp;</B x='>'>g") == [("text", "a"), ("start", "b", [("c", "d"), ("e", "")]), ("text", "f&"), ("end", "b"), ("text", "g")]
    assert t("<script>a<b>&amp;</script ><textarea><b>&amp;</textarea>x") == [("start", "script", []), ("text", "a<b>&amp;"), ("end", "script"), ("start", "textarea", []), ("text", "<b>&"), ("end", "textarea"), ("text", "x")]
    assert t("1 < 2 <3") == [("text", "1 < 2 <3")] and t("<") == [("text", "<")] and t("") == [] and t("a<!--b") == [("text", "a")] and t("</>x</3>y") == [("text", "x"), ("text", "y")]
    assert t("<a b='") == [] and t("<a b=c/>") == [("start", "a", [("b", "c/")])] and t("<a =b c = d>") == [("start", "a", [("=b", ""), ("c", "d")])]
    assert html_tokens.text("<title>t</title><body>a<script>b</script> <noscript>c<b>d</b></noscript><i>e</i>&eacute;</body>f") == "a e é" and html_tokens.text(None) == "" and html_tokens.text("p<br>q") == "p q"


PARTS = [
    "<a href='/a?x=1&amp;y=2'>t</a>", "<A HREF=/b>", '<a title="q" href = "/c#f">', "<p class=x>text &eacute; &nope; 1 < 2</p>", "<!-- <a href=/no1> -->", "<script>x='<a href=/no2>'</script>", "<style>a{}</style>", "<a name=x>", "<br/>",
    "<a href='/d?a=1&b=2&#x3d;3'>", "<img src=p.png alt='a b'>", "<a\n\thref='/e'\n>", "<a href='mailto:x'>", "<a href='#top'>", "<b title='<a href=/no3>'>", "<a title='a>b' href=/g>", "<a href>", "<a href=''>", "<a href=/h href=/no4>",
    "<textarea>x <a href=/no5></textarea>", "<a/href=/i>", "<a " + "k=v " * 66 + "href=/j>", "<a data-href=/no6 href=/k>", "<?php <a href=/l>?>", "<a href=/m'n>", "</a href=/no7>", "text", "<a href='/o&lt;'>", "<a title=\"x\"href='/p'>", "<a href=/q/>", "<abbr href=/no8>",
]


class Anchors(HTMLParser):
    """The standard library's view, where it is not known to differ."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (h := next((v for k, v in attrs if k == "href"), 0)) != 0:
            self.found.append(h or "")


@pytest.mark.parametrize("seed", range(3))
def test_anchors_against_the_standard_library(seed):
    rng = random.Random(seed)
    fine = [p for p in PARTS if "textarea" not in p]
    for _ in range(300):
        page = "".join(rng.choice(fine) for _ in range(rng.randrange(12)))
        a = Anchors()
        a.feed(page)
        a.close()
        assert html_tokens.hrefs(page) == a.found


def test_native_links_of_any_page(spark):
    rng = random.Random(9)
    pages = [(i, BASE, "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 9)))) for i in range(400)]
    # whatever is cut off
    pages += [(1000 + i, BASE, h[: rng.randrange(len(h) + 1)]) for i, (_, _, h) in enumerate(pages)]
    pages += [(3000, BASE, None), (3001, BASE, ""), (3002, BASE, "<a href='/x'>" * 2000)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    native = {}
    for r in html_native.links(df).orderBy("pos").collect():
        native.setdefault(r.page_id, []).append(r.link)
    odd = {r.page_id for r in df.where(~html_native.plain(F.col("html"))).collect()}
    assert 100 < len(odd) < 750
    for i, url, h in pages:
        page = html_tree.parse_page(h, url)
        assert page["errors"] or native.get(i, []) == page["links"], h


def test_native_text_of_any_entity(spark):
    rows = [(1, "<body>a &eacute; b &#38; c</body>"), (2, "<body>plain &amp; simple</body>"), (3, "<p title='a > b'>x</p>"), (4, None), (5, "<b>x</b><textarea>&lt;i&gt;</textarea>y")]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k int, h string").select("k", html_native.text(F.col("h")).alias("t")).collect()}
    assert got == {1: "a é b & c", 2: "plain & simple", 3: "x", 4: None, 5: "x <i> y"}
    assert unescape("&eacute;") == "é"
