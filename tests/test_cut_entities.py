"""Queries of pages whose text was cut within an entity, against their SQL in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from webweft.functions import html_native, html_tokens, html_tree
from webweft.plans import catalog

#: What is left of an entity at the end of a title, as in the driver's tables; and whole ones.
LEFT = ("&quot", "&quo", "&amp", "&am", "&a", "&", "&lt", "&gt", "&copy", "&middot", "&quot;", "&amp;", "&quotx", "&ampquot;", "&amp;quot;")


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cut")
    page = "<html><head><title>a = {0}</title><script>var t=\"</p>\";</script></head><body><ul><li><a href=\"/x\">a {0}</a></li></ul><!-- {0} --><h1>a = {0}</h1><p><b>{0}b = &quot;c&quot; {0}<br><p>d</p><footer>&copy; e &middot; f</footer>"
    rows = [(i, f"http://a.test/p/{i}", page.format(e)) for i, e in enumerate(LEFT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    return str(at)


def same_as_sql(spark, name, at):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet/*.parquet'")
        got = db.execute(catalog.ORACLE[name])
        order = [c[0] for c in got.description]
        want = sorted(got.fetchall())
    assert len(want) == len(LEFT)
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, at).select(*order).collect()) == want


QUERIES = ("html_text", "html_summary", "page_parse", "record_make", "sink_csv_roundtrip", "sink_json_roundtrip", "sink_store_upsert")


@pytest.mark.parametrize("name", QUERIES)
def test_cut_entities_as_in_sql(spark, cut, name):
    same_as_sql(spark, name, cut)


def test_ended_entities():
    cases = {"&quot<": "&quot<", "&quot;<": '"<', "&amp &am": "& &am", "&ampquot;": "&quot;", "&eacute;&eacute &#233;&#233 ": "é&eacute éé ", "&nope;&notit;": "&nope;&notit;", "": ""}
    assert {k: html_tokens.unescape_ended(k) for k in cases} == cases


def test_tree_of_ended_entities():
    page = "<title>t &quot</title><a href='/a?x&copy&amp;y=&lt;z&quot' title=\"&lt\">\ue000 &quot &am; &amp &eacute;</a><textarea>&lt <i>&lt;</textarea><img src=/i&copy=1 alt=&copy>"
    fields = lambda **how: [(p["title"], p["text"], p["links"], p["images"], p["errors"]) for p in [html_tree.parse_page(page, "http://a.test/", **how)]][0]
    links, images = ['http://a.test/a?x©&y=<z"'], [{"src": "http://a.test/i&copy=1", "alt": "©"}]
    assert fields() == ('t "', 't " \ue000 " &am; & é < <i><', links, images, [])
    assert fields(ended=True) == ("t &quot", "t &quot \ue000 &quot &am; & é &lt <i><", links, images, [])
    assert html_tree.parse_page(None, "http://a.test/", ended=True)["text"] == ""


def test_native_text_decodes_as_the_standard_does_by_default(spark):
    rows = spark.createDataFrame([("<p>a &quot</p>",), ("<p>b &quot &eacute;</p>",), ("<p>c &copy 1 &amp 2</p>",), (None,)], "h string")
    got = [tuple(r) for r in rows.select(html_native.text(F.col("h")), html_native.text(F.col("h"), ended=True)).collect()]
    assert got == [('a "', "a &quot"), ('b " é', "b &quot é"), ("c © 1 & 2", "c &copy 1 & 2"), (None, None)]
