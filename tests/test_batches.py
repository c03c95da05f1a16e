"""Python functions over Arrow batches: what they hold at once, and how often they run."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from webweft.functions import batches, html_native, html_tokens, html_tree
from webweft.operators import store


def test_a_batch_is_taken_out_of_arrow_in_parts():
    pages = pa.array([f"<p>{i} " + "word " * 1_000 for i in range(4_000)])
    take = batches.in_parts(lambda h: None if h is None else h.upper(), pa.string())
    tracemalloc.start()
    got = take(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000 and got[3_999].as_py() == pages[3_999].as_py().upper() and len(got) == 4_000
    assert take(pa.array([None, "a"])).to_pylist() == [None, "A"] and len(take(pages[:0])) == 0


def test_records_parse_each_page_once(spark):
    pages = spark.createDataFrame([(1, "http://a.test/", "<title>t</title><a href=/b>c</a>"), (2, "", "x"), (3, None, None)], "page_id long, url string, html string")
    records = store.make_record(html_tree.parse_pages(pages), F.timestamp_seconds(F.lit(0)))
    assert [(r.url, r.title, r.links) for r in records.collect()] == [("http://a.test/", "t", ["http://a.test/b"])]
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_links_of_many_pages(spark):
    n = 3 * batches.ROWS + 1
    pages = spark.range(n).coalesce(1).select(F.lit("http://a.test/").alias("base"), F.concat(F.lit("b"), "id", F.lit("&amp;c")).alias("href"), (F.col("id") % 2 == 0).alias("done"))
    got = [r[0] for r in pages.select(html_tokens.link_of(F.col("base"), F.col("href"), F.col("done"))).collect()]
    assert got == [f"http://a.test/b{i}&{'amp;' * (i % 2 == 0)}c" for i in range(n)]


def test_links_take_one_python_step(spark):
    simple, hard, odd = "<a href=/a>x</a><a href='http://o.test/b'>x</a>", "<a href=/a>x</a><a href=b?c#d>x</a><a href='mailto:x'>x</a><a href='/e&eacute;'>x</a>", "<!-- --><a href=/a>x</a><a href=../b>x</a><a href='#d'>x</a><a href='http://[bad'>x</a>"
    base = "http://h.test/p/q"
    pages = [(1, base, simple), (2, base, hard), (3, base, odd), (4, None, simple), (5, None, "<!-- --><a href=/a>x</a>"), (6, "http://[bad", simple), (7, base, None), (8, base, "")]
    links = html_native.links(spark.createDataFrame(pages, "page_id int, url string, html string"))
    # each step would be one more worker in every task of an executor
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    want = {(1, 0, "http://h.test/a"), (1, 1, "http://o.test/b"), (2, 0, "http://h.test/a"), (2, 1, "http://h.test/p/b?c"), (2, 3, "http://h.test/eé"), (3, 0, "http://h.test/a"), (3, 1, "http://h.test/b"), (4, 1, "http://o.test/b"), (6, 1, "http://o.test/b")}
    assert {(r.page_id, r.pos, r.link) for r in links.collect()} == want
