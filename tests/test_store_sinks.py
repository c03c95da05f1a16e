import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from webweft.operators import store
from webweft.sources import live, readers, sinks

TRICKY = 'a, "b"; c\nd 😀'
AT = dt.datetime(2026, 1, 2, 3, 4, 5, 600000)


def records(spark, n=20, **over):
    rows = [(f"http://example.test/{i}", f"Страница {i}", TRICKY, ["http://example.test/a", "http://example.test/b"], json.dumps({"номер": i}, ensure_ascii=False), AT, 200, "text/html") for i in range(n)]
    df = spark.createDataFrame(rows, store.RECORD)
    return df.withColumns({k: F.lit(v) for k, v in over.items()})


def as_rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*store.FIELDS).collect())


@pytest.mark.parametrize("most_deltas", [1, 16])
def test_upsert_find_and_counts(spark, tmp_path, most_deltas):
    s = store.PageStore(spark, str(tmp_path / "s"), most_deltas)
    assert s.read().count() == 0
    assert s.save(records(spark, 10)) == 10
    first = {r.url: r.id for r in s.read().collect()}
    new = records(spark, 4).where("url like '%/3'").withColumn("title", F.lit("Новый"))
    other = records(spark, 3).withColumn("url", F.replace("url", F.lit("example"), F.lit("other"))).withColumn("status_code", F.when(F.col("url").endswith("0"), 200).otherwise(404))
    assert s.save(new) == 1
    assert s.save(other.union(other)) == 3
    assert s.save(other.limit(0)) == 0
    p = s.read()
    assert p.count() == 13
    assert {r.domain: r.n for r in store.stats_by_domain(p).collect()} == {"example.test": 10, "other.test": 3}
    assert {r.status_code: r.n for r in store.stats_by_status(p).collect()} == {200: 11, 404: 2}
    assert store.find(p, domain="OTHER.test").count() == 3 and store.find(p, status_code=404).count() == 2
    assert store.find(p, title_contains="Новый").count() == 1 and store.find(p, limit=4).count() == 4
    assert store.get(p, "http://example.test/3").first().title == "Новый"
    ids = {r.url: r.id for r in p.collect()}
    assert {u: i for u, i in ids.items() if u in first} == first and max(first.values()) < min(v for k, v in ids.items() if "other" in k)
    before = as_rows(p)
    s.compact()
    s.compact()
    assert as_rows(s.read()) == before and {r.url: r.id for r in s.read().collect()} == ids
    with pytest.raises(ValueError):
        store.find(p, limit=-1)


def test_a_search_by_domain_reaches_the_files(spark, tmp_path):
    s = store.PageStore(spark, str(tmp_path / "s"))
    s.save(records(spark, 3))
    s.save(records(spark, 2))
    plan = store.find(s.read(), domain="example.test")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(domain,example.test)" in plan


def test_like_wildcards_and_ascii_case(spark):
    p = spark.createDataFrame([(1, "http://a/", "ABC def"), (2, "http://a/2", "Жук"), (3, "http://a/3", "a_c")], "id int, url string, title string")
    find = lambda t: [r.id for r in store.find(p, title_contains=t).collect()]
    assert find("abc") == [1] and find("a_c") == [1, 3] and find("b%d") == [1] and find("жук") == [] and find("Жук") == [2]


def test_round_trips(spark, tmp_path):
    r = records(spark)
    want = as_rows(r)
    sinks.JsonLinesSink(str(tmp_path / "j")).write(r)
    sinks.CsvSink(str(tmp_path / "c"), delimiter=";").write(r)
    sinks.SingleFileSink(str(tmp_path / "a.json")).write(r)
    sinks.SingleFileSink(str(tmp_path / "l.json"), lines=True).write(r)
    sinks.SingleFileSink(str(tmp_path / "b.csv"), "csv", encoding="utf-8-sig").write(r)
    assert as_rows(readers.read_json(spark, str(tmp_path / "j"))) == want
    assert as_rows(readers.read_csv(spark, str(tmp_path / "c"), ";")) == want
    assert as_rows(readers.read_csv(spark, str(tmp_path / "b.csv"))) == want
    for name in ("a.json", "l.json"):
        got = readers.read_json(spark, str(tmp_path / name))
        assert as_rows(got.drop("metadata").withColumn("metadata", F.lit(""))) == as_rows(r.withColumn("metadata", F.lit("")))
        assert [json.loads(m.metadata)["номер"] for m in got.where("url like '%/7'").collect()] == [7]


def test_appends_and_encodings(spark, tmp_path):
    path = str(tmp_path / "a.json")
    sinks.SingleFileSink(path).write(records(spark, 0))
    assert json.loads(open(path).read()) == []
    for n in (2, 3):
        sinks.SingleFileSink(path, append=True).write(records(spark, n))
    assert len(json.loads(open(path).read())) == 5
    csv = str(tmp_path / "c.csv")
    sinks.SingleFileSink(csv, "csv", encoding="cp1251").write(records(spark, 1))
    text = open(csv, encoding="cp1251").read()
    assert "Страница 0" in text and "?" in text
    open(csv, "a").write("no end")
    sinks.SingleFileSink(csv, "csv", encoding="cp1251", append=True).write(records(spark, 1))
    assert open(csv, encoding="cp1251").read().count("url,title") == 1


def test_long_cells(spark, tmp_path):
    big = records(spark, 1, text="x" * 600_000)
    sinks.CsvSink(str(tmp_path / "c")).write(big)
    assert len(readers.read_csv(spark, str(tmp_path / "c")).first().text) == 600_000


def test_records_and_validation(spark):
    page = spark.createDataFrame([("http://a/", None, None, ["", "http://b/"])], "url string, title string, text string, links array<string>")
    p = page.select(F.struct("url", "title", "text", "links", F.struct(F.lit("t").alias("title")).alias("metadata")).alias("page"))
    r = store.make_record(p).first()
    assert (r.title, r.text, r.links, r.metadata, r.status_code, r.content_type) == ("", "", ["http://b/"], '{"title":"t"}', None, "")
    with pytest.raises(ValueError):
        store.validate(page)
    good, bad = store.validate(records(spark, 3).withColumn("url", F.when(F.col("url").endswith("1"), "").otherwise(F.col("url"))))
    assert (good.count(), bad.count()) == (2, 1)


def test_wrong_types_and_metadata(spark):
    with pytest.raises(ValueError, match="status_code is string"):
        store.validate(records(spark, 1).withColumn("status_code", F.lit("200")))
    odd = records(spark, 3).withColumn("metadata", F.when(F.col("url").endswith("0"), "[1]").when(F.col("url").endswith("1"), "{").otherwise(F.col("metadata")))
    good, bad = store.validate(odd)
    assert (good.count(), bad.count()) == (1, 2)
    assert store.decoded(records(spark, 1)).select(F.expr("variant_get(metadata, '$.номер', 'int')")).first()[0] == 0


def test_save_retries(spark):
    sink = sinks.MemorySink(fail_times=2)
    assert sinks.save(sink, records(spark, 3), retries=3, delay=0.01) == {"saved": 3, "failed": 0, "retries": 2, "error": None}
    got = sinks.save(sinks.MemorySink(fail_times=9), records(spark, 3), retries=1, delay=0.01)
    assert (got["saved"], got["failed"], got["retries"], got["error"]) == (0, 3, 1, "failure asked for")


def test_a_spark_write_that_fails_is_tried_again(spark, tmp_path):
    (tmp_path / "file").write_text("in the way")
    pauses = []
    for sink in (sinks.JsonLinesSink(f"file://{tmp_path}/file/x"), sinks.CsvSink(f"file://{tmp_path}/file/x"), sinks.StoreSink(spark, f"file://{tmp_path}/file/x"), sinks.SingleFileSink(f"{tmp_path}/file/x")):
        saver = sinks.Saver(sink, retries=2, delay=0.01, sleep=pauses.append)
        saver.save(records(spark, 2))
        s = saver.stats()
        assert (s["saved"], s["failed"], s["retries"], len(s["errors"])) == (0, 2, 2, 3)
    assert pauses == [0.01, 0.02] * 4


def test_saver_accounts_and_recovers(spark):
    sink = sinks.MemorySink(fail_times=2)
    with sinks.Saver(sink, retries=0, every=2, sleep=lambda s: None) as saver:
        saver.save(records(spark, 2))
        assert saver.stats()["pending"] == 1 and sink.rows == []
        saver.save(records(spark, 1))  # two are written together, and fail
        assert saver.stats() | {"errors": 0} == {"saved": 0, "failed": 3, "retries": 0, "pending": 0, "errors": 0}
        sink.fail_times = 0
        saver.save(records(spark, 4))
    assert saver.stats()["saved"] == 7 == len(sink.rows) and saver.stats()["failed"] == 0 and sink.closed


def test_sinks_evaluate_their_input_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    r = records(spark, 5).coalesce(1)
    r = r.mapInArrow(count, r.schema)
    assert sinks.JsonLinesSink(str(tmp_path / "j")).write(r) == 5 and runs.value == 5


class _Answer:
    def __init__(self, body=b"ok", status=200, headers=None):
        from email.message import Message

        self.body, self.status, self.headers = body, status, Message()
        for k, v in ({"Content-Type": "text/html; charset=utf-8"} | (headers or {})).items():
            self.headers[k] = v

    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False

    def read(self, most):
        return self.body[:most]


class Time:
    """A clock that sleeping moves."""

    def __init__(self):
        self.now, self.slept = 1_000_000.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(round(s, 6))
        self.now += s


def fetcher(answers, **manners):
    """answers: what each request gets, a status, an exception or an answer; (status, header) has a Retry-After."""
    from email.message import Message
    from urllib.error import HTTPError

    t, asked, it = Time(), [], iter(answers)

    def opener(request, connect, read):
        asked.append((request.full_url, request.get_header("User-agent"), connect, read, t.now))
        a = next(it)
        if isinstance(a, Exception):
            raise a
        if isinstance(a, _Answer):
            return a
        code, after = a if isinstance(a, tuple) else (a, None)
        if code == 200:
            return _Answer()
        headers = Message()
        if after:
            headers["Retry-After"] = after
        raise HTTPError(request.full_url, code, "no", headers, None)

    return live.Fetcher(live.Manners(**manners), t, t.sleep, opener, lambda: 0.5), t, asked


def test_live_retries():
    from urllib.error import URLError

    f, t, asked = fetcher([503, 503, 200], breaker=None)
    row = f.fetch("http://a/")
    assert row[1:4] == ("ok", b"ok", 200) and row[7] == 3 and t.slept == [1.0, 2.0] and [a[3] for a in asked] == [10.0, 15.0, 22.5]
    f, t, _ = fetcher([404])
    assert f.fetch("http://a/")[5:8:2] == ("PermanentError", 1)
    f, t, _ = fetcher([500] * 3, retries=0)
    assert f.fetch("http://a/")[7] == 3
    f, t, _ = fetcher([URLError("gone")] * 2, retries=1)
    assert f.fetch("http://a/")[5] == "NetworkError"
    f, t, _ = fetcher([TimeoutError()] * 2, retries=1)
    assert f.fetch("http://a/")[5] == "TransientError"
    f, t, _ = fetcher([(429, "7"), (429, "Mon, 12 Jan 1970 13:47:00 GMT"), (429, "soon"), 200], retries=3)
    assert f.fetch("http://a/")[3] == 200 and t.slept == [7.0, 13.0, 12.0]
    f, t, _ = fetcher([(503, "500"), 200], most_delay=30.0)
    assert f.fetch("http://a/")[3] == 200 and t.slept == [30.0]
    f, _, _ = fetcher([_Answer("é".encode("latin-1"), headers={}), _Answer(b"x" * 9)])
    assert f.fetch("http://a/")[1] == "\ufffd"


def test_live_manners():
    f, t, asked = fetcher([200] * 4, agents=("one", "two"), rps=0.5, jitter=1.0)
    for u in ("http://a/1", "http://a/2", "http://b/1", "http://a/3"):
        f.fetch(u, 5.0 if u.endswith("3") else 0.0)
    assert [a[1] for a in asked] == ["one", "two", "one", "two"]
    times = {a[0]: a[4] - 1_000_000 for a in asked}
    assert times["http://a/1"] == 2.0 and times["http://a/2"] == 4.5 and times["http://a/3"] - times["http://a/2"] >= 2.5
    f, t, asked = fetcher([503] * 20, retries=0, breaker=live.Breaker(0.5, 3, 4, 1_000_000_000))
    kinds = [f.fetch(f"http://a/{i}")[5] for i in range(5)]
    assert kinds == ["TransientError"] * 3 + ["CircuitOpenError"] * 2 and len(asked) == 3
    told = []
    f, t, _ = fetcher([503, 200])
    f.on_retry = lambda *a: told.append(a)
    f.fetch("http://a/")
    assert told == [("http://a/", 1, "TransientError", 1.0)]


def test_live_caps():
    import threading
    import time

    now, most, by, lock = [0], [0], {}, threading.Lock()

    def opener(request, connect, read):
        d = live.domain_of(request.full_url)
        with lock:
            now[0] += 1
            by[d] = by.get(d, [0, 0])
            by[d][0] += 1
            by[d][1] = max(by[d])
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
            by[d][0] -= 1
        return _Answer()

    f = live.Fetcher(live.Manners(max_concurrent=6, max_per_domain=2), opener=opener)
    asked = [(f"http://d{0 if i < 40 else i % 5}/{i}", 0.0) for i in range(80)]
    rows = list(f.all(iter(asked)))
    assert sorted(r[0] for r in rows) == sorted(u for u, _ in asked) and most[0] <= 6 and max(x[1] for x in by.values()) <= 2 and f.peak == most[0] > 2


@pytest.fixture(scope="module")
def server():
    """A site of three pages with a robots.txt and a sitemap, and one page that fails once."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    class H(BaseHTTPRequestHandler):
        seen: list = []

        def do_GET(self):
            H.seen.append(self.path)
            pages = {"/": "<a href='/a'>a</a><a href='/hidden'>h</a>", "/a": "<a href='/lost'>x</a><title>A</title>", "/robots.txt": "User-agent: *\nDisallow: /hidden\n", "/m.xml": "<urlset><url><loc>/late</loc></url></urlset>", "/late": "late"}
            ok = self.path in pages and not (self.path == "/late" and H.seen.count("/late") == 1)
            self.send_response(200 if ok else 503 if self.path == "/late" else 404)
            self.send_header("Content-Type", "text/html")
            self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(pages.get(self.path, "").encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), H)
    Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", H.seen
    s.shutdown()


def test_live_source(spark, server):
    base, _ = server
    spark.dataSource.register(live.HttpSource)
    got = spark.read.format("webweft_http").option("urls", json.dumps([base + "/a", base + "/x", base + "/a"])).option("rps", "50").load().collect()
    assert {(r.url.removeprefix(base), r.status_code, r.kind) for r in got} == {("/a", 200, None), ("/x", 404, "PermanentError")}


def test_live_job(spark, server):
    from webweft.plans.job import BARRED, CrawlJob

    base, seen = server
    seen.clear()
    cfg = {"start_urls": [base + "/"], "sitemaps": [base + "/m.xml"], "crawler": {"max_depth": 3, "respect_robots": True, "same_domain_only": True}}
    with CrawlJob(spark, cfg).run() as got:
        rows = {r.url.removeprefix(base): r for r in got.visited.collect()}
        assert {u for u, r in rows.items() if r.ok} == {"/", "/a", "/late"} and rows["/a"].page.title == "A"
        assert (rows["/hidden"].error, rows["/lost"].status_code, rows["/lost"].kind) == (BARRED, 404, "PermanentError")
        assert got.stats()["sitemaps"] == {"fetched": 1, "failed": 0} and got.stats()["retries"] == 1
    # nothing is asked for twice, save for what failed once; what is forbidden is not asked for
    assert sorted(seen) == ["/", "/a", "/late", "/late", "/lost", "/m.xml", "/robots.txt"]


def test_live_edges(spark):
    none = spark.createDataFrame([(None,)], "url string")
    assert live.fetch_live(none).count() == 0 and live.fetch_live(none.limit(0)).count() == 0
    bad = spark.createDataFrame([("nonsense",), ("http://[x/",), ("ftp://127.0.0.1:9/x",)], "url string")
    got = live.fetch_live(bad, live.Manners(retries=0)).collect()
    assert len(got) == 3 and all(r.kind in ("PermanentError", "NetworkError") and r.html is None for r in got)


def test_robots_cache(spark, tmp_path):
    """Files are asked for again when their time is over: an hour for an answer, a minute for none."""
    asked = []

    def ask(at):
        def run(origins):
            got = sorted(r.origin for r in origins.select("origin").collect())
            asked.append(got)
            rows = [(o, 503 if "down" in o else 200, "User-agent: *\nDisallow: /x\n", at) for o in got]
            return spark.createDataFrame(rows, "origin string, status int, body string, fetched_at timestamp")

        return run

    origins = spark.createDataFrame([("http://up",), ("http://down",), (None,), ("http://up",)], "origin string")
    t0 = dt.datetime(2026, 1, 1, 12)
    for minutes in (0, 0.5, 2, 59, 61):
        now = t0 + dt.timedelta(minutes=minutes)
        cache = live.RobotsCache(spark, str(tmp_path / "robots"), ask(now))
        table = {r.origin: r.state for r in cache.get(origins, F.lit(now)).collect()}
        assert table == {"http://up": "rules", "http://down": "disallow_all"}
    assert asked == [["http://down", "http://up"], [], ["http://down"], ["http://down"], ["http://down", "http://up"]]


def test_shared_folder(spark, monkeypatch):
    from webweft import stored

    class Conf:
        def get(self, *a):
            return None

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stored.shared_dir(Cluster)
