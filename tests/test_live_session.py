"""A live crawl's memory of its domains, its cap over all tasks, and its connections, against servers that count."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from webweft.operators.breaker import Breaker
from webweft.plans.job import CrawlJob
from webweft.sources import live
from webweft.stored import Stored


class Site:
    """Answers by path; counts requests under way, and notes each with its host, time and connection."""

    def __init__(self, version="HTTP/1.1", delay=0.0, pages=None):
        site = self
        self.seen, self.now, self.peak, self.lock = [], 0, 0, threading.Lock()

        class H(BaseHTTPRequestHandler):
            protocol_version = version

            def do_GET(self):
                with site.lock:
                    site.now += 1
                    site.peak = max(site.peak, site.now)
                    site.seen.append((self.headers["Host"].split(":")[0], self.path, time.time(), self.client_address))
                time.sleep(delay)
                status, body = 503 if self.path.startswith("/bad") else 302 if self.path == "/moved" else 200, (pages or {}).get(self.path, "x").encode()
                with site.lock:
                    site.now -= 1
                self.send_response(status)
                if status == 302:
                    self.send_header("Location", "/there")
                self.send_header("Content-Length", str(len(body)))
                if self.path == "/last":
                    self.send_header("Connection", "close")
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("", 0), H)
        self.server.daemon_threads = True
        self.port = self.server.server_port
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def url(self, path, host="127.0.0.1"):
        return f"http://{host}:{self.port}{path}"

    def asked(self, *paths):
        return [s for s in self.seen if s[1] in paths or not paths]


@pytest.fixture
def sites():
    made = []

    def make(*a, **k):
        made.append(Site(*a, **k))
        return made[-1]

    yield make
    for s in made:
        s.server.shutdown()


def urls(spark, *all_):
    return spark.createDataFrame([(u,) for u in all_], "url string")


@pytest.mark.parametrize("most_changes", [16, 1])
def test_a_breaker_outlives_its_level(spark, sites, monkeypatch, most_changes):
    monkeypatch.setattr(live.LiveSession, "MOST_CHANGES", most_changes)
    site = sites()
    session = live.LiveSession(spark, live.Manners(retries=0, base=0.01, most_delay=0.01, breaker=Breaker(0.5, 3, 4, 60_000_000)))
    # answers before it fails, so that what goes on is a window and not the state alone
    session.fetch(urls(spark, site.url("/ok"), site.url("/fine", "127.0.0.2")))
    session.fetch(urls(spark, site.url("/bad1"), site.url("/bad2")))
    before = len(site.seen)
    got = {r.url: r.kind for r in session.fetch(urls(spark, site.url("/later"), site.url("/later", "127.0.0.2"))).collect()}
    assert got == {site.url("/later"): "CircuitOpenError", site.url("/later", "127.0.0.2"): None}
    assert len(site.seen) == before + 1 and not [s for s in site.asked("/later") if s[0] == "127.0.0.1"]
    states = {r.domain.split(":")[0]: r for r in session.breaker_states().collect()}
    assert (states["127.0.0.1"].state, states["127.0.0.1"].opened_times, states["127.0.0.1"].rejected) == ("open", 1, 1) and states["127.0.0.2"].state == "closed"
    assert abs(states["127.0.0.1"].failure_rate - 2 / 3) < 1e-9
    late = int(time.time() * 1e6) + 61_000_000
    assert {r.state for r in session.breaker_states(late).collect()} == {"half_open", "closed"}
    session.close()
    assert session.known().count() == 0


def test_a_site_that_fails_at_one_depth_is_rejected_at_the_next(spark, sites):
    site = sites()
    bad = [site.url(f"/bad{k}", "127.0.0.2") for k in range(4)]
    pages = {"/": "".join(f"<a href='{u}'>b</a>" for u in [*bad, "/next"]), "/next": f"<a href='{site.url('/good', '127.0.0.2')}'>g</a>"}
    site2 = sites(pages=pages)
    pages["/"] = pages["/"].replace(str(site.port), str(site2.port))
    pages["/next"] = pages["/next"].replace(str(site.port), str(site2.port))
    manners = live.Manners(retries=0, base=0.01, most_delay=0.01, breaker=Breaker(0.5, 3, 4, 60_000_000))
    with CrawlJob(spark, {"start_urls": [site2.url("/")], "crawler": {"max_depth": 2}}, manners=manners).run() as got:
        rows = {r.url.rpartition("/")[2]: r for r in got.visited.collect()}
        assert rows["good"].kind == "CircuitOpenError" and rows["good"].depth == 2 and not site2.asked("/good")
        assert {r.state for r in got.breakers().collect()} == {"open", "closed"}


def test_slots_and_pauses_outlive_a_level(spark, sites):
    site = sites()
    session = live.LiveSession(spark, live.Manners(rps=1.0))
    asked = urls(spark, site.url("/a")).selectExpr("url", "1.5 AS crawl_delay")
    session.fetch(asked)
    session.fetch(urls(spark, site.url("/b")))
    session.fetch(urls(spark, site.url("/c")))
    a, b, c = (site.asked(p)[0][2] for p in ("/a", "/b", "/c"))
    assert b - a >= 1.45 and c - b >= 1.45  # the Crawl-delay that an earlier level was told holds on
    session.close()


@pytest.mark.parametrize("partitions", [1, 8])
def test_the_cap_holds_over_all_tasks(spark, sites, partitions):
    site = sites(delay=0.05)
    hosts = [f"127.0.0.{k}" for k in range(1, 9)]
    asked = urls(spark, *[site.url(f"/{k}", h) for h in hosts for k in range(6)])
    got = live.fetch_live(asked, live.Manners(max_concurrent=5, max_per_domain=2, retries=0), partitions).collect()
    assert len(got) == 48 and all(r.status_code == 200 for r in got)
    assert 2 <= site.peak <= 5


def test_a_single_domain_gets_all_places(spark, sites):
    site = sites(delay=0.05)
    got = live.fetch_live(urls(spark, *[site.url(f"/{k}") for k in range(40)]), live.Manners(max_concurrent=8, max_per_domain=8, retries=0), 8).collect()
    assert len(got) == 40 and 5 <= site.peak <= 8


def test_lanes(spark, monkeypatch):
    monkeypatch.setattr(live, "HEAVY", 1)
    rows = spark.createDataFrame([(f"d{k % 9}" if k > 60 else "hot",) for k in range(150)], "domain string")
    dealt, loads = live._lanes(Stored(rows, "t").df, 3)
    by = {}
    for r in dealt.groupBy("domain", "lane").count().collect():
        assert r.domain not in by  # a domain has one lane
        by[r.domain] = (r.lane, r["count"])
    assert loads == [sum(n for lane, n in by.values() if lane == k) for k in range(3)] and sum(loads) == 150
    assert by["hot"][1] == 61


@pytest.mark.parametrize("total, loads, want", [(10, [5, 5], [5, 5]), (10, [0, 7, 0], [0, 10, 0]), (3, [100, 1, 1], [1, 1, 1]), (10, [90, 10], [8, 2]), (4, [], []), (7, [1, 1, 1], [3, 2, 2])])
def test_shares(total, loads, want):
    got = live.shares(total, loads)
    assert got == want and sum(got) == (total if any(loads) else 0)


def test_connections_are_kept(sites):
    site = sites()
    f = live.Fetcher(live.Manners(max_concurrent=1, retries=0))
    for path in ("/a", "/b", "/moved", "/bad", "/c", "/last", "/d"):
        f.fetch(site.url(path))
    by = [s[3] for s in site.seen]
    assert [s[1] for s in site.seen] == ["/a", "/b", "/moved", "/there", "/bad", "/c", "/last", "/d"]
    assert len(set(by[:7])) == 1 and by[7] != by[6]  # until the site closes it
    old = sites("HTTP/1.0")
    assert [f.fetch(old.url("/a"))[3] for _ in range(3)] == [200] * 3


def test_a_connection_that_the_site_has_closed():
    """A request that goes out on it is sent again on a new one."""
    import socket

    server = socket.create_server(("127.0.0.1", 0))
    served = []

    def serve():
        for _ in range(3):
            c, _ = server.accept()
            served.append(c.recv(10_000))
            c.sendall(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok")
            c.close()  # without having said so

    threading.Thread(target=serve, daemon=True).start()
    f = live.Fetcher(live.Manners(retries=0))
    url = f"http://127.0.0.1:{server.getsockname()[1]}/"
    got = []
    for _ in range(3):
        got.append(f.fetch(url)[3])
        time.sleep(0.05)
    assert got == [200] * 3 and len(served) == 3
    server.close()


def test_redirects_without_end(sites):
    site = sites(pages={})
    live_ = live.Connections()

    class Loop:
        full_url = site.url("/moved")

        def header_items(self):
            return []

    assert live_(Loop(), 1, 1).status == 200
    live_.close()
    assert not live_.idle
