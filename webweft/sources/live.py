"""Live HTTP: URLs are dealt out by domain, and a task fetches its domains' URLs with manners.

Over all tasks at most max_concurrent requests are under way, max_per_domain of a domain: domains are dealt to lanes,
one task each, and the lanes share max_concurrent out by what they have to do. A domain's requests keep their
pauses and pass its breaker; failures that another try may mend are tried again. Rows come as they end.
A LiveSession fetches one level of a crawl after another: what is known of a domain (its breaker, its next slot, its
Crawl-delay) is a table, of which a level reads what it needs and to which it adds what it has changed.
As a data source: spark.dataSource.register(HttpSource); spark.read.format("webweft_http").option("urls", json list).load()
"""

from __future__ import annotations

import json
import random
import threading
import time
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from itertools import chain
from http.client import HTTPConnection, HTTPException, HTTPSConnection, InvalidURL
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlsplit
from urllib.request import Request

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from webweft.functions import robots
from webweft.functions import urls as url_functions
from webweft.functions.errors import DELAY_BY_STATUS, RETRIES_BY_STATUS, TRANSIENT
from webweft.operators.breaker import Breaker, Machine
from webweft.stored import Stored

SCHEMA = "url string, html string, payload binary, status_code int, content_type string, kind string, error string, attempts int, fetched_at timestamp"
#: Bytes of an answer that are read; a longer one is a failure.
MOST_BYTES = 50 * 1024 * 1024


def domain_of(url: str) -> str:
    try:
        return urlsplit(url).netloc.lower()
    except ValueError:
        return ""


@dataclass(frozen=True)
class Manners:
    """How requests are made; times are seconds. rps is a domain's rate, null for no limit."""

    agents: tuple[str, ...] = ("webweft/1.0",)
    max_concurrent: int = 10
    max_per_domain: int = 3
    rps: float | None = None
    min_delay: float = 0.0
    jitter: float = 0.0
    connect_timeout: float = 5.0
    read_timeout: float = 10.0
    timeout_growth: float = 1.5
    most_timeout: float = 60.0
    retries: int = 2
    base: float = 1.0
    factor: float = 2.0
    most_delay: float = 30.0
    breaker: Breaker | None = field(default_factory=Breaker)

    @property
    def gap(self) -> float:
        return max(1 / self.rps if self.rps else 0.0, self.min_delay)


def retry_after(header: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for, as a number or a date; null if it says neither."""
    value = (header or "").strip()
    if value.isdigit():
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now) if value else None
    except (TypeError, ValueError):
        return None


def pause(m: Manners, retry: int, status: int | None, asked: float | None) -> float:
    if asked is not None:
        return min(asked, m.most_delay)
    return min(m.most_delay, m.base * DELAY_BY_STATUS.get(status, 1.0) * m.factor**retry)


class _Opened(HTTPConnection):
    """Connects within one time and reads within another."""

    read_timeout = 10.0

    def connect(self) -> None:
        super().connect()
        self.sock.settimeout(self.read_timeout)


class _OpenedSafely(_Opened, HTTPSConnection):
    pass


#: Answers that lead elsewhere, and how often one URL may.
REDIRECTS, MOST_REDIRECTS = (301, 302, 303, 307, 308), 10
#: Bytes of an answer without use that are read so that its connection can serve again.
DRAIN = 64 * 1024


class _Answer:
    """An answer whose connection goes back to its keeper once it was read whole."""

    def __init__(self, response, give_back: Callable[[bool], None]):
        self.response, self.give_back = response, give_back
        self.status, self.headers = response.status, response.headers

    def read(self, n: int) -> bytes:
        return self.response.read(n)

    def __enter__(self) -> _Answer:
        return self

    def __exit__(self, *exc) -> None:
        whole = exc[0] is None and self.response.isclosed()
        self.response.close()
        self.give_back(whole)


class Connections:
    """Opens requests, over connections that are kept open between them: one thread's at a time."""

    def __init__(self):
        self.lock, self.idle = threading.Lock(), {}

    def _send(self, scheme: str, host: str, target: str, headers: dict, connect_timeout: float, read_timeout: float):
        with self.lock:
            kept = self.idle.get((scheme, host))
            c = kept.pop() if kept else None
        for again in (c is not None, False):
            if c is None:
                c = (_OpenedSafely if scheme == "https" else _Opened)(host, timeout=connect_timeout)
            c.read_timeout = read_timeout
            if c.sock is not None:
                c.sock.settimeout(read_timeout)
            try:
                c.request("GET", target, headers=headers)
                return c, c.getresponse()
            except (ConnectionError, HTTPException) as e:
                c.close()
                if not again or isinstance(e, InvalidURL):
                    raise
                c = None  # the site closed it meanwhile
            except BaseException:
                c.close()
                raise
        raise AssertionError

    def __call__(self, request: Request, connect_timeout: float, read_timeout: float) -> _Answer:
        url = request.full_url
        for _ in range(MOST_REDIRECTS + 1):
            parts = urlsplit(url)
            scheme, host = parts.scheme.lower(), parts.netloc.rpartition("@")[2]
            if scheme not in ("http", "https") or not host:
                raise ValueError(f"no site in {url!r}")
            target = (parts.path or "/") + ("?" + parts.query if parts.query else "")
            c, r = self._send(scheme, host, target, dict(request.header_items()), connect_timeout, read_timeout)

            def give_back(whole: bool, c=c, r=r, key=(scheme, host)) -> None:
                if whole and not r.will_close:
                    with self.lock:
                        self.idle.setdefault(key, []).append(c)
                else:
                    c.close()

            to = r.headers.get("Location") if r.status in REDIRECTS else None
            if to is None and r.status < 400:
                return _Answer(r, give_back)
            with _Answer(r, give_back) as left:
                left.read(DRAIN)
                left.read(1)
            if to is None:
                break
            url = urljoin(url, to)
        raise HTTPError(url, r.status, r.reason, r.headers, None)

    def close(self) -> None:
        with self.lock:
            for kept in self.idle.values():
                for c in kept:
                    c.close()
            self.idle.clear()


@dataclass(frozen=True)
class Known:
    """What is known of a domain from earlier requests."""

    state: str = "closed"
    results: tuple[bool, ...] = ()
    opened_at: int = 0
    opened: int = 0
    rejected: int = 0
    free_us: int = 0  # when its next slot is
    floor: float = 0.0  # the longest Crawl-delay so far


class _Domain:
    def __init__(self, m: Manners, known: Known):
        self.lock, self.places, self.free, self.floor = threading.Lock(), threading.Semaphore(m.max_per_domain), known.free_us / 1e6, known.floor
        self.breaker = Machine(m.breaker, known.state, known.results, known.opened_at, known.opened, known.rejected) if m.breaker else None

    def known(self) -> Known:
        b = self.breaker
        of = (b.state, tuple(b.results), b.opened_at, b.opened, b.rejected) if b else ("closed", (), 0, 0, 0)
        return Known(*of, int(self.free * 1e6), self.floor)


class Fetcher:
    """Fetches URLs of one task. Clock, sleep, opener and random numbers can be given, for tests.

    places: requests that may be under way here, where it is not all of max_concurrent. known: of some domains what
    earlier requests have shown. on_retry(url, attempt, kind, pause) is called before each new try.
    """

    def __init__(self, m: Manners, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, opener: Callable | None = None, rand: Callable[[], float] = random.random, on_retry: Callable | None = None, places: int | None = None, known: dict[str, Known] | None = None):
        self.m, self.clock, self.sleep, self.opener, self.rand, self.on_retry = m, clock, sleep, opener or Connections(), rand, on_retry
        self.domains: dict[str, _Domain] = {}
        self.places, self.known = places or m.max_concurrent, known if known is not None else {}
        self.lock, self.turn, self.active, self.peak = threading.Lock(), 0, 0, 0

    def _domain(self, url: str) -> _Domain:
        with self.lock:
            name = domain_of(url)
            if name not in self.domains:
                # of a domain of which nothing is known requests of another job may just have ended, so the first keeps its pause too
                first = Known(free_us=int((self.clock() + self.m.gap) * 1e6) if self.m.gap else 0)
                self.domains[name] = _Domain(self.m, self.known.get(name, first))
            return self.domains[name]

    def _slot(self, d: _Domain) -> None:
        """Waits for the domain's next slot and takes it."""
        with d.lock:
            now = self.clock()
            start = max(now, d.free)
            d.free = start + max(self.m.gap, d.floor) + self.m.jitter * self.rand()
        if start > now:
            self.sleep(start - now)

    def _attempt(self, url: str, n: int) -> dict:
        with self.lock:
            agent = self.m.agents[self.turn % len(self.m.agents)]
            self.turn += 1
        grown = min(max(self.m.most_timeout, self.m.read_timeout), self.m.read_timeout * self.m.timeout_growth**n)
        try:
            with self.opener(Request(url, headers={"User-Agent": agent}), self.m.connect_timeout, grown) as r:
                body = r.read(MOST_BYTES + 1)
                if len(body) > MOST_BYTES:
                    return {"kind": "PermanentError", "error": f"more than {MOST_BYTES} bytes", "status_code": r.status}
                charset = r.headers.get_content_charset() or "utf-8"
                try:
                    text = body.decode(charset, "replace")
                except LookupError:
                    text = body.decode("utf-8", "replace")
                return {"html": text, "payload": body, "status_code": r.status, "content_type": r.headers.get_content_type()}
        except HTTPError as e:
            wait_for = retry_after(e.headers.get("Retry-After") if e.headers else None, self.clock())
            return {"kind": "TransientError" if e.code in TRANSIENT else "PermanentError", "error": f"HTTP {e.code} {e.reason}", "status_code": e.code, "asked": wait_for}
        except TimeoutError as e:
            return {"kind": "TransientError", "error": str(e) or "timed out"}
        except (URLError, OSError, HTTPException) as e:
            late = isinstance(getattr(e, "reason", None), TimeoutError)
            return {"kind": "TransientError" if late else "NetworkError", "error": str(e) or type(e).__name__}
        except ValueError as e:
            return {"kind": "PermanentError", "error": str(e)}

    def _try(self, url: str, d: _Domain, n: int) -> dict:
        """The breaker's gate, the domain's slot, and one request."""
        us = lambda: int(self.clock() * 1_000_000)
        if d.breaker is not None:
            with d.lock:
                left = d.breaker.allow(us())
            if left is not None:
                return {"kind": "CircuitOpenError", "error": f"the breaker of {domain_of(url)} is open for {left / 1e6:.1f} s"}
        got: dict = {"kind": "NetworkError"}
        try:
            self._slot(d)
            got = self._attempt(url, n)
        finally:
            if d.breaker is not None:
                kind = got.get("kind")
                ok = True if kind is None or (kind == "PermanentError" and got.get("status_code")) else False if kind in ("TransientError", "NetworkError") else None
                with d.lock:
                    d.breaker.record(ok, us())
        return got

    def fetch(self, url: str, crawl_delay: float = 0.0) -> tuple:
        """A row of SCHEMA: one URL with its tries; a failure is a row too."""
        d = self._domain(url)
        with d.lock:
            d.floor = max(d.floor, crawl_delay or 0.0)
        n = 0
        with d.places:
            with self.lock:
                self.active += 1
                self.peak = max(self.peak, self.active)
            try:
                while True:
                    got = self._try(url, d, n)
                    kind, status = got.get("kind"), got.get("status_code")
                    again = kind in ("TransientError", "NetworkError") and n < RETRIES_BY_STATUS.get(status, self.m.retries)
                    if not again:
                        break
                    delay = pause(self.m, n, status, got.get("asked"))
                    if status in (429, 503):
                        # the whole domain holds back, not this URL alone
                        with d.lock:
                            d.free = max(d.free, self.clock() + delay)
                    if self.on_retry:
                        self.on_retry(url, n + 1, kind, delay)
                    self.sleep(delay)
                    n += 1
            finally:
                with self.lock:
                    self.active -= 1
        return url, got.get("html"), got.get("payload"), status, got.get("content_type", ""), kind, got.get("error"), n + 1, datetime.fromtimestamp(self.clock(), UTC)

    def all(self, asked: Iterable[tuple[str, float]]) -> Iterator[tuple]:
        """Rows of (url, crawl_delay) pairs, in the order in which they end; few more are taken up than are under way.

        A URL whose domain has all its places taken waits behind others, so one slow domain does not fill the pool.
        """
        asked, parked = iter(asked), {}
        running: dict = {}
        busy: dict[str, int] = {}
        room = 16 * self.places  # URLs that wait here for a place of their domain
        with ThreadPoolExecutor(self.places) as pool:
            more, held = True, 0

            def begin(url: str, delay: float) -> None:
                name = domain_of(url)
                busy[name] = busy.get(name, 0) + 1
                running[pool.submit(self.fetch, url, delay)] = name

            while more or running or held:
                while len(running) < self.places:
                    ready = next((d for d, q in parked.items() if q and busy.get(d, 0) < self.m.max_per_domain), None)
                    if ready is not None:
                        begin(*parked[ready].popleft())
                        held -= 1
                        if not parked[ready]:
                            del parked[ready]
                        continue
                    if not more or held >= room:
                        break
                    one = next(asked, None)
                    if one is None:
                        more = False
                    elif busy.get(domain_of(one[0]), 0) < self.m.max_per_domain:
                        begin(*one)
                    else:
                        parked.setdefault(domain_of(one[0]), deque()).append(one)
                        held += 1
                if running:
                    done, _ = wait(running, return_when=FIRST_COMPLETED)
                    for f in done:
                        name = running.pop(f)
                        busy[name] -= 1
                        if not busy[name]:
                            del busy[name]
                        yield f.result()


_KINDS = (pa.string(), pa.string(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.timestamp("us", tz="UTC"))
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: What is known of a domain, as a row.
KNOWN = "domain string, state string, results array<boolean>, opened_at long, opened int, rejected int, free_us long, floor double"
_KNOWN_KINDS = (pa.string(), pa.string(), pa.list_(pa.bool_()), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
_KNOWN_NAMES = [x.split()[0] for x in KNOWN.split(", ")]
#: Rows that a task hands on together, and the longest that a row waits for others, in seconds.
ROWS, LINGER = 100, 0.5
#: Domains with most URLs that are dealt to lanes one by one, for each lane; others are dealt by hash.
HEAVY = 16


def shares(total: int, loads: list[int]) -> list[int]:
    """total shared out in proportion to the loads; what has a load gets 1 at least, if there are no more of those than total."""
    out = [int(n > 0) for n in loads]
    left, all_ = total - sum(out), max(1, sum(loads))
    exact = [left * n / all_ for n in loads]
    out = [a + int(x) for a, x in zip(out, exact)]
    for k in sorted(range(len(loads)), key=lambda k: (int(exact[k]) - exact[k], k))[: total - sum(out)]:
        out[k] += loads[k] > 0
    return out


def _lanes(rows: DataFrame, most: int) -> tuple[DataFrame, list[int]]:
    """rows with a column lane, by domain, and each lane's load. The domains with most rows go where least is."""
    counts = rows.groupBy("domain").agg(F.count("*").alias("n"))
    heavy = [(r["domain"], r.n) for r in counts.orderBy(F.desc("n"), "domain").limit(HEAVY * most).collect()]
    rest = counts.join(F.broadcast(rows.sparkSession.createDataFrame(heavy, "domain string, n long").select("domain")), "domain", "left_anti") if len(heavy) == HEAVY * most else None
    by_hash = F.pmod(F.xxhash64("domain"), F.lit(most)).cast("int")
    loads = [0] * most
    for r in rest.groupBy(by_hash.alias("lane")).agg(F.sum("n").alias("n")).collect() if rest is not None else ():
        loads[r.lane] = r.n
    dealt = []
    for domain, n in heavy:
        lane = loads.index(min(loads))
        loads[lane] += n
        dealt.append((domain, lane))
    dealt = rows.sparkSession.createDataFrame(dealt, "domain string, __lane int")
    out = rows.join(F.broadcast(dealt), "domain", "left").withColumn("lane", F.coalesce("__lane", by_hash)).drop("__lane")
    return out, loads


def _fetched(asked: DataFrame, manners: Manners, partitions: int, on_retry: Callable | None, known: DataFrame | None) -> DataFrame:
    """Rows of SCHEMA and, after a lane's pages, of KNOWN, what is known of its domains then."""
    delay = F.coalesce(F.max("crawl_delay"), F.lit(0.0)) if "crawl_delay" in asked.columns else F.lit(0.0)
    rows = asked.where("url is not null").groupBy("url").agg(delay.cast("double").alias("crawl_delay")).withColumn("domain", F.coalesce(url_functions.domain(F.col("url")), F.lit("")))
    most = max(1, min(partitions, manners.max_concurrent))
    if most == 1:
        rows, places = rows.withColumn("lane", F.lit(0)), [manners.max_concurrent]
    else:
        rows, loads = _lanes(Stored(rows, "asked").df, most)  # stored, as links of a level may come from afar
        places = shares(manners.max_concurrent, loads)
    if known is not None:
        of = known.select("domain", F.struct(*_KNOWN_NAMES[1:]).alias("known"))
        rows = rows.join(of, "domain", "left")
    else:
        rows = rows.withColumn("known", F.lit(None))
    rows = rows.select("url", "crawl_delay", "lane", "known").repartitionById(most, F.col("lane"))

    def batch(pages: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
        own = [pa.array([r[k] for r in pages] + [None] * len(ends), t) for k, t in enumerate(_KINDS)]
        after = [pa.array([None] * len(pages) + [r[k] for r in ends], t) for k, t in enumerate(_KNOWN_KINDS)]
        return pa.RecordBatch.from_arrays([*own, *after], names=[*_NAMES, *_KNOWN_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        seen: dict[str, Known] = {}
        fetcher = Fetcher(manners, on_retry=on_retry, places=places[first.column(2)[0].as_py()], known=seen)

        def pairs() -> Iterator[tuple[str, float]]:
            for b in chain([first], batches):
                for url, delay, has in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                    if has is not None:
                        seen.setdefault(domain_of(url), Known(**{**has, "results": tuple(has["results"])}))
                    yield url, delay

        pages: list[tuple] = []
        since = time.monotonic()
        for row in fetcher.all(pairs()):
            pages.append(row)
            if len(pages) >= ROWS or time.monotonic() - since > LINGER:
                yield batch(pages, [])
                pages, since = [], time.monotonic()
        ends = []
        for name, d in fetcher.domains.items():
            k = d.known()
            ends.append((name, k.state, list(k.results), k.opened_at, k.opened, k.rejected, k.free_us, k.floor))
        yield batch(pages, ends)

    return rows.mapInArrow(run, f"{SCHEMA}, {KNOWN}")


def fetch_live(asked: DataFrame, manners: Manners = Manners(), partitions: int = 8, on_retry: Callable | None = None) -> DataFrame:
    """Rows of SCHEMA for the distinct URLs of asked (url[, crawl_delay]); null URLs take no part.

    Domains are dealt to at most `partitions` lanes, so one task alone keeps a domain's pauses and breaker, and all of them
    together have no more than max_concurrent requests under way; a lost task is fetched
    again from its start. Store the result before it is read twice. on_retry runs on the executors.
    """
    return _fetched(asked, manners, partitions, on_retry, None).where("url is not null").select(*_NAMES)


class LiveSession:
    """fetch_live() time after time, each going on with what those before have shown of a domain: its breaker, its next
    slot and its longest Crawl-delay.

    Each fetch stores its pages, and what it has changed of its domains; after MOST_CHANGES these become one table.
    """

    MOST_CHANGES = 16

    def __init__(self, spark: SparkSession, manners: Manners = Manners(), partitions: int = 8, on_retry: Callable | None = None, known: DataFrame | None = None):
        """known: rows of KNOWN from an earlier session, one for a domain."""
        self.spark, self.manners, self.partitions, self.on_retry = spark, manners, partitions, on_retry
        self.tables: list[Stored] = []
        self.changes: list[DataFrame] = [] if known is None else [known.select(*_KNOWN_NAMES)]

    def fetch(self, asked: DataFrame) -> DataFrame:
        """Rows of SCHEMA, fetched once."""
        got = Stored(_fetched(asked, self.manners, self.partitions, self.on_retry, self.known() if self.changes else None), "fetched")
        self.tables.append(got)
        self.changes.append(got.df.where("domain is not null").select(*_KNOWN_NAMES))
        if len(self.changes) > self.MOST_CHANGES:
            whole = Stored(self.known(), "known")
            self.tables.append(whole)
            self.changes = [whole.df]
        return got.df.where("url is not null").select(*_NAMES)

    def known(self) -> DataFrame:
        """Rows of KNOWN: of each domain what its last fetch has left."""
        rows = self.spark.createDataFrame([], KNOWN).withColumn("turn", F.lit(-1))
        for k, change in enumerate(self.changes):
            rows = rows.union(change.withColumn("turn", F.lit(k)))
        last = rows.groupBy("domain").agg(F.max_by(F.struct(*_KNOWN_NAMES[1:]), "turn").alias("k"))
        return last.select("domain", "k.*")

    def breaker_states(self, now_us: int | None = None) -> DataFrame:
        """(domain, state, opened_times, rejected, failure_rate), as breaker.breaker_states() gives them of a log."""
        now = F.lit(now_us if now_us is not None else int(time.time() * 1_000_000))
        due = (F.col("state") == "open") & (now - F.col("opened_at") >= (self.manners.breaker or Breaker()).recovery_us)
        rate = F.coalesce(F.try_divide(F.size(F.filter("results", lambda ok: ~ok)), F.size("results")), F.lit(0.0))
        return self.known().select("domain", F.when(due, "half_open").otherwise(F.col("state")).alias("state"), F.col("opened").alias("opened_times"), "rejected", rate.alias("failure_rate"))

    def close(self) -> None:
        for t in self.tables:
            t.drop()
        self.tables, self.changes = [], []


def robots_files(origins: DataFrame, manners: Manners = Manners(), partitions: int = 8) -> DataFrame:
    """(origin, status, body, fetched_at) of the distinct origins' robots.txt; no answer is a null status."""
    asked = origins.select("origin").distinct().withColumn("url", F.concat("origin", F.lit("/robots.txt")))
    got = fetch_live(asked.select("url"), manners, partitions)
    return got.select(F.regexp_replace("url", "/robots\\.txt$", "").alias("origin"), F.col("status_code").alias("status"), F.col("html").alias("body"), "fetched_at")


class RobotsCache:
    """robots.txt files under a path, each fetched again when its time is over (functions.robots.TTL, ERROR_TTL).

    ask: what fetches the files of origins, robots_files() by default.
    """

    def __init__(self, spark: SparkSession, path: str, ask: Callable[[DataFrame], DataFrame] = robots_files):
        self.spark, self.path, self.ask = spark, path.rstrip("/"), ask

    def _files(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return None
        return self.spark.read.schema("origin string, status int, body string, fetched_at timestamp").parquet(self.path)

    def get(self, origins: DataFrame, now: Column | None = None) -> DataFrame:
        """robots.robots_table() rows of the distinct origins, none older than its time."""
        now = F.current_timestamp() if now is None else now
        wanted = origins.select("origin").where("origin is not null").distinct()
        files = self._files()
        due = wanted if files is None else wanted.join(robots.current(robots.robots_table(files), now).select("origin"), "origin", "left_anti")
        new = Stored(self.ask(due).select("origin", "status", "body", "fetched_at"), "robots")
        new.df.write.mode("append").parquet(self.path)
        new.drop()
        return robots.current(robots.robots_table(self._files()), now).join(wanted, "origin", "left_semi")


class _Part(InputPartition):
    def __init__(self, urls: list[str], places: int):
        self.urls, self.places = urls, places


class _Urls:
    """URLs of the options, dealt to partitions by domain, with what each may have under way."""

    def __init__(self, options: dict):
        o = dict(options)
        self.manners = Manners((o.get("agent", "webweft/1.0"),), int(o.get("max_concurrent", 10)), rps=float(o["rps"]) if "rps" in o else None, read_timeout=float(o.get("timeout", 10)), retries=int(o.get("retries", 2)))
        self.urls, self.n = list(dict.fromkeys(json.loads(o.get("urls", "[]")))), min(int(o.get("partitions", 8)), self.manners.max_concurrent)

    def dealt(self, urls: list[str]) -> list[InputPartition]:
        by: dict[int, list[str]] = {}
        for u in urls:
            by.setdefault(zlib.crc32(domain_of(u).encode()) % self.n, []).append(u)
        places = shares(self.manners.max_concurrent, [len(v) for v in by.values()])
        return [_Part(v, n) for v, n in zip(by.values(), places)] or [_Part([], 1)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return Fetcher(self.manners, places=partition.places).all((u, 0.0) for u in partition.urls)


class _Reader(_Urls, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.dealt(self.urls)


class _StreamReader(_Urls, DataSourceStreamReader):
    """The offset is the number of URLs that were fetched, so a query that goes on from its checkpoint fetches none again."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.per_batch, self.at = int(options.get("per_batch", 1_000)), None

    def initialOffset(self) -> dict:
        return {"urls": 0}

    def latestOffset(self) -> dict:
        # a batch's worth beyond the last one that was planned
        self.at = len(self.urls) if self.at is None and self.per_batch >= len(self.urls) else min(len(self.urls), (self.at or 0) + self.per_batch)
        return {"urls": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at or 0, end["urls"])
        return self.dealt(self.urls[start["urls"] : end["urls"]])

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["urls"])


class HttpSource(DataSource):
    """Options: urls (JSON list; for long ones use fetch_live), agent, rps (a domain), max_concurrent, timeout, retries, partitions; as a
    stream also per_batch, the URLs of a micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "webweft_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))
