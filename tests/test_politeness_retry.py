import random

import pytest
from pyspark.sql import functions as F

from webweft.functions import errors, monitor
from webweft.operators import breaker, politeness, retry, stats


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_backoff_and_timeouts(spark):
    n = [(i,) for i in range(7)]
    flat = lambda **k: [r[0] for r in values(spark, n, "n int", errors.backoff(F.col("n"), **k))]
    assert flat() == [1, 2, 4, 8, 16, 30, 30]
    assert flat(base=1, most=3)[:4] == [1, 2, 3, 3]
    assert flat(base=0.05)[:4] == pytest.approx([0.05, 0.1, 0.2, 0.4])
    assert flat(status=F.lit(429))[:2] == [3, 6]
    assert flat(retry_after=F.lit(100.0)) == [30] * 7 and flat(retry_after=F.lit(None).cast("double")) == [1, 2, 4, 8, 16, 30, 30]
    assert all(1 <= x <= 1.25 for x in flat(jitter=0.25)[:1])
    assert [r[0] for r in values(spark, n, "n int", errors.timeout(F.col("n")))][:3] == [10, 15, 22.5]


def test_limits_and_classes(spark):
    rows = [(500, "TransientError"), (503, "TransientError"), (None, "NetworkError")]
    got = [r[0] for r in values(spark, rows, "s int, k string", errors.retry_limit(F.col("s"), F.col("k"), 0, by_kind={"NetworkError": 5}))]
    assert got == [2, 0, 5]
    kinds = [r[0] for r in values(spark, [(s,) for s in (200, 404, 403, 408, 429, 500, 501, 503)], "s int", errors.classify_status(F.col("s")))]
    assert kinds == [None, "PermanentError", "PermanentError", "TransientError", "TransientError", "TransientError", "PermanentError", "TransientError"]
    names = [(x,) for x in ("TimeoutError", "ClientOSError", "InvalidURL", "KeyError", "ParseError")]
    assert [r[0] for r in values(spark, names, "n string", errors.classify_exception(F.col("n")))] == ["TransientError", "NetworkError", "PermanentError", "PermanentError", "ParseError"]
    assert values(spark, [(None, "HTTP 404: x"), ("A", "b")], "k string, r string", errors.failure_name(F.col("k"), F.col("r"))) == [("HTTP 404",), ("A",)]


def test_retry_after(spark):
    now = F.lit("2026-10-21T07:28:00Z").cast("timestamp")
    rows = [("5",), ("Wed, 21 Oct 2026 07:29:00 GMT",), ("Wed, 21 Oct 2015 07:28:00 GMT",), ("soon",), (None,), ("",)]
    assert [r[0] for r in values(spark, rows, "h string", errors.retry_after(F.col("h"), now))] == [5.0, 60.0, 0.0, None, None, None]


def test_retry_stats(spark):
    t, p = "TransientError", "PermanentError"
    rows = [("/ok", 0, None, 200), ("/404", 0, p, 404), *[("/flaky", i, t if i < 2 else None, 503 if i < 2 else 200) for i in range(3)], *[("/always503", i, t, 503) for i in range(6)]]
    log = retry.attempt_log(spark.createDataFrame(rows, "url string, n int, kind string, status int").withColumn("retry_after", F.lit(None).cast("double")), 3, 0.05)
    s = retry.retry_stats(log).first()
    assert (s.calls, s.total_errors, s.retries, s.successful_retries, s.failed_after_retries, s.permanent_urls) == (4, 7, 5, 1, 1, 1)
    assert {r.kind: r.n for r in retry.errors_by_type(log).collect()} == {p: 1, t: 6}
    assert [r.url for r in retry.permanent_urls(log).collect()] == ["/404"]


def log_of(spark, n=400, domains=3, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"d{rng.randrange(domains)}", rng.randrange(10**8), rng.choice([True, True, False, None]), rng.choice([0, 0, 0, 5_000_000])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, domain string, us long, ok boolean, push long")


def test_slots_and_pushback(spark):
    rows, df = log_of(spark)
    for gap in (700_000, 2_000_000):
        want, held = {}, {}
        for i, d, us, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            want[i] = max(us, held.get(d, 0))
            held[d] = want[i] + gap
        assert {r.id: r.slot_us for r in politeness.limiter_slots(df, gap).collect()} == want
        for span in (900_000, 30_000_000, 10**9):
            got = politeness.limiter_slots(df, gap, span_us=span)
            assert {r.id: (r.slot_us, r.wait_us) for r in got.collect()} == {i: (want[i], want[i] - us) for i, _, us, _, _ in rows} and got.columns == [*df.columns, "slot_us", "wait_us"]
    # a pause that differs by row
    want, held = {}, {}
    for i, d, us, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = max(us, held.get(d, 0))
        held[d] = want[i] + 100_000 * (i % 7)
    pause = F.col("id") % 7 * 100_000
    for span in (None, 3_000_000):
        assert {r.id: r.slot_us for r in politeness.limiter_slots(df, pause, span_us=span).collect()} == want
    want, held = {}, {}
    for i, d, us, _, push in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = max(us, held.get(d, 0))
        held[d] = max(want[i] + 1_000_000, want[i] + push)
    assert {r.id: r.slot_us for r in politeness.slots_with_pushback(df, push="push").collect()} == want
    assert spark.range(1).select(politeness.pause_us(2.0, 0.1, F.lit(3.0))).first()[0] == 3_000_000
    with pytest.raises(ValueError):
        politeness.pause_us(0)


@pytest.mark.parametrize("lanes", [1, 2, 5])
def test_caps_know_durations(spark, lanes):
    rng = random.Random(lanes)
    rows = [(i, f"d{rng.randrange(3)}", rng.randrange(10_000), rng.choice([0, 5, 400, 3_000, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, domain string, us long, took long")
    got = {r.id: r for r in politeness.admitted(df, lanes, duration="took").collect()}
    free = {}
    for i, d, us, took in sorted(rows, key=lambda r: (r[2], r[0])):
        at = free.setdefault(d, [0] * lanes)
        start = max(us, min(at))
        at[at.index(min(at))] = start + (took or 0)
        assert (got[i].start_us, got[i].wait_us) == (start, start - us) and 0 <= got[i].lane < lanes
    # never more than the cap at once, and a lane holds one request at a time
    ends = {r[0]: got[r[0]].start_us + (r[3] or 0) for r in rows}
    busy = sorted((d, got[i].lane, got[i].start_us, ends[i]) for i, d, _, took in rows if took)
    assert all(a[3] <= b[2] for a, b in zip(busy, busy[1:]) if a[:2] == b[:2])
    with pytest.raises(ValueError):
        politeness.admitted(df, 0)


def test_rolling_rates(spark):
    rows, df = log_of(spark, 300)
    for span in (1_000_000, 40_000_000):
        got = {r.id: r.rps for r in politeness.rolling_rps(df, span_us=span).collect()}
        for i, d, us, _, _ in rows:
            seen = [r[2] for r in rows if r[1] == d and us - span <= r[2] <= us]
            assert got[i] == pytest.approx((len(seen) - 1) * 1e6 / (us - min(seen)) if us > min(seen) else 0.0)


def test_peak_over_all_domains(spark):
    rng = random.Random(9)
    rows = [(f"d{i % 4}", s, s + rng.randrange(1, 90_000)) for i in range(2_000) for s in [rng.randrange(10**6)]]
    df = spark.createDataFrame(rows, "domain string, start_us long, end_us long")
    edges = sorted([(s, 1) for _, s, _ in rows] + [(e, -1) for _, _, e in rows])
    most = now = 0
    for k, (at, step) in enumerate(edges):
        now += step
        if k + 1 == len(edges) or edges[k + 1][0] != at:
            most = max(most, now)
    assert politeness.concurrency(df, key=None).first().peak == most
    assert politeness.concurrency(df.limit(0), key=None).first().peak is None and politeness.concurrency(df.limit(0)).count() == 0


def model(b, rows):
    st, res, op, opened, rejected = "closed", [], 0, 0, 0
    for us, ok in rows:
        if st == "open" and op + b.recovery_us - us > 0:
            rejected += 1
            continue
        if st == "open":
            st = "half_open"
        if st == "half_open":
            if ok is True:
                st, res = "closed", []
            elif ok is False:
                st, op, opened = "open", us, opened + 1
        elif ok is not None:
            res = (res + [ok])[-b.window :]
            if not ok and len(res) >= b.min_calls and res.count(False) / len(res) >= b.failure_rate:
                st, op, opened = "open", us, opened + 1
    return st, opened, rejected, res.count(False) / len(res) if res else 0.0


def test_breaker_against_a_model(spark):
    rows, df = log_of(spark, 1500, 4, 7)
    for b in (breaker.Breaker(recovery_us=3_000_000), breaker.Breaker(0.3, 2, 4, 200_000)):
        by = {}
        for i, d, us, ok, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            by.setdefault(d, []).append((us, ok))
        states = breaker.breaker_states(df, b)
        got = {r.domain: (r.state, r.opened_times, r.rejected, r.failure_rate) for r in states.collect()}
        assert got == {d: model(b, x) for d, x in by.items()}
        verdicts = breaker.breaker_verdicts(df, b)
        turned = {r.domain: r.n for r in verdicts.where("not allowed").groupBy("domain").agg(F.count("*").alias("n")).collect()}
        assert turned == {d: g[2] for d, g in got.items() if g[2]} and verdicts.count() == len(rows)
        assert verdicts.where("allowed = (retry_after_us is not null)").count() == 0
        t = breaker.totals(states).first()
        assert (t.domains, t.opened, t.rejected) == (4, sum(g[1] for g in got.values()), sum(g[2] for g in got.values()))
    with pytest.raises(ValueError):
        breaker.Breaker(min_calls=11)


def test_probes_that_are_under_way(spark):
    """Of requests that come while a probe is under way, no more than half_open_calls may go; a neutral end frees the place."""
    fails = [(k, k, False, k) for k in range(5)]
    probes = [(5, 1_000, None, 1_900), (6, 1_100, True, 1_500), (7, 1_200, True, 1_300), (8, 1_600, True, 1_700), (9, 2_000, True, 2_000), (10, 2_001, True, 2_001)]
    log = spark.createDataFrame([("d", *r) for r in fails + probes], "domain string, id int, us long, ok boolean, done long")
    run = lambda n: {r.id: (r.allowed, r.retry_after_us) for r in breaker.breaker_verdicts(log, breaker.Breaker(0.5, 5, 5, 500, n), end="done").collect()}
    one, two = run(1), run(2)
    assert [one[k][0] for k in range(5, 11)] == [True, False, False, False, True, True] and one[6] == (False, 0)
    assert [two[k][0] for k in range(5, 11)] == [True, True, False, True, True, True]


def test_folds_with_nulls_and_nothing(spark):
    rows, df = log_of(spark, 50)
    odd = df.union(spark.createDataFrame([(900, None, 5, False, 0), (901, "d0", None, False, 0), (902, None, 6, None, None)], df.schema)).withColumn("extra", F.lit("state")).withColumn("state", F.lit(1))
    assert {r.domain for r in breaker.breaker_states(odd).collect()} == {"d0", "d1", "d2", None}
    assert {r.id for r in politeness.slots_with_pushback(odd, push="push").collect()} == {*range(50), 900, 902}
    assert politeness.admitted(odd, 2).count() == 52
    for none in (breaker.breaker_states(df.limit(0)), breaker.breaker_verdicts(df.limit(0)), politeness.slots_with_pushback(df.limit(0), push="push"), politeness.admitted(df.limit(0), 1), politeness.limiter_slots(df.limit(0), 5)):
        assert none.count() == 0


def test_politeness_stats(spark):
    log = spark.createDataFrame([("a", 1, 0), ("a", 2, 10), ("b", 3, 0)], "domain string, id int, us long")
    s = politeness.politeness_stats(politeness.limiter_slots(log, 100)).first()
    assert (s.requests, s.avg_gap_us, s.avg_wait_us, s.blocked, s.retries) == (3, 100.0, 30.0, 0, 0)
    allowed = spark.createDataFrame([(True,), (False,), (False,)], "allowed boolean")
    assert politeness.politeness_stats(politeness.limiter_slots(log, 100), allowed).first().blocked == 2


def test_outcomes(spark):
    ok = breaker.outcome(F.col("ok"), F.col("k"), F.col("s"))
    assert [r[0] for r in values(spark, [(False, "PermanentError", 404), (False, "TransientError", 503), (False, "ParseError", None), (True, None, 200)], "ok boolean, k string, s int", ok)] == [True, False, None, True]


def test_stats(spark):
    rows = [(f"http://a.test/{i}", True, 200, None, 10) for i in range(8)] + [("http://b.test/x", False, 404, "PermanentError", 0), ("http://b.test/y", False, None, "<b>x</b>", -5)]
    e = spark.createDataFrame(rows, "url string, ok boolean, status int, error string, size long").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    s = stats.as_dict(e, elapsed=F.lit(5.0))
    assert (s["total_pages"], s["successful"], s["failed"], s["pages_per_second"], s["bytes_total"]) == (10, 8, 2, 2.0, 80)
    assert s["top_domains"][0] == {"domain": "a.test", "pages": 8} and s["status_codes"] == {"200": 8, "404": 1}
    empty = stats.as_dict(e.limit(0))
    assert empty["total_pages"] == 0 and empty["success_rate"] == 0 and empty["top_domains"] == []


def test_error_stats(spark):
    rows = [("/a", 0, "TransientError", 503, False, 1.0), ("/a", 1, None, 200, True, None), ("/b", 0, "PermanentError", 404, True, None)]
    log = spark.createDataFrame(rows, "url string, n int, kind string, status int, last boolean, delay double")
    failed = spark.createDataFrame([("/b", "PermanentError", "HTTP 404", 404)], "url string, kind string, error string, status_code int")
    states = spark.createDataFrame([("d", "open", 2, 1, 0.5), ("e", "closed", 0, 0, 0.0)], "domain string, state string, opened_times int, rejected int, failure_rate double")
    s = stats.error_stats(log, failed, states)
    assert s["errors_by_type"] == {"PermanentError": 1, "TransientError": 1} and s["retry"]["successful_retries"] == 1
    assert s["failed"] == {"/b": "HTTP 404"} and s["n_failed_urls"] == 1 and s["permanent"] == ["/b"] and s["breaker"] == [{"domain": "d", "state": "open", "opened_times": 2}]


def test_monitor(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert [f(monitor.format_duration(F.lit(x).cast("double"))) for x in (5, 65, 3700, None)] == ["5с", "1м 05с", "1ч 01м", "—"]
    assert f(monitor.make_bar(F.lit(8), F.lit(20))) == "[########------------]  40%"
    assert f(monitor.make_bar(F.lit(1), F.lit(0))) == "[--------------------]   0%"
    assert f(monitor.estimate_eta(F.lit(5), F.lit(10), F.lit(10.0))) == 10.0
    assert f(monitor.estimate_eta(F.lit(0), F.lit(10), F.lit(1.0))) is None and f(monitor.estimate_eta(F.lit(10), F.lit(10), F.lit(1.0))) == 0.0
    assert f(monitor.format_progress(F.lit(8), F.lit(20), F.lit(4.0), F.lit(3), F.lit(1))).endswith("8/20 | 2.0 стр/с | осталось ~6с | активных: 3 | ошибок: 1")
