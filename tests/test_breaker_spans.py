"""What spans of a log do to a breaker, composed, against the machine that takes one request after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webweft.operators import breaker, breaker_spans, politeness
from webweft.operators.breaker import Breaker, Machine
from webweft.operators.breaker_spans import State, apply, packed, span_function, unpacked

RULES = [Breaker(recovery_us=30), Breaker(0.3, 2, 4, 7), Breaker(1.0, 1, 1, 0), Breaker(0.5, 3, 3, 100), Breaker(0.6, 5, 12, 13)]


def log_of(rng, n):
    us, out = 0, []
    trouble = rng.random()
    for _ in range(n):
        us += rng.choice([0, 0, 1, 1, 2, 3, 40])
        if rng.random() < 0.05:
            trouble = rng.random()
        out.append((us, rng.choices([1, 0, -1], [1 - trouble, trouble, rng.choice([0, 0.1])])[0]))
    return out


@pytest.mark.parametrize("rule", RULES)
def test_composed_spans(rule):
    rng = random.Random(rule.window)
    for _ in range(150):
        log = log_of(rng, rng.randrange(1, 120))
        cuts = sorted(rng.sample(range(1, len(log)), min(len(log) - 1, rng.randrange(0, 12))))
        m, s = Machine(rule), State()
        for a, z in zip([0, *cuts], [*cuts, len(log)]):
            part = log[a:z]
            for us, ok in part:
                m.request(us, None if ok < 0 else bool(ok))
            us, ok = (np.array(x, np.int64) for x in zip(*part))
            s = apply(s, len(part), *span_function(us, ok, rule), rule)
            assert (breaker_spans.NAMES[s.kind], unpacked(s.results), s.opened, s.rejected) == (m.state, m.results, m.opened, m.rejected)
            assert s.kind != breaker_spans.OPEN or s.opened_at == m.opened_at


def test_results_as_bits():
    for r in ([], [True], [False, False], [False, True, True]):
        assert unpacked(packed(r)) == r


def test_a_span_is_short():
    """Thousands of requests are a few rows, unless they come within one recovery time."""
    us = np.arange(20_000, dtype=np.int64) * 10
    closed, open_ = span_function(us, (us % 70 > 0).astype(np.int64), Breaker(recovery_us=300))
    assert len(closed) == 10 * 7 * 8 and len(open_) <= 32 * 7 * 8


@pytest.mark.parametrize("rule", RULES[:2])
def test_a_hot_domain_is_many_tasks(spark, rule):
    rng = random.Random(1)
    rows = [("hot", i, us, None if ok < 0 else bool(ok)) for i, (us, ok) in enumerate(log_of(rng, 3000))]
    rows += [(f"d{k}" if k else None, 10_000 * (k + 1) + i, us, None if ok < 0 else bool(ok)) for k in range(8) for i, (us, ok) in enumerate(log_of(rng, 40))]
    log = spark.createDataFrame(rows, "domain string, id long, us long, ok boolean").repartition(5)
    want, machines = {}, {}
    for d, i, us, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        m = machines.setdefault(d, Machine(rule))
        left = m.request(us, ok)
        want[i] = (d, left is None, left)
    got = breaker.breaker_verdicts(log, rule)
    assert {r.id: (r.domain, r.allowed, r.retry_after_us) for r in got.collect()} == want
    states = {r.domain: (r.state, r.opened_times, r.rejected, r.failure_rate) for r in breaker.breaker_states(log, rule).collect()}
    assert states == {d: (m.state, m.opened, m.rejected, m.rate) for d, m in machines.items()}
    # the hot domain's rows lie in most partitions, and a domain's functions in one
    parts = breaker_spans._cut(log, "domain").where("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 3


@pytest.mark.parametrize("span", [None, 1, 50, 100_000])
def test_pushback_in_spans(spark, span):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(2000), rng.choice([None, 0, 30, 500]), rng.choice([None, 3])) for i in range(400)]
    log = spark.createDataFrame(rows, "domain string, id int, us long, push_us long, jit long")
    got = {r.id: r.slot_us for r in politeness.slots_with_pushback(log, rps=100_000, jitter="jit", span_us=span).collect()}
    free, want = {}, {}
    for d, i, us, push, jit in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = max(us, free.get(d, us))
        free[d] = max(want[i] + 10 + (jit or 0), want[i] + (push or 0))
    assert got == want
