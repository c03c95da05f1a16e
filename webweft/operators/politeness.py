"""Politeness of a request log: rate-limit slots, gaps, rates and concurrency.

With pauses that do not depend on earlier slots, the slot of a key's i-th request is the running
maximum of (arrival - pauses before) plus the pauses before it: one window, no state. Where a request
may hold back its domain, or waits for another to end, a fold takes a key's requests in order.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webweft.operators.fold import fold


def limiter_slots(log: DataFrame, pause_us: Column | int, key: str = "domain", at: str = "us", order: tuple[str, ...] = ("us", "id"), span_us: int | None = None) -> DataFrame:
    """log with slot_us and wait_us: each request starts at its arrival or when the pause after the one before ends.

    pause_us may differ by row: it is the pause after that row's request. Without span_us a domain is one task's window.
    With it a domain's log is cut into spans of time, which are windows of their own: of each span two numbers, its
    pauses and its peak, go on to those after it, so a domain that holds a large share of all requests is many tasks.
    """
    pause = F.lit(pause_us) if isinstance(pause_us, int) else pause_us
    out = log.withColumn("__pause", pause)
    keys = [key]
    if span_us is not None:
        out = out.withColumn("__span", F.floor(F.col(at) / span_us))
        keys.append("__span")
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum("__pause").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("__before", before)
    peak = F.max(F.col(at) - F.col("__before")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if span_us is None:
        slot = peak + F.col("__before")
    else:
        out = out.withColumn("__peak", peak)
        spans = out.groupBy(*keys).agg(F.sum("__pause").alias("all"), F.max("__peak").alias("peak"))
        earlier = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn("base", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
        spans = spans.withColumn("held", F.max(F.col("peak") - F.col("base")).over(earlier))
        spans = spans.select(F.col(key).alias("__key"), F.col("__span").alias("__of"), F.col("base").alias("__base"), F.col("held").alias("__held"))
        out = out.join(spans, out[key].eqNullSafe(F.col("__key")) & out["__span"].eqNullSafe(F.col("__of")))
        slot = F.greatest(F.col("__peak") - F.col("__base"), F.col("__held")) + F.col("__base") + F.col("__before")
    return out.withColumn("slot_us", slot).withColumn("wait_us", F.col("slot_us") - F.col(at)).select(*log.columns, "slot_us", "wait_us")


def pause_us(rps: float = 1.0, min_delay: float = 0.0, crawl_delay: Column | None = None) -> Column:
    """Pause of a domain in microseconds: the longest of 1 / rps, min_delay and its Crawl-delay."""
    if rps <= 0 or min_delay < 0:
        raise ValueError("rps must be positive, min_delay not negative")
    base = F.lit(max(1 / rps, min_delay))
    longest = base if crawl_delay is None else F.greatest(base, F.coalesce(crawl_delay, F.lit(0.0)))
    return F.round(longest * 1_000_000).cast("long")


def slots_with_pushback(log: DataFrame, rps: float = 1.0, key: str = "domain", at: str = "us", push: str = "push_us", jitter: str | None = None, span_us: int | None = None) -> DataFrame:
    """(key, id, slot_us): slots where a request may also hold back its domain: no later slot before its own + push.

    jitter names a column that is added to the pause after a request. Null push and jitter are 0; a request without a
    time takes no part; a null domain is one. To hold back a domain is a longer pause after the request, so this is limiter_slots(),
    with span_us in many tasks a domain.
    """
    gap = int(round(1_000_000 / rps))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c else F.lit(0)
    rows = log.where(F.col(at).isNotNull()).select(key, F.col(at).cast("long").alias("us"), "id", F.greatest(F.lit(gap) + whole(jitter), whole(push)).alias("pause"))
    return limiter_slots(rows, F.col("pause"), key, span_us=span_us).select(key, "id", "slot_us")


def limiter_gaps(slots: DataFrame, key: str = "domain") -> DataFrame:
    """(key, requests, avg_gap_us, avg_wait_us)."""
    w = Window.partitionBy(key).orderBy("slot_us", "id")
    gap = F.col("slot_us") - F.lag("slot_us").over(w)
    return slots.withColumn("gap", gap).groupBy(key).agg(F.count("*").alias("requests"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("avg_gap_us"), F.avg("wait_us").alias("avg_wait_us"))


def rolling_rps(log: DataFrame, key: str = "domain", at: str = "us", span_us: int = 5_000_000) -> DataFrame:
    """log with rps: (requests - 1) / time between first and last, of those in the span up to each; 0 for one.

    A domain's log is cut into stretches as long as the span. A row counts in its own, and as a guest in the next, so
    a stretch has all that its rows look back on, and a domain's stretches are windows of their own.
    """
    here = F.floor(F.col(at) / span_us)
    rows = log.withColumn("__of", F.explode(F.array(F.struct(here.alias("span"), F.lit(0).alias("guest")), F.struct((here + 1).alias("span"), F.lit(1).alias("guest")))))
    rows = rows.withColumn("__span", F.col("__of.span")).withColumn("__guest", F.col("__of.guest"))
    w = Window.partitionBy(key, "__span").orderBy(at).rangeBetween(-span_us, 0)
    n, first = F.count("*").over(w), F.min(at).over(w)
    rows = rows.withColumn("rps", F.coalesce(F.try_divide((n - 1) * 1_000_000.0, F.col(at) - first), F.lit(0.0)))
    return rows.where("__guest = 0").select(*log.columns, "rps")


def concurrency(log: DataFrame, key: str | None = "domain", start: str = "start_us", end: str = "end_us") -> DataFrame:
    """(key, peak): most requests active at once; one that ends as another starts does not overlap it."""
    keys = [key] if key else []
    edges = log.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("us"), F.lit(1).alias("d")), F.struct(F.col(end).alias("us"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.us", "e.d")
    # one row for each moment first, so that the sweep sees moments, not requests
    moments = edges.groupBy(*keys, "us").agg(F.sum("d").alias("d"))
    if not key:
        return _peak_of_all(moments)
    w = Window.partitionBy(key).orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    return moments.withColumn("active", F.sum("d").over(w)).groupBy(*keys).agg(F.max("active").alias("peak"))


#: Spans of time that the sweep over all domains is cut into.
SPANS = 1_024


def _peak_of_all(moments: DataFrame) -> DataFrame:
    """The sweep over all domains, span by span: each starts with the sum of those before it."""
    lo, hi = moments.agg(F.min("us"), F.max("us")).first()
    if lo is None:
        return moments.agg(F.max("d").alias("peak"))
    width = max(1, -(-(hi - lo + 1) // SPANS))
    cut = moments.withColumn("span", F.floor((F.col("us") - lo) / width))
    # at most SPANS rows
    base = cut.groupBy("span").agg(F.sum("d").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("span").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    active = cut.join(F.broadcast(base.select("span", "before")), "span").withColumn("active", F.col("before") + F.sum("d").over(w))
    return active.agg(F.max("active").alias("peak"))


def admitted(log: DataFrame, per_domain: int, key: str = "domain", at: str = "us", duration: str | int = 0) -> DataFrame:
    """(key, id, lane, start_us, wait_us): requests of a domain, at most per_domain at once, first come first served.

    duration is a column of microseconds, or one number for all. A request starts when it arrives or when the first of
    its domain's lanes is free; of free lanes it takes the one that was used least lately. For a cap over all domains
    let key be a constant. A request without a time takes no part, a null duration is 0.
    """
    if per_domain < 1:
        raise ValueError("per_domain must be at least 1")
    kinds = {c: log.schema[c].dataType.simpleString() for c in (key, "id")}
    took = F.lit(duration) if isinstance(duration, int) else F.coalesce(F.col(duration), F.lit(0))
    rows = log.where(F.col(at).isNotNull()).select(key, F.col(at).cast("long").alias("us"), "id", took.cast("long").alias("took"))

    def step(lanes: list, name, us: int, i, took: int) -> tuple:
        if len(lanes) < per_domain:
            free, lane = us, len(lanes)
        else:
            free, lane = heapq.heappop(lanes)
        start = max(us, free)
        heapq.heappush(lanes, (start + took, lane))
        return name, i, lane, start, start - us

    return fold(rows, key, ("us", "id"), ("took",), list, step, lambda s, name: None, f"{key} {kinds[key]}, id {kinds['id']}, lane int, start_us long, wait_us long")


def politeness_stats(slots: DataFrame, allowed: DataFrame | None = None, attempts: DataFrame | None = None) -> DataFrame:
    """One row: requests, avg_gap_us and avg_wait_us over all domains of limiter_slots(), blocked of robots.can_fetch(),
    retries of retry.attempt_log()."""
    w = Window.partitionBy("domain").orderBy("slot_us", "id")
    out = slots.withColumn("gap", F.col("slot_us") - F.lag("slot_us").over(w)).agg(F.count("*").alias("requests"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("avg_gap_us"), F.coalesce(F.avg("wait_us"), F.lit(0.0)).alias("avg_wait_us"))
    one = lambda df, c, name: df.agg(c.alias(name))
    blocked = one(allowed, F.count_if(~F.col("allowed")), "blocked") if allowed is not None else None
    retries = one(attempts, F.count("delay"), "retries") if attempts is not None else None
    # single rows, put side by side
    for name, part in (("blocked", blocked), ("retries", retries)):
        out = out.join(F.broadcast(part)) if part is not None else out.withColumn(name, F.lit(0).cast("long"))
    return out
