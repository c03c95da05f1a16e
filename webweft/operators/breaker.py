"""Circuit breakers: each domain's requests in order, taken through the states of a breaker.

One machine, Machine, stands behind the batch log, the stream and the live source. A log is cut evenly, whatever its
domains, and what its spans do to a breaker is composed (breaker_spans); only where requests overlap does one task fold a domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webweft.operators import breaker_spans
from webweft.operators.fold import fold


@dataclass(frozen=True)
class Breaker:
    """Opens when at least min_calls of the last `window` calls are known and failure_rate of them failed; tries again
    after recovery_us, with at most half_open_calls probes at a time."""

    failure_rate: float = 0.5
    min_calls: int = 5
    window: int = 10
    recovery_us: int = 30_000_000
    half_open_calls: int = 1

    def __post_init__(self):
        if not 0 < self.failure_rate <= 1 or not 1 <= self.min_calls <= self.window or self.recovery_us < 0 or self.half_open_calls < 1:
            raise ValueError("failure_rate in (0, 1], 1 <= min_calls <= window, recovery_us >= 0, half_open_calls >= 1")


class Machine:
    """One domain's breaker. Times are microseconds and are given, never taken from a clock."""

    __slots__ = ("rule", "state", "results", "opened_at", "opened", "rejected", "probes", "waiting")

    def __init__(self, rule: Breaker, state: str = "closed", results: list | tuple = (), opened_at: int = 0, opened: int = 0, rejected: int = 0, probes: int = 0):
        self.rule, self.state, self.results, self.opened_at, self.opened, self.rejected, self.probes = rule, state, list(results), opened_at, opened, rejected, probes
        self.waiting: list[tuple[int, bool | None]] = []  # requests on their way: when they end, and how

    def values(self) -> tuple:
        return self.state, self.results, self.opened_at, self.opened, self.rejected, self.probes

    @property
    def failures(self) -> int:
        return self.results.count(False)

    @property
    def rate(self) -> float:
        return self.failures / len(self.results) if self.results else 0.0

    def shown(self, now: int | None) -> str:
        return "half_open" if self.state == "open" and now is not None and now - self.opened_at >= self.rule.recovery_us else self.state

    def allow(self, now: int) -> int | None:
        """Null if a request may go, else the microseconds after which another may be tried."""
        if self.state == "open":
            left = self.opened_at + self.rule.recovery_us - now
            if left > 0:
                self.rejected += 1
                return left
            self.state, self.probes = "half_open", 0
        if self.state == "half_open":
            if self.probes >= self.rule.half_open_calls:
                self.rejected += 1
                return 0
            self.probes += 1
        return None

    def record(self, ok: bool | None, now: int) -> None:
        """How a request that was let go ended; null says nothing of the site and only frees a probe's place."""
        if self.state == "half_open":
            self.probes = max(0, self.probes - 1)
            if ok is not None:
                self.state = "closed" if ok else "open"
                if ok:
                    self.results = []
                else:
                    self._open(now)
        elif self.state == "closed" and ok is not None:
            self.results = [*self.results, ok][-self.rule.window :]
            if not ok and len(self.results) >= self.rule.min_calls and self.rate >= self.rule.failure_rate:
                self._open(now)

    def _open(self, now: int) -> None:
        self.state, self.opened_at = "open", now
        self.opened += 1

    def request(self, us: int, ok: bool | None, end_us: int | None = None) -> int | None:
        """allow() at us, and record() when the request ends: at once, or when the log comes to that time."""
        ended = sorted((x for x in self.waiting if x[0] <= us), key=lambda x: x[0])
        self.waiting = [x for x in self.waiting if x[0] > us]
        for at, how in ended:
            self.record(how, at)
        left = self.allow(us)
        if left is None:
            if end_us is None or end_us <= us:
                self.record(ok, us)
            else:
                self.waiting.append((end_us, ok))
        return left

    def end(self) -> None:
        for at, how in sorted(self.waiting, key=lambda x: x[0]):
            self.record(how, at)
        self.waiting = []


def breaker_states(log: DataFrame, breaker: Breaker = Breaker(), key: str = "domain", now_us: int | None = None, end: str | None = None) -> DataFrame:
    """(key, state, opened_times, rejected, failure_rate) after log (key, us, id, ok), a domain's requests in order.

    ok null is an outcome that says nothing of the site. end names a column with the time at which a request ended;
    without one, each ends before the next. With now_us, an open breaker whose time is over shows as half_open. A
    null time takes no part; a null domain is one; an empty log gives no rows.
    """
    schema = f"{key} {log.schema[key].dataType.simpleString()}, state string, opened_times int, rejected int, failure_rate double"

    def finish(m: Machine, name) -> tuple:
        m.end()
        return name, m.shown(now_us), m.opened, m.rejected, m.rate

    if end is None:
        return breaker_spans.final_states(_timed(log, None), breaker, key, finish, schema)

    def step(m: Machine, name, us, i, ok, *ended) -> None:
        m.request(us, ok, *ended)

    return fold(_timed(log, end), key, ("us", "id"), ("ok", *([end] if end else [])), lambda: Machine(breaker), step, finish, schema)


def breaker_verdicts(log: DataFrame, breaker: Breaker = Breaker(), key: str = "domain", end: str | None = None) -> DataFrame:
    """(key, id, allowed, retry_after_us): what the breaker says to each request; retry_after_us is null if it may go."""
    kinds = {c: log.schema[c].dataType.simpleString() for c in (key, "id")}
    schema = f"{key} {kinds[key]}, id {kinds['id']}, allowed boolean, retry_after_us long"
    if end is None:
        return breaker_spans.verdicts(_timed(log, None), breaker, key, schema)

    def step(m: Machine, name, us, i, ok, *ended) -> tuple:
        left = m.request(us, ok, *ended)
        return name, i, left is None, left

    return fold(_timed(log, end), key, ("us", "id"), ("ok", *([end] if end else [])), lambda: Machine(breaker), step, lambda m, name: None, schema)


def _timed(log: DataFrame, end: str | None) -> DataFrame:
    log = log.where("us is not null").withColumn("us", F.col("us").cast("long"))
    return log.withColumn(end, F.col(end).cast("long")) if end else log


def window_rate(log: DataFrame, window: int = 10, key: str = "domain", order: tuple[str, ...] = ("us", "id")) -> DataFrame:
    """log with calls and failure_rate of each domain's last `window` requests: a frame of rows, for logs of any length."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - window, 0)
    return log.withColumn("calls", F.count("*").over(w)).withColumn("failure_rate", F.avg((~F.col("ok")).cast("double")).over(w))


def totals(states: DataFrame) -> DataFrame:
    """One row over breaker_states(): domains, those that are open, and how often breakers opened and turned requests away."""
    return states.agg(F.count("*").alias("domains"), F.count_if(F.col("state") == "open").alias("open"), F.coalesce(F.sum("opened_times"), F.lit(0)).alias("opened"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"))


def outcome(ok: Column, kind: Column, status: Column) -> Column:
    """What a request tells of its site: true for an answer, 4xx among them, false for trouble, null for neither."""
    return F.when(ok | ((kind == "PermanentError") & status.isNotNull()), F.lit(True)).when(kind.isin("TransientError", "NetworkError"), F.lit(False))
