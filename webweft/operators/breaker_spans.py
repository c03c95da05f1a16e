"""Breakers over a log that is cut anywhere: what a span of requests does to a breaker, as a function that can be composed.

A breaker's next step depends on the last, but it forgets. Closed, it knows the results of its window: they matter
until the span has filled the window itself, or tripped before, which can only be at one of its first few results. Open, it knows when
it opened: that says which request is the first to be let through again, and from there on all is the span's own doing. So a span
is a short list of what comes of tripping at each of its first results, and of what comes of each request's being
that first one. Spans are computed apart, a domain's few functions are then applied one after another, and with the state that each
span begins with its requests are judged apart again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.operators.fold import fold
from webweft.stored import Stored

CLOSED, OPEN, HALF = 0, 1, 2
NAMES = ("closed", "open", "half_open")
#: A window's results as bits, the first highest, under a leading one; as an end, KEPT is what the span began with.
KEPT = 0


def packed(results) -> int:
    out = 1
    for ok in results:
        out = out << 1 | bool(ok)
    return out


def unpacked(bits: int) -> list[bool]:
    return [c == "1" for c in bin(bits)[3:]]


@dataclass
class State:
    kind: int = CLOSED
    results: int = 1
    opened_at: int = 0
    opened: int = 0
    rejected: int = 0

    def machine(self, rule):
        from webweft.operators.breaker import Machine

        return Machine(rule, NAMES[self.kind], unpacked(self.results), self.opened_at, self.opened, self.rejected)


def span_function(us: np.ndarray, ok: np.ndarray, rule) -> tuple[bytes, bytes]:
    """What the requests at us, in order, with outcomes ok (1, 0, or -1 for neither) do to a breaker.

    closed: rows (place of the result, outcome, end...) of the window's first results but one, then one row for what comes if
    none of them trips it. open: rows (time, end...) for each request that may be the first to be let through.
    An end is kind, time of opening, results, how often it opened and how many it rejected.
    """
    n, w, least = len(us), rule.window, rule.min_calls
    after = np.searchsorted(us, us + rule.recovery_us, side="left")
    after = np.maximum(after, np.arange(n) + 1)  # who may come first once it opened at a request
    known = np.flatnonzero(ok >= 0)  # of a closed breaker only these count
    good = ok[known]
    fails = np.append(0, np.cumsum(good == 0))
    many = len(known)
    # results at which a window that began with the j-th result trips, for the window's length there, and for full windows
    full = [r for r in range(w - 1, many) if good[r] == 0 and (fails[r + 1] - fails[r + 1 - w]) / w >= rule.failure_rate]
    full_next = np.full(many + 1, many, np.int64)
    full_next[full] = full
    full_next = np.minimum.accumulate(full_next[::-1])[::-1]
    rank = np.searchsorted(known, np.arange(n + 1))  # results before a request

    def window(first: int, last: int) -> int:
        """The results of a window that began with the first result, after the last."""
        return packed(good[max(first, last + 1 - w) : last + 1])

    def trip_from(first: int) -> int:
        """The result that trips a breaker whose empty window begins with this one, or many."""
        for r in range(first + least - 1, min(first + w - 1, many)):
            if good[r] == 0 and (fails[r + 1] - fails[first]) / (r + 1 - first) >= rule.failure_rate:
                return r
        return int(full_next[min(max(first + w - 1, 0), many)])

    # ends from each request on, if it is the first to be let through; after the last: nothing happens
    ends: list = [None] * (n + 1)

    def tripped(at: int, results: int) -> tuple:
        """The end of a breaker that this request opens."""
        j = int(after[at])
        skipped = j - at - 1
        if j == n:
            return OPEN, int(us[at]), results, 1, skipped
        k, t, r, o, x = ends[j]
        return k, t, results if r == KEPT else r, o + 1, x + skipped

    def closed_from(first: int) -> tuple:
        r = trip_from(first)
        return tripped(int(known[r]), window(first, r)) if r < many else (CLOSED, 0, window(first, many - 1), 0, 0)

    for k in range(n - 1, -1, -1):
        if ok[k] == 1:
            ends[k] = closed_from(int(rank[k + 1]))
        elif ok[k] == 0:
            ends[k] = tripped(k, KEPT)
        else:
            ends[k] = ends[k + 1] if k + 1 < n else (HALF, 0, KEPT, 0, 0)
    closed = [(int(known[r]), int(good[r]), *tripped(int(known[r]), KEPT)) for r in range(min(w - 1, many))]
    r = int(full_next[min(w - 1, many)]) if many >= w else many
    closed.append((-1, 0, *(tripped(int(known[r]), window(r + 1 - w, r)) if r < many else (CLOSED, 0, window(many - w, many - 1) if many >= w else KEPT, 0, 0))))
    # an earlier request opened it, so recovery is at most as long after the first one here
    last = int(np.searchsorted(us, us[0] + rule.recovery_us, side="left")) if n else 0
    open_ = [(int(us[k]), k, *ends[k]) for k in range(min(last + 1, n)) if k == 0 or us[k] > us[k - 1]]
    return np.array(closed, np.int64).tobytes(), np.array(open_, np.int64).reshape(-1, 7).tobytes()


def apply(s: State, n: int, closed: bytes, open_: bytes, rule) -> State:
    """The state after a span of n requests."""
    if s.kind == CLOSED:
        rows = np.frombuffer(closed, np.int64).reshape(-1, 7).tolist()
        have = unpacked(s.results)
        end = rows[-1][2:]
        for _, good, *of in rows[:-1]:
            have = [*have, good == 1][-rule.window :]
            if not good and len(have) >= rule.min_calls and have.count(False) / len(have) >= rule.failure_rate:
                end = of
                break
        kept = packed(have)
    else:
        rows = np.frombuffer(open_, np.int64).reshape(-1, 7)
        at = 0 if s.kind == HALF else int(np.searchsorted(rows[:, 0], s.opened_at + rule.recovery_us, side="left"))
        if at == len(rows):
            return State(s.kind, s.results, s.opened_at, s.opened, s.rejected + n)
        _, skipped, *end = rows[at].tolist()
        end[4] += skipped
        kept = s.results
    kind, opened_at, results, opened, rejected = end
    # half open for want of an outcome keeps the time at which it had opened
    return State(kind, kept if results == KEPT else results, opened_at if kind == OPEN or opened else s.opened_at, s.opened + opened, s.rejected + rejected)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, np.ndarray, np.ndarray]]:
    """(key, us, ok) of each key in a sorted partition."""
    held: list[pa.RecordBatch] = []

    def done() -> tuple:
        t = pa.Table.from_batches(held)
        ok = t.column(2).combine_chunks()
        return held[0].column(0)[0], t.column(1).to_numpy(), ok.cast(pa.int8()).fill_null(-1).to_numpy()

    for b in batches:
        if not b.num_rows:
            continue
        coded = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(coded)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held and not held[0].column(0)[0].equals(b.column(0)[lo]):
                yield done()
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield done()


def _functions(rule, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, us, ok in _segments(batches):
            out.append((key, len(us), *span_function(us, ok, rule)))
            if len(out) >= 1_000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        keys = pa.array([k.as_py() for k, *_ in out], out[0][0].type)
        part = pa.array([TaskContext.get().partitionId()] * len(out), pa.int32())
        return pa.RecordBatch.from_arrays([keys, part, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary())], names=["key", "part", "n", "closed", "open"])

    return run, f"key {kind}, part int, n long, closed binary, open binary"


def _cut(log: DataFrame, key: str) -> DataFrame:
    """Rows (key, us, ok, id) by key and time, dealt evenly: a key with most of the rows lies in many partitions, in a row."""
    rows = log.select(F.col(key).alias("key"), "us", "ok", "id")
    return rows.repartitionByRange(_many(log), "key", "us", "id").sortWithinPartitions("key", "us", "id")


def _many(log: DataFrame) -> int:
    """As many partitions as a shuffle has: a named number stays, where small ones would be put together."""
    return int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def final_states(log: DataFrame, rule, key: str, finish, schema: str) -> DataFrame:
    """finish(machine, key) for each key of log (key, us, id, ok) after its last request."""
    run, kinds = _functions(rule, log.schema[key].dataType.simpleString())
    spans = _cut(log, key).select("key", "us", "ok").mapInArrow(run, kinds)

    def step(s: list, name, part, n, closed, open_) -> None:
        s[0] = apply(s[0], n, closed, open_, rule)

    # a row for each partition that a key lies in
    return fold(spans, "key", ("part",), ("n", "closed", "open"), lambda: [State()], step, lambda s, name: finish(s[0].machine(rule), name), schema)


def verdicts(log: DataFrame, rule, key: str, schema: str) -> DataFrame:
    """(key, id, allowed, retry_after_us) for each request of log (key, us, id, ok)."""
    from webweft.operators.breaker import Machine

    kind = log.schema[key].dataType.simpleString()
    many = _many(log)
    rows = Stored(_cut(log, key).withColumn("part", F.spark_partition_id()), "requests").df
    placed = rows.repartitionById(many, F.col("part")).sortWithinPartitions("key", "us", "id")
    run, kinds = _functions(rule, kind)
    spans = placed.select("key", "us", "ok").mapInArrow(run, kinds)

    def begin(s: list, name, part, n, closed, open_) -> tuple | None:
        was = s[0]
        s[0] = apply(was, n, closed, open_, rule)
        return None if was == State() else (name, part, NAMES[was.kind], was.results, was.opened_at)

    # only a partition's first key can have begun in another: a row for each partition at most
    entries = Stored(fold(spans, "key", ("part",), ("n", "closed", "open"), lambda: [State()], begin, lambda s, name: None, f"key {kind}, part int, state string, results long, opened_at long"), "entries").df
    entries = entries.select(F.col("key").alias("__key"), F.col("part").alias("__part"), "state", "results", "opened_at")
    joined = rows.join(F.broadcast(entries), F.col("key").eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part")), "left")
    joined = joined.repartitionById(many, F.col("part")).sortWithinPartitions("key", "us", "id")

    def judge(s: list, name, us, i, ok, state, results, opened_at) -> tuple:
        if not s:
            s.append(Machine(rule) if state is None else Machine(rule, state, unpacked(results), opened_at))
        left = s[0].request(us, ok)
        return name, i, left is None, left

    return fold(joined, "key", ("us", "id"), ("ok", "state", "results", "opened_at"), list, judge, lambda s, name: None, schema, dealt=True)
