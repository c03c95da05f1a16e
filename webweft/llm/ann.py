"""Approximate nearest neighbours by inner product, with an adaptive dimension scan in inverted lists.

A further coordinate makes all vectors equally long, so that the largest inner product is the least
distance. Vectors and queries are rotated at random and scanned by blocks of columns within each
probed list. After each block a hypothesis test compares the distance that the columns so far lead
to expect with the query's k-th best, and gives up candidates that are unlikely to reach it
(Gao and Long 2023; column blocks after Kuffo et al. 2025). What is left is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.llm.common import Stored, lean, read

#: Most vectors that lists are fitted on, by a hash of their id. Every vector is indexed.
SAMPLE = 20_000
#: Vectors of the sample whose scores give each query a first threshold. They stay in their lists, too.
PILOT = 2_048
MOST_LISTS = 1_024
#: Share of a query's true neighbours whose lists it should probe, as measured on CALIBRATION vectors of the sample, and
#: the least number of lists that it probes.
TARGET, CALIBRATION, LEAST_PROBES = 0.96, 512, 16
#: Lists that a query probes first; what they hold sets the threshold for the rest.
FIRST_LISTS = 4
#: Most candidates and queries that meet in one task.
GROUP_VECTORS, GROUP_QUERIES = 32_768, 4_096
#: Columns of a block, candidates that are scanned together, and the tests' confidence: at 1.4 recall on the check tables
#: is 0.962 and 0.978, at 2.1, which leaves about twice as many candidates, 0.964 and 0.979.
COLUMNS, ROWS, EPSILON = 16, 256, 1.4


@dataclass(frozen=True)
class Index:
    dim: int
    length: float  # of the longest vector
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    pilot: np.ndarray
    pilot_ids: np.ndarray
    pilot_list: np.ndarray
    reach: float  # lists that are no farther than a query's nearest one by this are probed
    least: int
    epsilon: float  # of the hypothesis tests

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rotated vectors, made equally long by one more coordinate."""
        rest = np.sqrt(np.maximum(self.length**2 - (x * x).sum(1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1) @ self.rotation

    def turn(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ self.rotation

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of queries to all lists, less the queries' own length."""
        return (self.centroids * self.centroids).sum(1) - 2 * self.turn(q) @ self.centroids.T

    def probed(self, far: np.ndarray) -> np.ndarray:
        """Which lists each query probes: those within reach, and the nearest ones in any case."""
        least = min(self.least, far.shape[1])
        edge = np.partition(far, least - 1, axis=1)[:, least - 1]
        return far <= np.maximum(far.min(1) + self.reach, edge)[:, None]


def fit(sample: np.ndarray, ids: np.ndarray, length: float, n: int, k: int = 20, target: float = TARGET, least: int = LEAST_PROBES, seed: int = 11) -> Index:
    """Lists from a sample of n vectors: about the square root of n of them, by k-means.

    How far a query probes is learned: so far that the lists of `target` of the true neighbours, which vectors of the
    sample have in the sample, are within reach. In all n vectors neighbours are nearer than in the sample.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
    none = np.zeros(0, np.int64)
    blank = Index(dim, length, rotation, np.zeros((0, dim + 1)), sample[:PILOT], ids[:PILOT], none, 0.0, least, EPSILON)
    x = blank.lift(sample)
    lists = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(n)))), 1, min(MOST_LISTS, len(x))))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        at = nearest(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        count = np.bincount(at, minlength=lists)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    at = nearest(x, c, 1)[:, 0]
    index = replace(blank, centroids=c, pilot_list=at[:PILOT])
    asked = rng.choice(len(sample), min(CALIBRATION, len(sample)), replace=False)
    need = []
    for some in np.array_split(asked, max(1, len(asked) // 64)):
        score = sample[some] @ sample.T
        score[np.arange(len(some)), some] = -np.inf
        most = min(k, len(sample) - 1)
        if most:
            near = np.argpartition(-score, most - 1, axis=1)[:, :most]
            far = index.distances(sample[some])
            need.append(np.take_along_axis(far, at[near], 1) - far.min(1)[:, None])
    return replace(index, reach=float(np.quantile(np.concatenate(need), target)) if need else 0.0)


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), dtype=np.int64)
    own = (c * c).sum(1)
    for i in range(0, len(x), 4096):
        d = own - 2 * x[i : i + 4096] @ c.T
        out[i : i + 4096] = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.arange(len(c))
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


_VECTOR = "list int, id long, x array<double>"
_QUERY = "id long, x array<double>, bound double, near array<int>, far array<int>"
#: What meets in a cell: candidates (kind 0, of one list) and queries (kind 1, with the cell's lists that they probe).
_CELL = "cell long, kind int, id long, x array<double>, bound double, lists array<int>"
_FOUND = "query_id long, vec_id long, score double"


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _assign(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = nearest(index.lift(_matrix(b.column(1), index.dim)), index.centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), b.column(1)], names=["list", "id", "x"])

    return run


def _probe(index: Index, k: int, every: bool = False):
    """Each query with the lists that it probes, the nearest ones apart, and the k-th best score of the pilot vectors in
    them; with `every` all lists and no bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                q, ids = _matrix(part.column(1), index.dim), part.column(0).to_numpy()
                far = index.distances(q)
                probed = np.ones(far.shape, bool) if every else index.probed(far)
                score = np.where(probed[:, index.pilot_list] & (ids[:, None] != index.pilot_ids), q @ index.pilot.T, -np.inf)
                bound = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k and not every else np.full(len(q), -np.inf)
                first = np.zeros(far.shape, bool)
                np.put_along_axis(first, np.argsort(far, axis=1, kind="stable")[:, :FIRST_LISTS], True, axis=1)
                cols = []
                for which in (probed & first, probed & ~first):
                    row, at = np.nonzero(which)
                    cols.append(_lists(np.searchsorted(row, np.arange(len(q) + 1)), at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bound), *cols], names=["id", "x", "bound", "near", "far"])

    return run


def scan(index: Index, ids: np.ndarray, x: np.ndarray, at: np.ndarray, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): each query's k best of these candidates that pass the tests, its own id left out.

    at: the list of each candidate, in order. asked: whether each query probes each list, by number.
    """
    xr, qr = index.lift(x), index.turn(q)
    dims = xr.shape[1]
    best = bound.copy()
    q_len = (q * q).sum(1)
    q_at, v_at, s_at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    for list_lo, list_hi in zip(starts, np.append(starts[1:], len(at))):
        own_q = np.flatnonzero(asked[:, at[list_lo]])
        if not len(own_q):
            continue
        for lo in range(list_lo, list_hi, ROWS):
            part = np.ascontiguousarray(xr[lo : min(lo + ROWS, list_hi)].T)  # by columns
            far = index.length**2 + q_len[own_q] - 2 * best[own_q]  # the distance of the k-th best
            far = np.where(np.isfinite(far), far, np.inf) * (1 + 1e-9) + 1e-12
            qi = vi = None
            done = 0
            while done < dims:
                cols = slice(done, min(dims, done + COLUMNS))
                a, b = qr[own_q, cols], part[cols]
                done = cols.stop
                last = done == dims
                limit = far * ((1 + index.epsilon / np.sqrt(done)) ** 2 * done / dims if not last else 1.0)
                if qi is None:
                    dist = (a * a).sum(1)[:, None] + (b * b).sum(0) - 2 * a @ b
                    qi, vi = np.nonzero(dist <= limit[:, None])
                    dist = dist[qi, vi]
                else:
                    for i in range(0, len(qi), 1 << 16):
                        s = slice(i, i + (1 << 16))
                        d = a[qi[s]] - b[:, vi[s]].T
                        dist[s] += np.einsum("ij,ij->i", d, d)
                    keep = dist <= limit[qi]
                    qi, vi, dist = qi[keep], vi[keep], dist[keep]
                if not len(qi):
                    break
            if not len(qi):
                continue
            qi, vi = own_q[qi], vi + lo
            other = q_ids[qi] != ids[vi]
            qi, vi = qi[other], vi[other]
            score = np.empty(len(qi))
            for i in range(0, len(qi), 1 << 16):
                s = slice(i, i + (1 << 16))
                score[s] = np.einsum("ij,ij->i", q[qi[s]], x[vi[s]])
            q_at, v_at, s_at = np.append(q_at, qi), np.append(v_at, vi), np.append(s_at, score)
            order = np.lexsort((ids[v_at], -s_at, q_at))
            q_at, v_at, s_at = q_at[order], v_at[order], s_at[order]
            first = np.flatnonzero(np.diff(q_at, prepend=-1))
            rank = np.arange(len(q_at)) - np.repeat(first, np.diff(np.append(first, len(q_at))))
            kth = rank == k - 1
            best[q_at[kth]] = np.maximum(best[q_at[kth]], s_at[kth])
            keep = rank < k
            q_at, v_at, s_at = q_at[keep], v_at[keep], s_at[keep]
    return q_ids[q_at], ids[v_at], s_at


def _search(index: Index, k: int):
    """What cells find; candidates of a cell come before its queries."""

    def solve(kind, ids, x, bound, size, lists) -> pa.RecordBatch | None:
        v, q = kind == 0, kind == 1
        if not v.any() or not q.any():
            return None
        row = np.repeat(np.arange(len(kind)), size)
        at = lists[v[row]]
        asked = np.zeros((int(q.sum()), len(index.centroids)), bool)
        asked[row[q[row]] - int(v.sum()), lists[q[row]]] = True
        by = np.argsort(at, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array(c) for c in scan(index, ids[v][by], x[v][by], at[by], ids[q], x[q], bound[q], asked, k)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cell() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held).combine_chunks()
            kind, ids, bound = (t.column(c).to_numpy() for c in ("kind", "id", "bound"))
            lists = t.column("lists").combine_chunks()
            return solve(kind, ids, _matrix(t.column("x").combine_chunks(), index.dim), bound, lists.value_lengths().to_numpy(), lists.flatten().to_numpy())

        for b in batches:
            key = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if held and held[0].column(0)[0].as_py() != int(key[lo]):
                    if (out := cell()) is not None:
                        yield out
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held and (out := cell()) is not None:
            yield out

    return run


def _groups(lists: DataFrame) -> list[tuple[int, int, int]]:
    """(list, first group, groups): lists packed into groups of candidates; one that is too long is several groups."""
    spark = lists.sparkSession
    # a row for each of at most MOST_LISTS lists
    size = sorted((r["list"], r.n) for r in lists.groupBy("list").agg(F.count("*").alias("n")).collect())
    all_ = sum(n for _, n in size)
    # fewer candidates a group, where there are too few groups to keep the executors busy
    most = int(min(GROUP_VECTORS, max(1_024, all_ // (2 * spark.sparkContext.defaultParallelism))))
    out, group, filled = [], 0, 0
    for at, n in size:
        if filled and filled + n > most:
            group, filled = group + 1, 0
        parts = -(-n // most)
        out.append((at, group, parts))
        group, filled = (group + parts, 0) if parts > 1 else (group, filled + n)
    return out


def _meet(index: Index, k: int, lists: DataFrame, groups: DataFrame, asked: DataFrame, probed: str, blocks: int) -> DataFrame:
    """What queries find in the lists of the column `probed`.

    Groups of candidates meet blocks of queries, each in a cell. A query comes to a group once, however many lists it
    probes there, and a candidate to a block once.
    """
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    vectors = lists.join(groups, "list").select((F.col("first") + part).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "id", "x", F.lit(0.0).alias("bound"), F.array("list").alias("lists"))
    goes = asked.select("id", F.explode(probed).alias("list")).join(groups, "list").select("id", "list", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("group"))
    goes = goes.groupBy("id", "group").agg(F.collect_set("list").alias("lists"))
    queries = goes.join(asked.select("id", "x", "bound"), "id").select("group", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "id", "x", "bound", "lists")
    cells = vectors.union(queries).select((F.col("group").cast("long") * blocks + F.col("block")).alias("cell"), "kind", "id", "x", "bound", "lists")
    return cells.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(lean(_search(index, k)), _FOUND)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): rows with an id and a finite vector that is not zero, of the dimension that most have; one for each id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("x", lambda c: c != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    dims = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("x") == (dims[0].n if dims else 0))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("x").alias("x"))
    return rows


def nearest_neighbours(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET, least_probes: int = LEAST_PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among all other rows, nearest first.

    query: a Boolean Column over (id). Ties go to the smaller id. Vectors that are null, zero, of another
    dimension than most, or hold null or non-finite components take no part; of rows that share an
    id the least vector counts. A query that finds fewer than k in its lists looks through all of them. Empty in,
    empty out.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    stats = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))).alias("length"), F.count_if(query).alias("asked")).first()
    if not stats.n or not stats.asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    index = fit(np.array([r.x for r in sample]), np.array([r.id for r in sample]), stats.length, stats.n, k, target, least_probes)
    lists = Stored(rows.mapInArrow(lean(_assign(index)), _VECTOR), "lists")
    asked = Stored(rows.where(query).mapInArrow(lean(_probe(index, k)), _QUERY), "probes")
    groups = F.broadcast(spark.createDataFrame(_groups(lists.df), "list int, first int, parts int"))
    meet = partial(_meet, index, k, lists.df, groups, blocks=max(1, -(-stats.asked // GROUP_QUERIES)))
    near = Stored(meet(asked.df, "near"), "found")
    # at most k rows a query and group so far: the k-th best of them is the threshold for the rest
    kth = near.df.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("id"), F.get("s", F.lit(k - 1)).alias("kth"))
    rest = asked.df.join(kth, "id", "left").withColumn("bound", F.greatest("bound", "kth"))
    found = Stored(near.df.union(meet(rest, "far")), "found")
    enough = found.df.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= min(k, stats.n - 1))
    lacking = asked.df.select("id", "x").join(enough, F.col("id") == F.col("query_id"), "left_anti")
    if not lacking.isEmpty():
        again = lacking.mapInArrow(lean(_probe(index, k, every=True)), _QUERY)
        every = Stored(found.df.join(enough, "query_id", "left_semi").union(meet(again, "near")).union(meet(again, "far")), "found")
        found.drop()
        found = every
    for t in (lists, asked, near):
        t.drop()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.df.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op7_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {"op7_adaptive_dimension_scan": op7_adaptive_dimension_scan}
ORACLE: dict[str, str] = {}
