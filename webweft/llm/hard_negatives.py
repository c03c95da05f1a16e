"""Hard negatives by bit-sliced integer products.

Vectors of integers are kept as bit planes, 64 components a word, most significant (the sign) first. The
product with an anchor grows by one plane of the candidates at a time: the planes of the two are
and-ed, their bits counted and weighted. What the planes yet to come can add lies between the sums of the anchor's negative
and of its positive components, times what those planes can hold; so each plane halves the interval that
a score lies in, and a candidate is dropped once its interval lies outside of the scores that are asked for, or
below those of as many candidates as are wanted. The scores that are left after the last plane are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.llm.common import Stored, lean, read

#: Candidates and anchors that meet in a cell, at most, and pairs that are looked at together.
CELL_ROWS, CELL_ANCHORS, PAIRS = 32_768, 4_096, 1 << 19
#: Below this share of candidates left, those that are left are looked at one by one.
SPARSE = 0.3
#: Scores stay below two to this power, so that a hundred of them fit into 64 bits.
SCORE_BITS = 55
LEAST, MOST = -(1 << SCORE_BITS), 1 << SCORE_BITS

_SLICED = "id long, label string, planes binary, anchor boolean"
_CELL = "cell long, kind int, id long, label string, planes binary, lo array<long>, hi array<long>"
_FOUND = "anchor_id long, slot int, id long, score long"


def slice_planes(v: np.ndarray, planes: int) -> np.ndarray:
    """uint64 [planes, words, rows] of an integer matrix [rows, components] in two's complement, most significant first."""
    n, d = v.shape
    words = max(1, -(-d // 64))
    out = np.zeros((planes, words, n), np.uint64)
    for k in range(planes):
        bits = np.zeros((n, words * 64), np.uint8)
        bits[:, :d] = v >> (planes - 1 - k) & 1
        out[k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n, words).T
    return out


def _weights(planes: int) -> list[int]:
    return [-(1 << (planes - 1)), *(1 << k for k in range(planes - 2, -1, -1))] if planes else []


def _count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that are set in both, over the first axis' words."""
    out = np.bitwise_count(a[0] & b[0]).astype(np.int64)
    for x, y in zip(a[1:], b[1:]):
        out += np.bitwise_count(x & y)
    return out


def _kth(at: np.ndarray, value: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th largest value of each of n groups; LEAST for a group of fewer."""
    order = np.lexsort((-value, at))
    first = np.searchsorted(at[order], np.arange(n + 1))
    out = np.full(n, LEAST, np.int64)
    has = np.diff(first) >= k
    out[has] = value[order][first[:-1][has] + k - 1]
    return out


def best(q: np.ndarray, c: np.ndarray, may: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, slot, candidate, score): for each anchor and each of its ranges lo..hi, the k candidates of the highest scores in it.

    q, c: bit planes [planes, words, rows]. may: which candidate is one for which anchor. Ties go to the smaller id.
    """
    planes, n, slots = len(q), q.shape[2], lo.shape[1]
    weight = _weights(planes)
    sign = [w * np.bitwise_count(q[i]).sum(0, dtype=np.int64) for i, w in enumerate(weight)]
    # the sums of an anchor's components, and of the negative ones: those with the sign's bit, in all their planes
    total = sum(sign) if planes else np.zeros(n, np.int64)
    minus = sum(w * np.bitwise_count(q[i] & q[0]).sum(0, dtype=np.int64) for i, w in enumerate(weight)) if planes else total
    plus = total - minus
    score = np.zeros(may.shape, np.int64)
    qi = ci = None
    done = 0

    def alive(at: np.ndarray, score: np.ndarray, left: int) -> np.ndarray:
        """Which pairs may still be wanted in some range, when so many planes are to come."""
        rest = (1 << left) - 1
        lower, upper = score + rest * minus[at], score + rest * plus[at]
        out = np.zeros(len(at), bool)
        for s in range(slots):
            ok = (upper >= lo[at, s]) & (lower <= hi[at, s])
            sure = ok & (lower >= lo[at, s]) & (upper <= hi[at, s])
            out |= ok & (upper >= _kth(at[sure], lower[sure], k, n)[at])
        return out

    while done < planes and qi is None:
        for i in range(planes):
            score += weight[done] * weight[i] * _count(q[i][:, :, None], c[done][:, None, :])
        done += 1
        left = planes - done
        rest = (1 << left) - 1
        lower, upper = score + rest * minus[:, None], score + rest * plus[:, None]
        ok = may & (upper >= lo.min(1)[:, None]) & (lower <= hi.max(1)[:, None])
        if slots == 1 and ok.shape[1] > k and lo.min() <= LEAST and hi.max() >= MOST:
            ok &= upper >= np.partition(np.where(may, lower, LEAST), -k, axis=1)[:, -k][:, None]
        if done == planes or ok.mean() < SPARSE:
            qi, ci = np.nonzero(ok)
            score = score[qi, ci]
    if qi is None:
        qi, ci = np.nonzero(may)
        score = score[qi, ci]
    keep = alive(qi, score, planes - done)
    qi, ci, score = qi[keep], ci[keep], score[keep]
    while done < planes and len(qi):
        for i in range(planes):
            score += weight[done] * weight[i] * _count(q[i][:, qi], c[done][:, ci])
        done += 1
        keep = alive(qi, score, planes - done)
        qi, ci, score = qi[keep], ci[keep], score[keep]
    out = []
    for s in range(slots):
        own = (score >= lo[qi, s]) & (score <= hi[qi, s])
        a, b, x = qi[own], ci[own], score[own]
        order = np.lexsort((ids[b], -x, a))
        a, b, x = a[order], b[order], x[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        a, b, x = a[rank < k], b[rank < k], x[rank < k]
        out.append((a, np.full(len(a), s), b, x))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _slice(planes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
                raw = np.ascontiguousarray(slice_planes(v, planes).transpose(2, 0, 1)).reshape(b.num_rows, -1)
                offsets = np.arange(b.num_rows + 1, dtype=np.int32) * raw.shape[1] * 8
                packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, b.column(3)], names=["id", "label", "planes", "anchor"])

    return run


def _planes(col: pa.Array, planes: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint64)
    return np.ascontiguousarray(raw.reshape(len(col), planes, -1).transpose(1, 2, 0))


def _search(planes: int, k: int, same: bool):
    """What the anchors of a cell (kind 1) find among its candidates (kind 0), which come before them."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = t.column("kind").to_numpy()
        many = int((kind == 0).sum())
        if not many or many == len(kind):
            return
        ids = t.column("id").to_numpy()
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        bits = _planes(t.column("planes").combine_chunks(), planes)
        by = np.argsort(label[:many], kind="stable")
        c_ids, c_label, c = ids[:many][by], label[:many][by], np.ascontiguousarray(bits[:, :, :many][:, :, by])
        order = np.argsort(label[many:], kind="stable")
        a_ids, a_label, q = ids[many:][order], label[many:][order], np.ascontiguousarray(bits[:, :, many:][:, :, order])
        lo, hi = (np.array(t.column(x).slice(many).to_pylist(), np.int64)[order] for x in ("lo", "hi"))
        at = 0
        while at < len(a_ids):
            # anchors of one label; of the candidates those of that label, or all others
            first, last = np.searchsorted(c_label, a_label[at]), np.searchsorted(c_label, a_label[at], side="right")
            pick = slice(first, last) if same else np.r_[0:first, last:many]
            n = last - first if same else many - (last - first)
            stop = min(int(np.searchsorted(a_label, a_label[at], side="right")), at + max(1, PAIRS // max(n, 1)))
            if n:
                own = c_ids[pick]
                a, slot, b, score = best(q[:, :, at:stop], c[:, :, pick], own[None, :] != a_ids[at:stop, None], lo[at:stop], hi[at:stop], own, k)
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[at:stop][a]), pa.array(slot.astype(np.int32)), pa.array(own[b]), pa.array(score)], names=["anchor_id", "slot", "id", "score"])
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            key = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo < hi:
                    if held and held[0].column(0)[0].as_py() != int(key[lo]):
                        yield from solve(pa.Table.from_batches(held))
                        held = []
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _meet(vectors: DataFrame, anchors: DataFrame, planes: int, k: int, same: bool, parts: int, blocks: int) -> DataFrame:
    """(anchor_id, slot, id, score): parts of the candidates meet blocks of the anchors, each in a cell, whatever their labels;
    each cell's k best for a slot."""
    none = F.array().cast("array<long>")
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    rows = vectors.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: part * blocks + b)).alias("cell"), F.lit(0).alias("kind"), "id", "label", "planes", none.alias("lo"), none.alias("hi"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    asked = anchors.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p * blocks + block)).alias("cell"), F.lit(1).alias("kind"), "id", "label", "planes", "lo", "hi")
    cells = rows.union(asked).repartition(parts * blocks, "cell").sortWithinPartitions("cell", "kind")
    return cells.mapInArrow(lean(_search(planes, k, same)), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component counts as the integer below `scale` times it; a score is the integer product with the anchor. For each row
    that anchor (a Boolean Column over id) holds for, the `positives` other rows of its label with the highest scores; for each of
    them the `negatives` rows of other labels whose score is of low to high hundredths of its, highest first. Ties go to the smaller id.

    Rows with a null id, label or vector, a null or non-finite component, another dimension than most, or a component that
    scores beyond 2**55 could come from (92,000 for 64 components) take no part. Of rows that share an id the least counts. Empty in, empty out.
    """
    spark = rows.sparkSession
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    x = x.where("id is not null and label is not null and x is not null").where(F.coalesce(fine, F.lit(False)))
    dims = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    blank = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not dims:
        return blank
    d = dims[0].d
    bound = int((2.0**SCORE_BITS / max(d, 1)) ** 0.5)
    x = x.where((F.size("x") == d) & F.forall("x", lambda e: F.abs(e * scale) < bound))
    whole = x.select("id", "label", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))
    if not whole.groupBy("id").count().where("count > 1").isEmpty():
        whole = whole.groupBy("id").agg(F.min(F.struct("v", "label")).alias("s")).select("id", "s.label", "s.v")
    stats = whole.agg(F.count("*").alias("n"), F.coalesce(F.max(F.array_max(F.transform("v", lambda e: F.abs(e)))), F.lit(0)).alias("most"), F.count_if(anchor).alias("asked")).first()
    if not stats.asked:
        return blank
    planes = int(stats.most).bit_length() + 1
    vectors = Stored(whole.select("id", "label", "v", F.coalesce(anchor, F.lit(False)).alias("anchor")).mapInArrow(lean(_slice(planes)), _SLICED), "planes")
    # more parts than the rows need where executors would be idle
    parts = max(-(-stats.n // CELL_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-stats.n // 1024)))
    blocks = max(1, -(-stats.asked // CELL_ANCHORS))
    asked = vectors.df.where("anchor").select("id", "label", "planes")
    any_ = {"lo": F.array(F.lit(LEAST)), "hi": F.array(F.lit(MOST))}
    near = _ranked(_meet(vectors.df, asked.withColumns(any_), planes, positives, True, parts, blocks), positives)
    near = Stored(near.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # at most `positives` rows an anchor, in order
    ranges = near.df.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    lo = F.transform("p", lambda p: -_floor_hundredth(-p["positive_score"] * low))
    hi = F.transform("p", lambda p: _floor_hundredth(p["positive_score"] * high))
    pad = lambda col, value: F.concat(col, F.array_repeat(F.lit(value), positives - F.size("p")))
    ranges = ranges.select(F.col("anchor_id").alias("id"), pad(lo, MOST).alias("lo"), pad(hi, LEAST).alias("hi"))
    found = _ranked(_meet(vectors.df, asked.join(ranges, "id"), planes, negatives, False, parts, blocks), negatives)
    found = found.select("anchor_id", (F.col("slot") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.df.join(found, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _floor_hundredth(x: Column) -> Column:
    """The whole number at or below a hundredth, exactly."""
    return F.floor((x - F.pmod(x, F.lit(100))).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")


def op11_bit_sliced_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors against all rows; every seventh row's label is first changed, so that some labels are wrong."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(rows, F.col("id") % 100 == 0)


_ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), neg AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM pos JOIN p USING (anchor_id) WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""

QUERIES = {"op11_bit_sliced_hard_negatives": op11_bit_sliced_hard_negatives}
ORACLE: dict[str, str] = {"op11_bit_sliced_hard_negatives": _ORACLE}
