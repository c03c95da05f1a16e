"""Removal of repeated long strings, by anchors and merged Burrows-Wheeler transforms of what lies around them.

A string of `length` bytes is a window; the k-byte piece in it with the least hash, the first of equal ones, is
its anchor, which depends on the string alone. So equal strings have equal anchors, and only occurrences of an
anchor that is there more than once need be compared (no hash decides: it only says which pieces meet).
An anchor's context are the windows that it is the anchor of, which lie in a row.

Contexts that are equal (128 bits of two independent hashes) need no sorting: all but the first
are repeats throughout. What remains are anchors in differing contexts. Contexts that meet are dealt
to shards by document, each shard's Burrows-Wheeler transform is built, and the transforms are merged by
refining their interleave (see bwt.py): the intervals that are left after `length` bytes are the repeated strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm import bwt
from webweft.llm.common import Stored, keyed_text, lean, read, release_shuffles

LENGTH = 100
#: Bytes of an anchor. Contexts of an anchor that has more than MANY go by longer anchors within them; with the last,
#: an anchor is a whole string, so that equal contexts are all there is and nothing is left to merge.
PIECES = (36, 84, 100)
MANY = 32_768
#: Bytes of text that a worker takes at once, and anchors that it combines before it sends them.
BYTES = 256_000
COMBINE = 300_000
#: Contexts that are merged at once.
CONTEXTS = 8_192

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE)
_powers: dict = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get(which)
    if got is None or len(got[0]) < n:
        n = max(n, 2 * BYTES)
        got = _powers[which] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, dtype=np.uint64)]), dtype=np.uint64) for x in (_BASE[which], _INVERSE[which]))
    return got


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64; the hash of [a, b) is (s[b] - s[a]) * inverse**a."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[which][data] * _power(which, len(data))[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width], for each i at which that fits."""
    span = 1
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x.copy()


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, piece: int = PIECES[0]) -> tuple[np.ndarray, ...]:
    """(at, anchor hash, two context hashes, context start, context end) in texts laid end to end, each up to its end."""
    n, w = len(data), length - piece + 1
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.uint64, np.int64, np.int64))
    if n < length:
        return none
    size = np.diff(ends, prepend=0)
    end = np.repeat(ends, size)
    s0, s1 = _sums(data, 0), _sums(data, 1)
    h = _mix((s0[piece:] - s0[:-piece]) * _power(0, n + 1)[1][: n + 1 - piece])
    h |= np.uint64(1)
    i = np.arange(n + 1 - piece)
    h[i + piece > end[: len(i)]] = _MAX
    least = _slide(h, w, np.minimum)
    j = np.arange(len(least))
    least[j + length > end[: len(j)]] = 0
    pad = np.zeros(w - 1, dtype=np.uint64)
    at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), w, np.maximum)[: len(h)] == h) & (h != _MAX))
    if not len(at):
        return none
    # the first window of each: one with a lesser hash takes over when it comes in sight, another when the one before goes out
    begin = (end - np.repeat(size, size))[at]
    lesser = np.append(False, h[at[1:]] < h[at[:-1]])
    start = np.where(lesser, at - w + 1, np.append(0, at[:-1] + 1))
    start = np.where(np.append(True, begin[1:] != begin[:-1]), begin, np.maximum(start, begin))
    after = np.append(np.minimum.accumulate(start[::-1])[::-1][1:], n)
    stop = np.minimum(after, end[at] - length + 1)
    owns = start < stop
    at, lo, hi = at[owns], start[owns], stop[owns] - 1 + length
    shape = _mix(((at - lo) << 20 | (hi - at)).astype(np.uint64))
    c, c2 = (_mix((s[hi] - s[lo]) * _power(k, n + 1)[1][lo]) ^ shape for k, s in ((1, s1), (0, s0)))
    return at, h[at], c, c2, lo, hi


#: An anchor on its way: place holds where it starts, how far its context reaches to the left and right and, as the
#: last bit, that the context is known to repeat an earlier one.
_ANCHOR = "h long, c long, c2 long, doc long, rid long, place long"
_ROW = "kind int, h long, doc long, rid long, lo int, hi int"


def _batch(schema: str, *cols) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    n = max(len(c) for c in cols if not np.isscalar(c))
    kind = {"int": np.int32, "long": np.int64}
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, c, kind[t]) if np.isscalar(c) else np.asarray(c).astype(kind[t])) for c, (_, t) in zip(cols, fields)], names=[k for k, _ in fields])


def _span(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the context of a place."""
    at = place >> 15
    return at - (place >> 8 & 127), at + (place >> 1 & 127)


def _find(piece: int):
    """Anchors in texts (doc, rid, lo, text or bytes), lo being where the text starts in its document; contexts that
    repeat an earlier one of the same task are marked and spread evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _find_in(batches, piece)

    return run


def _find_in(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def combine() -> Iterator[pa.RecordBatch]:
        h, c, c2, doc, rid, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, rid, doc, c2, c, h))
        h, c, c2, doc, rid, place = (x[order] for x in (h, c, c2, doc, rid, place))
        again = np.append(False, (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (c2[1:] == c2[:-1]))[: len(h)]
        # a text that is there twice under one id is one document
        twin = np.append(False, (doc[1:] == doc[:-1]) & (rid[1:] == rid[:-1]) & (place[1:] == place[:-1]))[: len(h)] & again
        h = np.where(again, _mix((doc ^ place << 5).view(np.uint64)).view(np.int64), h)
        c, c2, place = np.where(again, 0, c), np.where(again, 0, c2), place | again
        for k in range(0, len(h), 100_000):
            keep = ~twin[k : k + 100_000]
            yield _batch(_ANCHOR, *(x[k : k + 100_000][keep] for x in (h, c, c2, doc, rid, place)))

    def take(raw: list[bytes], docs: list[int], rids: list[int], los: list[int]) -> None:
        nonlocal size
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        at, h, c, c2, lo, hi = anchors(data, ends, piece=piece)
        of = np.searchsorted(ends, at, side="right")
        start = (ends - np.array([len(r) for r in raw]) - np.array(los))[of]
        place = (at - start) << 15 | (at - lo) << 8 | (hi - at) << 1
        held.append((h.view(np.int64), c.view(np.int64), c2.view(np.int64), np.array(docs, np.int64)[of], np.array(rids, np.int64)[of], place))
        size += len(at)

    for b in batches:
        part: list[tuple] = []
        n = 0
        for d, r, lo, t in zip(*(c.to_pylist() for c in b.columns)):
            raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t
            part.append((raw, d, r, lo))
            n += len(raw)
            if n >= BYTES:
                take(*map(list, zip(*part)))
                part, n = [], 0
        if part:
            take(*map(list, zip(*part)))
        if size >= COMBINE:
            yield from combine()
            held, size = [], 0
    if held:
        yield from combine()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by all their columns: repeats of a context (kind 1), and the first of each context
    (kind 0) of anchors that have several. Nothing of a group is held but its last row and its first context."""
    last = None  # the row before
    pending = None  # the first context of an anchor, until another is seen
    several = False  # the row before's anchor has several contexts

    def rows(kind: int, h, doc, rid, place) -> pa.RecordBatch:
        return _batch(_ROW, kind, h, doc, rid, *_span(place))

    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(6)]
        known = cols[5] & 1 == 1
        if known.any():
            h, _, _, doc, rid, place = (x[known] for x in cols)
            yield rows(1, h, doc, rid, place)
            cols = [x[~known] for x in cols]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.append(x, y) for x, y in zip(last, cols)]
        h, c, c2, doc, rid, place = cols
        own = np.ones(len(h), bool)
        own[0] = last is None
        same_h = np.append(False, h[1:] == h[:-1])
        same_c = same_h & np.append(False, (c[1:] == c[:-1]) & (c2[1:] == c2[:-1]))
        twin = same_c & np.append(False, (doc[1:] == doc[:-1]) & (rid[1:] == rid[:-1]) & (place[1:] == place[:-1]))
        r = same_c & ~twin & own
        if r.any():
            yield rows(1, h[r], doc[r], rid[r], place[r])
        # of each anchor, in this batch: its first row, and whether it shows a second context
        first = np.flatnonzero(~same_h)
        new_c = same_h & ~same_c
        group = np.cumsum(~same_h) - 1
        shows = np.bincount(group[new_c], minlength=len(first)) > 0
        shows[0] |= several and last is not None
        if last is not None and shows[0] and pending is not None:
            ph, _, _, pdoc, prid, pplace = (np.array([x]) for x in pending)
            yield rows(0, ph, pdoc, prid, pplace)
            pending = None
        send = (new_c | (~same_h & shows[group])) & own
        if send.any():
            yield rows(0, h[send], doc[send], rid[send], place[send])
        g = group[-1]
        if g > 0 or last is None:
            several = bool(shows[g])
            pending = None if several else tuple(x[first[g]] for x in cols)
        else:
            several = bool(shows[0])
        last = tuple(x[-1:] for x in cols)


_CONTEXT = "h long, doc long, rid long, lo int, context binary"
_CONTEXT_NAMES = [x.split()[0] for x in _CONTEXT.split(", ")]


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for doc, rid, text, places in zip(*(c.to_pylist() for c in b.columns)):
            raw = text.encode("utf-8", "surrogatepass")
            out += [(p["h"], doc, rid, p["lo"], raw[p["lo"] : p["hi"]]) for p in places]
        yield from _contexts(out)


def _contexts(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 20_000):
        cols = list(zip(*rows[k : k + 20_000]))
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], names=_CONTEXT_NAMES)


def repeated_spans(contexts: list[bytes], doc: np.ndarray, rid: np.ndarray, lo: np.ndarray, length: int = LENGTH, shard: int = bwt.SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, start, end): spans of the contexts that are covered by strings which start earlier elsewhere among them."""
    size = np.array([len(c) for c in contexts])
    # shards are of documents in a row
    dealt = np.lexsort((lo, rid, doc))
    data = np.frombuffer(b"".join([contexts[k] for k in dealt.tolist()]), np.uint8)
    size, doc, rid, lo = size[dealt], doc[dealt], rid[dealt], lo[dealt]
    start = np.cumsum(size) - size
    many = np.maximum(size - length + 1, 0)
    begin = np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)
    order, block = bwt.repeated(data, size, begin, length // bwt.STRIDE, shard)
    empty = np.zeros(0, dtype=np.int64)
    if not len(order):
        return empty, empty, empty
    seg = np.searchsorted(start, order, side="right") - 1
    # contexts lie by document, so a number for each document is one that counts up
    number = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])))
    place = number[seg].astype(np.int64) << 32 | (order - start[seg] + lo[seg])
    first = np.flatnonzero(np.diff(block, prepend=-1))
    least = np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, len(block))))
    late = np.flatnonzero(place > least)
    if not len(late):
        return empty, empty, empty
    by = late[np.argsort(place[late], kind="stable")]
    p = place[by]
    new = np.append(True, p[1:] > p[:-1] + length)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    return dealt[seg[by[at]]], p[at] & 0xFFFFFFFF, (p[last] & 0xFFFFFFFF) + length


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor to spans. Anchors are merged many at a time; one anchor's contexts are never parted."""

    def solve(h, doc, rid, lo, ctx) -> pa.RecordBatch:
        seg, a, b = repeated_spans(ctx, doc, rid, lo)
        return _batch(_ROW, 1, 0, doc[seg], rid[seg], a, b)

    h = doc = rid = np.zeros(0, np.int64)
    lo, ctx = np.zeros(0, np.int32), []
    for b in batches:
        h, doc, rid = (np.append(x, b.column(i).to_numpy()) for i, x in enumerate((h, doc, rid)))
        lo, ctx = np.append(lo, b.column(3).to_numpy()), ctx + b.column(4).to_pylist()
        while len(h) > CONTEXTS:
            starts = np.flatnonzero(h[1:] != h[:-1]) + 1
            starts = starts[starts <= max(CONTEXTS, starts[0])] if len(starts) else starts
            if not len(starts):
                break
            cut = int(starts[-1])
            yield solve(h[:cut], doc[:cut], rid[:cut], lo[:cut], ctx[:cut])
            h, doc, rid, lo, ctx = h[cut:], doc[cut:], rid[cut:], lo[cut:], ctx[cut:]
    if len(h):
        yield solve(h, doc, rid, lo, ctx)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, rid, text). rid is 0 where ids are unique, else a hash of the text. A null id comes first."""
    rows = keyed_text(docs, id_col, text_col).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    clash = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    return rows.select("doc_id", "doc", (F.xxhash64("text", F.col("doc_id").isNull()) if clash else F.lit(0).cast("long")).alias("rid"), "text")


def _anchored(rows: DataFrame, piece: int) -> Stored:
    """Anchors of rows (doc, rid, lo, text) that meet: repeats (kind 1), and first contexts that differ (kind 0)."""
    found = rows.select("doc", "rid", "lo", "text").mapInArrow(lean(_find(piece)), _ANCHOR)
    met = found.repartition("h").sortWithinPartitions("h", "c", "c2", "doc", "rid", "place").mapInArrow(lean(_meet), _ROW)
    met = Stored(met, "met")
    release_shuffles(rows.sparkSession)
    return met


def _crowded(met: Stored, many: int) -> DataFrame:
    return met.df.where("kind = 0").groupBy("h").count().where(F.col("count") > many).select("h")


def _merged(contexts: DataFrame) -> Stored:
    return Stored(contexts.repartition("h").sortWithinPartitions("h").mapInArrow(lean(_merge), _ROW), "spans")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc, rid, text) and (doc, rid, spans array<struct<lo, hi>>): bytes of each document to remove, unmerged."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    found = rows.withColumn("lo", F.lit(0))
    done = []
    for piece in PIECES:
        met = _anchored(found, piece)
        done.append(met)
        if piece == PIECES[-1]:
            break
        crowded = _crowded(met, many)
        places = met.df.where("kind = 0").groupBy("doc", "rid").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("places"))
        contexts = rows.join(places, ["doc", "rid"]).select("doc", "rid", "text", "places").mapInArrow(lean(_cut_contexts), _CONTEXT)
        if crowded.isEmpty():
            done.append(_merged(contexts))
            break
        # crowded anchors: the same again within their contexts, by longer anchors
        contexts = Stored(contexts, "contexts")
        done.append(_merged(contexts.df.join(crowded, "h", "left_anti").select(*_CONTEXT_NAMES)))
        found = Stored(contexts.df.join(crowded, "h", "left_semi").select("doc", "rid", "lo", F.col("context").alias("text")), "crowded").df
        contexts.drop()
    release_shuffles(spark)
    marks = None
    for t in done:
        own = t.df.where("kind = 1").select("doc", "rid", F.struct("lo", "hi").alias("span"))
        marks = own if marks is None else marks.union(own)
    marks = Stored(marks.groupBy("doc", "rid").agg(F.collect_set("span").alias("spans")), "marks")
    for t in done:
        t.drop()
    release_shuffles(spark)
    return rows, marks.df


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<lo, hi>>, kept binary): one row per input row.

    Byte spans, maximal and in order, that are covered by strings of LENGTH bytes which also start
    earlier (smaller id, or same text further left), and the bytes that remain. Null text is empty.
    Rows that share an id are taken in the order of a hash of their texts; of equal ones all but
    one lose every byte, if they have LENGTH. A null id comes before all others. Empty in, empty out.
    """
    rows, marks = repeated(docs, id_col, text_col, many)
    joined = rows.join(marks, ["doc", "rid"], "left")
    if not rows.where("rid <> 0").isEmpty():
        from pyspark.sql import Window

        joined = joined.withColumn("n", F.row_number().over(Window.partitionBy("doc", "rid").orderBy("rid")))
    else:
        joined = joined.withColumn("n", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, gone, left = [], [], [], []
            for doc_id, text, spans, n in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                cut = merged([(s["lo"], s["hi"]) for s in spans or ()])
                if n > 1 and len(raw) >= LENGTH:
                    cut = [(0, len(raw))]
                edges = [0, *(x for s in cut for x in s), len(raw)]
                ids.append(doc_id)
                sizes.append(len(raw))
                gone.append([{"lo": lo, "hi": hi} for lo, hi in cut])
                left.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.select("doc_id", "text", "spans", "n").mapInArrow(lean(run), "doc_id long, n_bytes long, removed array<struct<lo:int,hi:int>>, kept binary")


def whole_characters(text: str, cut: list[tuple[int, int]]) -> str:
    """text without the byte spans, each narrowed to the characters that lie wholly in it."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for lo, hi in cut:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append(raw[at:lo])
        at = hi
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs in all their columns, text without its repeats and count_col, where there is one, renewed.

    Characters that a repeat covers in part stay. Rows without repeats are as they were.
    """
    rows, marks = repeated(docs, id_col, text_col)
    clash = not rows.where("rid <> 0").isEmpty()

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else whole_characters(t, merged(list(zip(a.tolist(), z.tolist())))) for t, a, z in zip(text, lo, hi)], dtype=object)

    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) == F.col("__m.doc"), (F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull()) if clash else F.lit(0)) == F.col("__m.rid")]
    marks = marks.select(F.struct("doc", "rid", F.transform("spans", lambda s: s["lo"]).alias("lo"), F.transform("spans", lambda s: s["hi"]).alias("hi")).alias("__m"))
    out = docs.join(marks, key[0] & key[1] if clash else key[0], "left")
    new = F.when(F.col("__m").isNull(), F.col(text_col)).otherwise(cleaned(F.coalesce(F.col(text_col), F.lit("")), F.col("__m.lo"), F.col("__m.hi")))
    out = out.withColumn(text_col, new).drop("__m")
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col in docs.columns else out


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLE: dict[str, str] = {}
