"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of words, a window into shingles. If a document holds so large a share of a
window's shingles, each in its place, it holds one of any few of them: of n shingles of which m must be
there, one of any n - m + 1. Those with the fewest occurrences in all documents are the window's prefix
(Chaudhuri et al. 2006; Xiao et al. 2008), and only where a document has a shingle of a prefix do the two meet.
Where the shingle stands in either says where the window would lie, so that it must fit into the document
(the bounds of length and position), and the words that lie there are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.llm.common import Stored, lean, read
from webweft.llm.wordhash import LOWER_CASE, UPPER_CASE, Filter, counted, hashes, runs, texts, words

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Prefix rows up to which every executor gets all of them; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Distinct shingles that a task counts before it sends them on.
COMBINE = 500_000

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_INSIDE = np.zeros(256, bool)
_INSIDE[ord("0") : ord("9") + 1] = _INSIDE[ord("a") : ord("z") + 1] = _INSIDE[128:] = True

_SHINGLES = "pattern string, n int, at int, size int, h long"
_FOUND = "doc_id long, doc long, rid long, n_words long, at long, size int, h long, first long, context array<string>"


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, pattern): each window of each item, its words joined by spaces; an item of fewer words is one window."""
    w = F.regexp_extract_all(F.translate(F.col(text_col), UPPER_CASE, LOWER_CASE), F.lit(WORD), F.lit(0))
    rows = items.select(F.col(id_col).alias("item_id"), w.alias("w")).where("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    return rows.select("item_id", "w", at.alias("at")).select("item_id", F.array_join(F.slice("w", F.col("at"), window), " ").alias("pattern")).distinct()


def _shingles(size: int):
    """A pattern's shingles with their place; fewer words than a shingle has are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for rows, data, ends in texts(b, 0):
                start, stop = words(data, _INSIDE)
                h = hashes(data, start, stop)
                edge = np.append(0, np.searchsorted(start, ends))
                for k, pattern in enumerate(b.column(0).slice(rows.start, rows.stop - rows.start).to_pylist()):
                    own = h[edge[k] : edge[k + 1]]
                    s = min(size, len(own))
                    got = runs(own, s).view(np.int64).tolist()
                    for col, x in zip(out, ([pattern] * len(got), [len(own)] * len(got), range(len(got)), [s] * len(got), got)):
                        col += x
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=[x.split()[0] for x in _SHINGLES.split(", ")])

    return run


def _met(filter_: Broadcast, h: np.ndarray, edge: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, place, hash) of the shingles of texts, whose words are parted at the edges, that the filter lets pass."""
    for size in sizes:
        got = runs(h, size)
        at = np.flatnonzero(filter_.value.has(got))
        of = np.searchsorted(edge, at, side="right") - 1
        at = at[at + size <= edge[of + 1]]
        yield size, at, got[at]


def _count(filter_: Broadcast, sizes: list[int]):
    """(h, n): how often each shingle of a window occurs in the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def send() -> pa.RecordBatch:
            h, n = counted(held)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for b in batches:
            for _, data, ends in texts(b, 0):
                start, stop = words(data, _INSIDE)
                h = hashes(data, start, stop)
                edge = np.append(0, np.searchsorted(start, ends))
                for _, _, got in _met(filter_, h, edge, sizes):
                    held.append((got, np.ones(len(got), np.int64)))
                    many += len(got)
                if many > COMBINE:
                    yield send()
                    held, many = [], 0
        if many:
            yield send()

    return run


def _find(filter_: Broadcast, sizes: list[int], window: int):
    """A row for each document (h is null), and one for each shingle of a prefix in it, with the words about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        for b in batches:
            ids, doc, rid = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            for rows, data, ends in texts(b, 3):
                start, stop = words(data, _INSIDE)
                h = hashes(data, start, stop)
                edge = np.append(0, np.searchsorted(start, ends))
                n = np.diff(edge)
                own = [pa.nulls(len(n), t) for t in kinds]
                own[:4] = [ids.slice(rows.start, len(n)), pa.array(doc[rows]), pa.array(rid[rows]), pa.array(n)]
                yield pa.RecordBatch.from_arrays(own, names=_FOUND_NAMES)
                for size, at, got in _met(filter_, h, edge, sizes):
                    for lo in range(0, len(at), 10_000):
                        p = at[lo : lo + 10_000]
                        of = np.searchsorted(edge, p, side="right") - 1
                        a, z = np.maximum(p - (window - size), edge[of]), np.minimum(p + window, edge[of + 1])
                        if size < SHINGLE:  # such a window is no longer than its shingle
                            a, z = p, p + size
                        context = [[data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(start[x:y].tolist(), stop[x:y].tolist())] for x, y in zip(a.tolist(), z.tolist())]
                        of, begin = of + rows.start, edge[of]
                        cols = (ids.take(pa.array(of)), doc[of], rid[of], n[of - rows.start], p - begin, np.full(len(p), size, np.int32), got[lo : lo + 10_000].view(np.int64), a - begin, context)
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds)], names=_FOUND_NAMES)

    return run


_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, containment: float = 1.0, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (doc_id, doc, rid, n_words), a row for each document; (doc, rid, start, n, pattern), where n words
    from the word start on hold a window; and (item_id, pattern), the windows of the items.

    containment: the share of a window's shingles that must be there, each in its place. doc and rid tell rows apart:
    the id, the smallest number for a null, and a hash of the text.
    """
    spark = docs.sparkSession
    windows = Stored(item_windows(items, window, item_col, item_text_col), "windows")
    shingles = Stored(windows.df.select("pattern").distinct().mapInArrow(lean(_shingles(shingle)), _SHINGLES), "shingles")
    sizes = sorted(r["size"] for r in shingles.df.select("size").distinct().collect())  # of 1 to `shingle`
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = Filter.of(shingles.df.select("h").distinct())
    counts = docs.select(text.alias("text")).mapInArrow(lean(_count(some, sizes)), "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))
    needed = F.col("all") - F.ceil(F.lit(containment) * F.col("all") - 1e-9) + 1
    by_rarity = Window.partitionBy("pattern").orderBy("df", "h", "at")
    rare = shingles.df.join(counts, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = rare.withColumn("rank", F.row_number().over(by_rarity)).withColumn("all", F.count("*").over(Window.partitionBy("pattern")))
    # a shingle that no document has leads nowhere
    prefix = Stored(rare.where((F.col("rank") <= needed) & (F.col("df") > 0)).select("h", "pattern", "n", "size", F.col("at").alias("inside"), "all"), "prefix")
    some.destroy()
    rid = F.xxhash64(text, F.col(id_col).isNull())
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("doc"), rid.alias("rid"), text.alias("text"))
    few = Filter.of(prefix.df.select("h").distinct())
    found = Stored(rows.mapInArrow(lean(_find(few, sizes, window)), _FOUND), "found")
    few.destroy()
    side = prefix.df.drop("size")
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    met = found.df.where("h is not null").join(side, "h").withColumn("start", F.col("at") - F.col("inside"))
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    here, there = F.slice("context", (F.col("start") - F.col("first") + 1).cast("int"), F.col("n")), F.split("pattern", " ")
    if containment >= 1:
        same = F.array_join(here, " ") == F.col("pattern")
    else:
        same = F.expr(f"size(filter(sequence(1, n - size + 1), j -> slice(here, j, size) = slice(there, j, size))) >= ceil({containment!r} * all - 1e-9)")
    hits = met.withColumns({"here": here, "there": there}).where(same).select("doc", "rid", "start", "n", "pattern").distinct()
    return found.df.where("h is null").select("doc_id", "doc", "rid", "n_words"), hits, windows.df


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, containment: float = 1.0, **columns: str) -> DataFrame:
    """(doc_id, n_words, n_hit, items array): one row per input row; how many of its words lie in a window of an item, and the items,
    sorted as strings.

    Texts and items that are null or without words have none. Items that share an id are one; one whose id is null
    hits words, and is not named. Rows that share an id are judged each by its own text. Of texts of any length all is compared.
    """
    rows, hits, windows = occurrences(docs, items, window, containment, **columns)
    hits = Stored(hits, "hits").df
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("doc", "rid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start") + F.col("n") - F.greatest("start", F.coalesce("before", F.lit(0)))
    cover = hits.select("doc", "rid", "start", "n").distinct().withColumn("before", before).groupBy("doc", "rid").agg(F.sum(F.greatest(new, F.lit(0))).alias("n_hit"))
    named = hits.select("doc", "rid", "pattern").distinct().join(windows.where("item_id is not null"), "pattern")
    named = named.groupBy("doc", "rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = rows.join(cover, ["doc", "rid"], "left").join(named, ["doc", "rid"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def op13_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all windows of ten words of all benchmark items; nulls and repeated rows as in decontaminate()."""
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_CASE}', '{LOWER_CASE}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_CASE}', '{LOWER_CASE}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS pattern
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS pattern
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
), hit AS (
  SELECT s.r, s.i, s.n, p.item_id FROM s JOIN p USING (n, pattern)
), covered AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM hit) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

QUERIES = {"op13_prefix_filtered_decontamination": op13_prefix_filtered_decontamination}
ORACLE: dict[str, str] = {"op13_prefix_filtered_decontamination": _ORACLE}
