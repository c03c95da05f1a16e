"""Connected components of a distributed edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.llm.common import Stored, lean

#: With this many edges left, one task can finish the job; more edges go on in distributed rounds.
ONE_TASK_EDGES = 16_384


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the edges a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges, contracted to a star around each local component's smallest node."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    u = np.concatenate([b.column(0).to_numpy() for b in got])
    v = np.concatenate([b.column(1).to_numpy() for b in got])
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
    off = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(nodes[root[off]])], names=["u", "v"])


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node long, root long) for each node that has an edge; root is the smallest node reachable.

    edges: two long columns u, v; loops, repeats and nulls are ignored. A hub's edges are never
    gathered: minima are partial aggregates and joins may be split by AQE.
    """
    edges = edges.toDF("u", "v").where("u is not null and v is not null and u <> v")
    now = Stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().mapInArrow(lean(_stars), "u long, v long"), "edges")
    while True:
        e = now.df
        n = e.count()
        if n <= one_task_edges:
            done = Stored(e.coalesce(1).mapInArrow(lean(_stars), "u long, v long"), "stars")
            now.drop()
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours hang on the node's minimum
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = Stored(large, "large")
        # small star: a node and its smaller neighbours hang on their minimum
        lo = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(lo, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lo.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = Stored(small, "edges")
        large.drop()
        changed = new.df.exceptAll(now.df).limit(1).count() or new.df.count() != n
        now.drop()
        now = new
        if not changed:
            done = now
            break
    roots = done.df
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v").distinct())
