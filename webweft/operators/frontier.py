"""Breadth-first traversal, level by level: joins, an anti-join with what is known, and a budget.

Order is that of one worker: by depth, then the parent's rank, then the link's place; the first discovery
of a node wins. With a small budget what is known stays on the driver and is broadcast, a level being one
top-k; else what is known is a set of bucketed tables (seen.py), so that a level shuffles what it has found and nothing that
was found before, and the driver sees row counts alone.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.functions import urls
from webweft.operators import fetch
from webweft.operators.seen import SeenSet
from webweft.stored import Stored

log = logging.getLogger("webweft.frontier")
#: Most nodes that the driver keeps; a larger budget goes by tables.
SMALL = 20_000
_LEVEL = "node string, depth int, rank long"


class _OnDriver:
    """Levels of at most SMALL nodes in all."""

    def __init__(self, spark: SparkSession, budget: int):
        self.spark, self.left, self.rows, self.known = spark, budget, [], set()

    def take(self, found: DataFrame, depth: int) -> tuple[DataFrame, int]:
        # a level's best, be they known or not: no more than twice SMALL
        first = _in_order(found).limit(self.left + len(self.rows)).select("node").collect()
        got = [r for r in first if r["node"] not in self.known][: self.left]
        self.known.update(r["node"] for r in got)
        level = [(r["node"], depth, k) for k, r in enumerate(got)]
        self.rows += level
        self.left -= len(level)
        return F.broadcast(self._table(level)), len(level)

    def _table(self, rows: list[tuple]) -> DataFrame:
        kinds = (pa.string(), pa.int32(), pa.int64())
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return self.spark.createDataFrame(pa.table(cols, names=["node", "depth", "rank"]))  # a local relation: no task reads it

    def all(self) -> DataFrame:
        return self._table(self.rows)


class _InTables:
    """Levels of any size."""

    def __init__(self, spark: SparkSession, budget: int):
        self.left, self.seen = budget, SeenSet(spark)

    def take(self, found: DataFrame, depth: int) -> tuple[DataFrame, int]:
        first = self.seen.unseen(_first_places(found)).orderBy("at", "node")
        level = first.select("node", F.lit(depth).alias("depth"), F.monotonically_increasing_id().alias("rank"))
        table = self.seen.add(level)
        if table.rows > self.left:  # only the last level is cut
            self.seen.tables.remove(table)
            cut = self.seen.add(table.df.orderBy("rank").limit(self.left))
            table.drop()
            table = cut
        self.left -= table.rows
        return table.df, table.rows

    def all(self) -> DataFrame:
        return self.seen.all()


def unseen(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of found whose node is none of known's; a null node is known to none."""
    return found.join(known.select("node"), "node", "left_anti")


def within(rows: DataFrame, domains: DataFrame, url: str = "node") -> DataFrame:
    """rows whose URL is of one of the domains (www or not), a table (domain) of any size."""
    own = domains.select(urls.normalize_domain(F.col("domain")).alias("__domain")).where("__domain <> ''")
    return rows.join(own, urls.normalize_domain(F.col(url)) == F.col("__domain"), "left_semi")


def _first_places(rows: DataFrame) -> DataFrame:
    """(node, at) of the distinct nodes of (node, parent, pos): where each was discovered first."""
    return rows.groupBy("node").agg(F.min(F.struct("parent", "pos")).alias("at"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Distinct nodes of (node, parent, pos), first discovered first."""
    return _first_places(rows).orderBy("at", "node")


def traverse(seeds: DataFrame, expand: Callable[[DataFrame], DataFrame], max_depth: int = 2, max_nodes: int = 100, allowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, depth, rank) of admitted nodes.

    seeds: (node, pos). expand: from a level to (parent long, node, pos), parent being the level's rank. allowed:
    rows with a column node, of which it keeps those that may be visited. max_nodes counts all that are admitted,
    seeds and such as turn out to fail among them. Null and empty nodes are none; no seeds give no rows.
    """
    if max_nodes < 1 or max_depth < 0:
        raise ValueError("max_nodes must be at least 1, max_depth at least 0")
    ok = allowed or (lambda rows: rows)
    there = "node is not null and node <> ''"
    known = (_OnDriver if max_nodes <= SMALL else _InTables)(seeds.sparkSession, max_nodes)
    start = seeds.where(there).select("node", F.lit(0).cast("long").alias("parent"), "pos")
    level, n = known.take(ok(start), 0)
    for depth in range(1, max_depth + 1):
        if not n or not known.left:
            break
        level, n = known.take(ok(expand(level).select("node", "parent", "pos").where(there)), depth)
    return known.all()


def traverse_edges(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_nodes: int = 100, stored: bool = True) -> DataFrame:
    """traverse() over a table of edges (src, dst, pos).

    Edges that are derived are stored once, so that no level derives them again; stored=False leaves out the copy of
    edges that are read from a table as they are.
    """
    edges = edges.select("src", "dst", "pos")
    kept = Stored(edges, "edges") if stored else None
    table = kept.df if kept else edges

    def expand(level: DataFrame) -> DataFrame:
        return table.join(level, table.src == level.node).select(F.col("rank").alias("parent"), F.col("dst").alias("node"), "pos")

    out = traverse(seeds, expand, max_depth, max_nodes)
    if kept:
        kept.drop()
    return out


def crawl(answer: Callable[[DataFrame], DataFrame], seeds: DataFrame, max_pages: int = 100, max_depth: int = 2, same_domain_only: bool = False, allowed_domains: list[str] | None = None, exclude: list[str] | None = None, include: list[str] | None = None, page_callback: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(url, depth, rank, ok, status_code, content_type, kind, error, attempts, page): the pages that a crawl visits, parsed once.

    answer: from (url) to (url, html, status_code, content_type, kind, error[, attempts]), as fetch.fetch gives it for a
    snapshot and live.fetch_live for the Web. seeds: (url, pos). With same_domain_only the domains of the seeds and
    allowed_domains bound the crawl. A URL that is not answered, or with a status of 400 or more, fails: it counts,
    but leads nowhere. page_callback is handed each level's rows, which are stored by then.
    """
    spark = seeds.sparkSession
    visits: list[DataFrame] = []
    own = None
    if same_domain_only:
        own = seeds.select(F.col("url").alias("domain"))
        if allowed_domains:
            own = own.union(spark.createDataFrame([(d,) for d in allowed_domains], "domain string"))
        own = Stored(own.distinct(), "domains").df

    def allowed(rows: DataFrame) -> DataFrame:
        rows = rows.where(urls.url_filter(F.col("node"), None if same_domain_only else allowed_domains, exclude, include))
        return rows if own is None else within(rows, own)

    def visit(level: DataFrame) -> DataFrame:
        asked = level.select(F.col("node").alias("url"), "depth", "rank")
        got = answer(asked.select("url"))
        tries = F.col("attempts") if "attempts" in got.columns else F.lit(1)
        got = got.select("url", "html", "status_code", "content_type", "kind", "error", tries.cast("int").alias("attempts")).join(asked, "url")
        parsed = fetch.parse_answers(got, ("depth", "rank", "status_code", "content_type", "attempts"))
        done = Stored(parsed.select("url", "depth", "rank", F.col("kind").isNull().alias("ok"), "status_code", "content_type", "kind", "error", "attempts", "page"), "visits").df
        visits.append(done)
        if page_callback:
            try:
                page_callback(done)
            except Exception:  # what a listener does is no reason to stop a crawl
                log.exception("page_callback failed")
        return done

    def expand(level: DataFrame) -> DataFrame:
        links = visit(level).where("ok").select(F.col("rank").alias("parent"), F.posexplode("page.links").alias("pos", "link"))
        return links.select("parent", urls.normalize_url(F.col("link")).alias("node"), "pos")

    start = seeds.select(urls.normalize_url(F.col("url")).alias("node"), "pos")
    seen = traverse(start, expand, max_depth, max_pages, allowed)
    # the last level was admitted, but nothing asked for its links
    last = seen.where(F.col("depth") == len(visits))
    visit(last)
    out = visits[0]
    for v in visits[1:]:
        out = out.union(v)
    return out


def seed_union(*parts: DataFrame) -> DataFrame:
    """(url, part, pos) of several lists (url, pos) one after another, each URL at its first place."""
    rows = None
    for i, p in enumerate(parts):
        one = p.select("url", F.lit(i).alias("part"), "pos")
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy("url").agg(F.min(F.struct("part", "pos")).alias("at"))
    return first.select("url", "at.part", "at.pos")


def queue_stats(outcomes: DataFrame) -> DataFrame:
    """One row of counts by state from (url, state, offers): a URL offered again is a duplicate that was skipped."""
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    return outcomes.agg(state("queued"), state("in_progress"), state("processed"), state("failed"), F.count("*").alias("total_added"), F.coalesce(F.sum(F.col("offers") - 1), F.lit(0)).alias("duplicates_skipped"))


def pop_order(offers: DataFrame) -> DataFrame:
    """(item, priority, seq) of a priority queue's distinct offers: higher priority first, then first come."""
    first = offers.groupBy("item").agg(F.min_by("priority", "seq").alias("priority"), F.min("seq").alias("seq"))
    return first.orderBy(F.desc("priority"), "seq")
