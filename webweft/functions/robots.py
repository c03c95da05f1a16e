"""robots.txt as relations: a rules table by origin, and first-match decisions by an equi-join on it.

The first matching rule of a group, in the file's order, decides; a prefix is literal, and both it and
the page's path are compared unescaped and escaped anew. Numbers of Crawl-delay that are not whole
are ignored. That is what the standard library does on Python 3.13.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from webweft.functions import urls

#: Characters of a file that are read, and seconds for which a result holds.
MOST_CHARS, TTL, ERROR_TTL = 512 * 1024, 3600.0, 60.0
#: A rule's prefix that starts no path.
NOTHING = "\x01"

RULES = "array<struct<grp:int,agents:array<string>,ord:int,allow:boolean,prefix:string>>"
PARSED = f"struct<rules:{RULES},delays:array<struct<grp:int,agents:array<string>,delay:double>>,sitemaps:array<string>>"


#: Paths that escaping leaves as they are; longer ones than this table of signs go through Python.
PLAIN = r"^/[A-Za-z0-9_.\-~/]*$"


def clean_prefix(path: str) -> str:
    """What a rule's path is compared as."""
    return quote(urlunparse(urlparse(unquote(path))))


def clean_path(url: str | None) -> str | None:
    """What a page's URL is compared as: all behind its authority, unescaped and escaped anew."""
    if url is None:
        return None
    try:
        parts = urlparse(unquote(url))
    except ValueError:
        return None
    return quote(urlunparse(("", "", parts.path, parts.params, parts.query, parts.fragment))) or "/"


def parse_robots(body: str | None) -> dict:
    """Groups of rules in order, whole-number delays, and sitemaps. A group without rules after its agents still counts."""
    rules, delays, sitemaps = [], [], []
    agents: list[str] = []
    group, ruled = 0, False
    for line in (body or "")[:MOST_CHARS].splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            if ruled:  # a blank line ends a group
                agents, ruled = [], False
                group += 1
            elif agents:
                agents = []
            continue
        name, sep, value = line.partition(":")
        name, value = name.strip().lower(), unquote(value.strip())
        if not sep:
            continue
        if name == "user-agent":
            if ruled:
                agents, ruled = [], False
                group += 1
            agents = [*agents, value.lower()]
        elif name in ("allow", "disallow") and agents:
            allow = name == "allow" or not value
            rules.append({"grp": group, "agents": agents, "ord": len(rules), "allow": allow, "prefix": clean_prefix(value)})
            ruled = True
        elif name == "crawl-delay" and agents:
            # a rule that matches nothing, so that the group is known by its rules alone
            rules.append({"grp": group, "agents": agents, "ord": len(rules), "allow": True, "prefix": NOTHING})
            if value.isdigit():
                delays.append({"grp": group, "agents": agents, "delay": float(value)})
            ruled = True
        elif name == "sitemap":
            sitemaps.append(value)
    return {"rules": rules, "delays": delays, "sitemaps": sitemaps}


def parsed(body: Column) -> Column:
    """parse_robots() in Arrow batches."""

    @F.pandas_udf(PARSED)
    def parse(body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_robots(b) for b in body], columns=["rules", "delays", "sitemaps"])

    return parse(body)


def state(status: Column) -> Column:
    """rules for 200, allow_all for other 4xx than 429, disallow_all for anything else or no answer."""
    return F.when(status == 200, "rules").when(status.between(400, 499) & (status != 429), "allow_all").otherwise("disallow_all")


def ttl(status: Column) -> Column:
    return F.when(state(status) == "disallow_all", F.lit(ERROR_TTL)).otherwise(F.lit(TTL))


def robots_table(files: DataFrame) -> DataFrame:
    """(origin, status, state, ttl, parsed[, fetched_at]) from files (origin, status, body[, fetched_at])."""
    return files.select(*[c for c in ("fetched_at",) if c in files.columns], "origin", "status", state(F.col("status")).alias("state"), ttl(F.col("status")).alias("ttl"), parsed(F.when(F.col("status") == 200, F.col("body")).otherwise("")).alias("parsed"))


def current(robots: DataFrame, now: Column) -> DataFrame:
    """Of each origin the file that was fetched last, if its time is not over; rows without a time of fetching hold for ever."""
    last = robots.groupBy("origin").agg(F.max_by(F.struct(*[c for c in robots.columns if c != "origin"]), F.coalesce("fetched_at", F.lit("9999-12-31").cast("timestamp"))).alias("r")).select("origin", "r.*")
    return last.where(F.col("fetched_at").isNull() | (F.unix_micros("fetched_at") + F.col("ttl") * 1_000_000 > F.unix_micros(now)))


def _group(rules: Column, agent: str) -> Column:
    """Number of the first group that names the agent, else of the first * group; null if there is neither."""
    token = agent.split("/")[0].lower()
    star = F.filter(rules, lambda g: F.array_contains(g["agents"], "*"))
    named = F.filter(rules, lambda g: ~F.array_contains(g["agents"], "*") & F.exists(g["agents"], lambda a: F.lit(token).contains(a)))
    least = lambda x: F.array_min(F.transform(x, lambda g: g["grp"]))
    return F.coalesce(least(named), least(star))


def path_of(url: Column) -> Column:
    """clean_path() of URLs. Plain paths, which are most, are native; only the others are handed to Python."""

    @F.pandas_udf("string")
    def cleaned(url: pd.Series) -> pd.Series:
        return url.map(clean_path, na_action="ignore")

    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    easy = F.when(rest == "", F.lit("/")).when(rest.rlike(PLAIN), rest)
    return F.coalesce(easy, cleaned(F.when(easy.isNull(), url)))


#: Rules of one agent as a tree of prefixes: in byte order, each with the longest one that it begins with (-1 for none), and what the
#: first rule says among those that it begins with, itself included. depth: steps from the deepest to the root.
TREE = "struct<prefix:array<string>,parent:array<int>,allow:array<boolean>,depth:int>"


def prefix_tree(rules: list[dict]) -> dict:
    """TREE of rules (ord, allow, prefix). An empty prefix and * are all paths' beginning."""
    first: dict[bytes, tuple[int, bool]] = {}
    for r in sorted(rules, key=lambda r: r["ord"]):
        if r["prefix"] != NOTHING:
            first.setdefault(b"" if r["prefix"] == "*" else r["prefix"].encode("utf-8", "surrogatepass"), (r["ord"], bool(r["allow"])))
    order = sorted(first)
    parent, best, depth, open_ = [], [], [], []
    for k, p in enumerate(order):
        while open_ and not p.startswith(order[open_[-1]]):
            open_.pop()
        up = open_[-1] if open_ else -1
        parent.append(up)
        best.append(min(first[p], best[up]) if up >= 0 else first[p])
        depth.append(depth[up] + 1 if up >= 0 else 1)
        open_.append(k)
    return {"prefix": [p.decode("utf-8", "surrogatepass") for p in order], "parent": parent, "allow": [ok for _, ok in best], "depth": max(depth, default=0)}


def tree_of(rules: Column, group: Column) -> Column:
    """prefix_tree() of a group's rules, in Arrow batches: a row for each origin."""

    @F.pandas_udf(TREE)
    def build(rules: pd.Series, group: pd.Series) -> pd.DataFrame:
        own = [[x for x in r if x["grp"] == g] if r is not None else [] for r, g in zip(rules, group)]
        return pd.DataFrame([prefix_tree(r) for r in own], columns=["prefix", "parent", "allow", "depth"])

    return build(rules, group)


def tree_allows(tree: Column, path: Column) -> Column:
    """What the first rule says whose prefix starts the path; true if there is none.

    The last prefix that is not behind the path is found by halving. What starts the path starts that prefix, too, so
    the longest such one is among its parents. That is as many steps as a path has folders, however many rules there are.
    """
    n = F.size(tree["prefix"])
    span = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        before = F.get(tree["prefix"], mid) <= path
        return F.when(s["lo"] >= s["hi"], s).when(before, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    last = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int")), span, halve)["lo"] - 1
    up = F.aggregate(F.sequence(F.lit(0), tree["depth"]), last, lambda k, _: F.when((k >= 0) & ~path.startswith(F.get(tree["prefix"], k)), F.get(tree["parent"], k)).otherwise(k))
    return F.coalesce(F.get(tree["allow"], F.when(up >= 0, up)), F.lit(True))


def can_fetch(pages: DataFrame, robots: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """pages with allowed: the first rule of the agent's group whose prefix starts the path, else true.

    Origins without a row are not allowed: their rules are unknown; nor are URLs that are null or malformed.
    robots has one row an origin, so the join keeps the rows of pages, null URLs and repeated ones among them.
    """
    rules = F.col("parsed.rules")
    own = robots.select(F.col("origin").alias("__origin"), F.col("state").alias("__state"), tree_of(rules, _group(rules, agent)).alias("__tree"))
    joined = pages.withColumn("__path", path_of(F.col(url))).join(own, urls.origin(F.col(url)) == F.col("__origin"), "left")
    ruled = F.col("__path").isNotNull() & tree_allows(F.col("__tree"), F.col("__path"))
    allowed = F.when(F.col("__state") == "allow_all", F.lit(True)).when(F.col("__state") == "rules", ruled).otherwise(F.lit(False))
    return joined.withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("__origin", "__state", "__tree", "__path")


class RobotsRules:
    """Table function: a row for each rule of a robots.txt, in order. register() names it for SQL."""

    @classmethod
    def register(cls, spark: SparkSession, name: str = "robots_rules") -> None:
        spark.udtf.register(name, udtf(cls, returnType="grp int, agent string, ord int, allow boolean, prefix string"))

    def eval(self, body: str) -> Iterator[tuple]:
        for r in parse_robots(body)["rules"]:
            for agent in r["agents"]:
                yield r["grp"], agent, r["ord"], r["allow"], r["prefix"]


def crawl_delay(parsed: Column, agent: str = "*") -> Column:
    """Seconds between requests that the agent's group asks for; 0 if it names none."""
    own = F.filter(parsed["delays"], lambda g: g["grp"] == _group(parsed["rules"], agent))
    return F.coalesce(F.get(F.transform(own, lambda g: g["delay"]), F.lit(0)), F.lit(0.0))


def describe(robots: DataFrame) -> DataFrame:
    return robots.select(F.concat("origin", F.lit("/robots.txt")).alias("url"), "status", "state", crawl_delay(F.col("parsed")).alias("crawl_delay"), F.col("parsed.sitemaps").alias("sitemaps"))

