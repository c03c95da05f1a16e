"""URL functions on columns. All are native expressions; resolve_any() is the standard library's twin of resolve()."""

from __future__ import annotations

import re
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query with its mark, fragment with its mark. Spark and DuckDB both take it.
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
SKIPPED = ("#", "mailto:", "javascript:", "tel:")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def netloc(url: Column) -> Column:
    """Authority as written."""
    return _part(url, 2)


def domain(url: Column) -> Column:
    """Authority in lower case, www kept: the key of limits, breakers and the store."""
    return F.lower(netloc(url))


def origin(url: Column) -> Column:
    """scheme://authority in lower case: the key of robots.txt."""
    return F.lower(F.concat(_part(url, 1), F.lit("://"), _part(url, 2)))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and authority, / for an empty path, the query as it is, no fragment. Relative URLs lose their fragment only."""
    path = _part(url, 3)
    query = F.when(_part(url, 4) == "?", F.lit("")).otherwise(_part(url, 4))
    whole = F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), F.when(path == "", F.lit("/")).otherwise(path), query)
    return F.when(url.rlike(PARTS), whole).otherwise(F.regexp_replace(url, "#.*$", ""))


def normalize_domain(url: Column) -> Column:
    """Lower-case authority without one leading www.; a bare domain is taken as one. The port stays."""
    rest = F.when(url.contains("//"), F.regexp_extract(url, r"^[^/?#]*//([^/?#]*)", 1)).otherwise(F.regexp_extract(url, r"^([^/?#]*)", 1))
    return F.regexp_replace(F.lower(rest), r"^www\.", "")


def is_valid(url: Column) -> Column:
    """http or https with an authority."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def url_filter(url: Column, allowed_domains: list[str] | None = None, exclude: list[str] | None = None, include: list[str] | None = None) -> Column:
    """Whether a URL may be visited: valid, of an allowed domain (www or not), no exclude pattern found in it and,
    if there are include patterns, one of them found. Exclusion wins."""
    ok = is_valid(url)
    if allowed_domains is not None and len(allowed_domains):
        own = {re.sub(r"^www\.", "", urlsplit(d if "//" in d else f"//{d}").netloc.lower()) for d in allowed_domains}
        ok &= normalize_domain(url).isin(sorted(own))
    for p in exclude or ():
        ok &= ~url.rlike(p)
    if include:
        some = F.lit(False)
        for p in include:
            some |= url.rlike(p)
        ok &= some
    return F.coalesce(ok, F.lit(False))


def skipped_href(href: Column) -> Column:
    """References that lead to no page; the case of their prefix counts."""
    out = F.lit(False)
    for p in SKIPPED:
        out |= F.trim(href).startswith(p)
    return out


def _stripped(href: Column) -> Column:
    """A reference without white space and control signs around it, line breaks and tabs in it, and its fragment."""
    h = F.regexp_replace(href, r"^[\s\x00-\x20]+|[\s\x00-\x20]+$|[\t\r\n]", "")
    return F.regexp_replace(h, r"(?s)#.*$", "")


def _without_dots(segments: Column) -> Column:
    """A path of segments, . and .. resolved; it starts with /."""
    none = F.array().cast("array<string>")
    left = F.aggregate(segments, none, lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.array_append(kept, s)))
    last = F.element_at(segments, -1)
    path = F.concat(F.array_join(left, "/"), F.when(last.isin(".", "..") & (F.size(left) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _let(body, **values: Column) -> Column:
    """body of a struct of values, each of which is evaluated once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of any form of reference, without its fragment (RFC 3986, as the standard library joins).

    base is an absolute URL of a site. A reference to another scheme without // stays as it is; null where either is null.
    """
    no_query = lambda x: F.regexp_replace(x, r"\?$", "")

    def split(s: Column) -> Column:
        own = F.lower(F.regexp_extract(s["h"], r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        return _let(relative, own=own, after=F.substring(s["h"], F.length(own) + 2, F.length(s["h"])), **{k: s[k] for k in ("h", "scheme", "root", "folder", "base", "empty")})

    def relative(s: Column) -> Column:
        # a reference that names the base's scheme and no authority is a relative one
        named = s["after"].rlike("^//[^/?]")
        rest = F.when((s["own"] == s["scheme"]) & ~named, s["after"]).otherwise(s["h"])
        absolute = (s["own"] != "") & ((s["own"] != s["scheme"]) | named)
        return _let(bare, rest=rest, absolute=absolute, **{k: s[k] for k in ("own", "after", "h", "scheme", "root", "folder", "base", "empty")})

    def bare(s: Column) -> Column:
        other = s["rest"].rlike("^//[^/?]")
        # an authority that is empty is none, nor is a query
        rest = F.when(other, s["rest"]).otherwise(F.regexp_replace(F.regexp_replace(s["rest"], r"^//(?=[/?]|$)", ""), r"^\?$", ""))
        return _let(parted, other=other, rest=rest, **{k: s[k] for k in ("absolute", "own", "after", "h", "scheme", "root", "folder", "base", "empty")})

    def parted(s: Column) -> Column:
        path, query = F.regexp_extract(s["rest"], r"(?s)^([^?]*)", 1), F.regexp_extract(s["rest"], r"(?s)^[^?]*(\?.+)$", 1)
        return _let(joined, path=path, query=query, **{k: s[k] for k in ("other", "rest", "absolute", "own", "after", "h", "scheme", "root", "folder", "base", "empty")})

    def joined(s: Column) -> Column:
        parent = F.split(F.when(s["folder"] == "", F.lit("/")).otherwise(s["folder"]), "/")
        steps = F.concat(F.slice(parent, 1, F.greatest(F.size(parent) - 1, F.lit(1))), F.split(s["path"], "/"))
        # empty steps within a joined path are dropped, at its ends they stay
        steps = F.concat(F.slice(steps, 1, 1), F.filter(F.slice(steps, 2, F.greatest(F.size(steps) - 2, F.lit(0))), lambda x: x != ""), F.slice(steps, -1, 1))
        page = F.regexp_replace(F.substring(s["base"], F.length(s["root"]) + 1, F.length(s["base"])), r"(?s)#.*$", "")
        return (
            F.when(s["absolute"], F.when(s["own"] == s["scheme"], no_query(F.concat(s["own"], F.lit(":"), s["after"]))).otherwise(s["h"]))
            .when(s["empty"] & ~s["base"].contains("#"), s["base"])
            .when(s["rest"] == "", no_query(F.concat(s["root"], page)))
            .when(s["other"], F.concat(s["scheme"], F.lit(":"), no_query(s["rest"])))
            .when(s["path"] == "", F.concat(s["root"], s["folder"], s["query"]))
            .when(s["path"].startswith("/"), F.concat(s["root"], _without_dots(F.split(s["path"], "/")), s["query"]))
            .otherwise(F.concat(s["root"], _without_dots(steps), s["query"]))
        )

    empty = F.regexp_replace(href, r"\s", "").eqNullSafe("")
    whole = _let(split, h=_stripped(href), scheme=F.lower(_part(base, 1)), root=F.concat(F.lower(_part(base, 1)), F.lit("://"), _part(base, 2)), folder=_part(base, 3), base=base, empty=empty)
    return F.when(base.isNotNull() & href.isNotNull(), whole)


#: An absolute URL and a path from the root that nothing need be done to: no fragment, dots, white space or odd sign.
SIMPLE_URL = r"^https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[!-~&&[^?#;\\]]*)?(?:\?[!-~&&[^#]]+)?$"
SIMPLE_PATH = r"^/(?!/)(?!.*/\.{1,2}(?:/|\?|$))(?!.*//)[!-~&&[^?#;\\]]*(?:\?[!-~&&[^#]]+)?$"


def resolve_simple(base: Column, href: Column) -> Column:
    """resolve() of the most usual references, by two patterns; null for all others."""
    root = F.regexp_extract(base, r"^(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)(?:[/?#]|$)", 1)
    return F.when(base.isNotNull() & href.rlike(SIMPLE_URL), href).when(href.rlike(SIMPLE_PATH) & (root != ""), F.concat(root, href))


def join_url(base: str | None, href: str | None) -> str | None:
    try:
        return urldefrag(urljoin(base, href.strip()))[0]
    except (ValueError, AttributeError, TypeError):
        return None


def resolve_any(base: Column, href: Column) -> Column:
    """resolve() by the standard library, in Arrow batches; null where the reference is malformed."""

    @F.pandas_udf("string")
    def join(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([join_url(b, h) for b, h in zip(base, href)], dtype=object)

    return join(base, href)


def unwrap_link(link: Column) -> Column:
    """The URL of a link given as a struct with url or href."""
    return F.coalesce(link["url"], link["href"])


def format_of_path(path: str) -> str:
    """Storage format by file name: csv, sqlite or json."""
    p = path.lower()
    return "csv" if p.endswith(".csv") else "sqlite" if p.endswith((".db", ".sqlite", ".sqlite3")) else "json"


def user_agent(agents: list[str], turn: Column) -> Column:
    """The agent whose turn it is, round robin; turn counts from 0."""
    if isinstance(agents, str):
        agents = [agents]
    if not agents or not all(isinstance(a, str) and a.strip() for a in agents):
        raise ValueError("agents must be a list of non-empty strings")
    return F.element_at(F.array(*map(F.lit, agents)), F.pmod(turn, F.lit(len(agents))).cast("int") + 1)
