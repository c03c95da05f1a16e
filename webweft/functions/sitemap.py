"""Sitemap payloads: bounded gunzip, XML or plain text, to (kind, locations, error)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Bytes of a file, levels of an index, and URLs of a tree.
MOST_BYTES, MOST_DEPTH, MOST_URLS = 50 * 1024 * 1024, 5, 100_000
PARSED = "struct<kind:string,locs:array<string>,error:string>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def clean(locs: list[str], base: str) -> list[str]:
    out = []
    for loc in (x.strip() for x in locs):
        if loc and not loc.startswith("#"):
            full = urljoin(base, loc)
            parts = urlsplit(full)
            if parts.scheme in ("http", "https") and parts.netloc:
                out.append(full)
    return out


def unpack(data: bytes, most: int = MOST_BYTES) -> bytes:
    if data[:2] == b"\x1f\x8b":
        try:
            data = zlib.decompressobj(wbits=31).decompress(data, most + 1)
        except zlib.error as e:
            raise ValueError(f"gzip: {e}") from e
    if len(data) > most:
        raise ValueError("file too large")
    return data


def parse_sitemap(data: bytes | None, url: str) -> dict:
    """kind urls or index with absolute locations, or an error. Document types and entities are refused."""
    try:
        if data is None:
            raise ValueError("no answer")
        data = unpack(bytes(data))
        head = data[:4096].lower()
        if not head.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"<"):
            return {"kind": "urls", "locs": clean(data.decode("utf-8-sig", "replace").splitlines(), url), "error": None}
        if b"<!doctype" in head or b"<!entity" in head:
            raise ValueError("document types and entities are not read")
        try:
            root = ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise ValueError(f"XML: {e}") from e
        item = {"urlset": "url", "sitemapindex": "sitemap"}.get(_local(root.tag))
        if item is None:
            raise ValueError(f"no sitemap: <{_local(root.tag)}>")
        locs = [c.text for e in root if _local(e.tag) == item for c in e if _local(c.tag) == "loc" and c.text]
        return {"kind": "index" if item == "sitemap" else "urls", "locs": clean(locs, url), "error": None}
    except ValueError as e:
        return {"kind": None, "locs": [], "error": str(e)}


def parsed(data: Column, url: Column) -> Column:
    """parse_sitemap() in Arrow batches."""

    @F.pandas_udf(PARSED)
    def parse(data: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_sitemap(d, u) for d, u in zip(data, url)], columns=["kind", "locs", "error"])

    return parse(data, url)


class SitemapLocations:
    """Table function: a row for each location, or one with the error. register() names it for SQL."""

    @classmethod
    def register(cls, spark: SparkSession, name: str = "sitemap_locations") -> None:
        spark.udtf.register(name, udtf(cls, returnType="kind string, pos int, loc string, error string"))

    def eval(self, data: bytes, url: str) -> Iterator[tuple]:
        got = parse_sitemap(data, url)
        if got["error"]:
            yield None, None, None, got["error"]
        for i, loc in enumerate(got["locs"]):
            yield got["kind"], i, loc, None
