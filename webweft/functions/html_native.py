"""HTML fields by native regular expressions: for plain pages, all inside whole-stage plans.

Links of pages that are not plain, and entities beyond a few, go through the tokenizer (html_tokens.py), in Arrow batches.
html_tree.py parses whole pages, and knows images, tables and nested lists too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweft.functions import html_tokens, urls

#: The value of an anchor's href: quoted either way, or bare. Attributes before it and their values are stepped over, 64 at
#: most, as each is a call deep in Java's matcher; an anchor with more makes its page one for the tokenizer.
HREF = r"""(?is)<a(?:\s+[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?){0,64}?\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: An attribute with < or > in its quotes, or quotes that do not end; in scripts, too, where it says nothing.
QUOTED = r"""=\s*+(?:"[^"<>]*+(?:[<>]|\z)|'[^'<>]*+(?:[<>]|\z))"""
#: What HREF would misread: such attributes; tags that never end; comments, scripts, styles and text areas; declarations;
#: anchors with a slash or nothing before an attribute, with a bare or empty href, with a quote in a bare one, or with very many
#: attributes. It is found early in most pages that have any of these.
ODD = (
    rf"""(?i){QUOTED}|<(?:"""
    r"""[a-z][^<>]*+(?:<|\z)|!--|(?:script|style|textarea)\b|[!?](?!doctype)|/[^a-z]|a/"""
    r"""|a\s(?:[^<>]*["'/]href|(?:[^<>]*\s)?href(?:\s*=\s*>|(?=[\s>])(?!\s*=))|[^<>]*=\s*[^\s"'<>][^\s<>]*["']|(?:[^\s<>]*+\s++){64}))"""
)
#: Entities in text other than the few; and in references, where what goes on after a name is none.
OTHER = r"&(?!(?:copy|middot|quot|lt|gt);|amp)[#A-Za-z]"
FEW = r"&(?!(?:copy|middot|quot|lt|gt|nbsp|amp);|[A-Za-z0-9]*=)"
#: The same where a name is an entity by its semicolon alone.
OTHER_ENDED = r"&(?!(?:copy|middot|quot|lt|gt);|amp)(?:#|[A-Za-z][A-Za-z0-9]*+;)"
TAG = r"(?s)<!--.*?-->|<[^>]*>"


def unescape(text: Column) -> Column:
    """The entities that generated pages use; the ampersand last, so that nothing is decoded twice."""
    for entity, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.regexp_replace(text, "&amp;?", "&")


def pieces(html: Column) -> Column:
    """Texts between tags, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(html, TAG), lambda x: F.regexp_replace(unescape(x), r"^\s+|\s+$", "")), lambda x: x != "")


def without_code(html: Column) -> Column:
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, f"(?is)<{tag}\\b.*?</{tag}\\s*>", "")
    return html


def text(html: Column, ended: bool = False) -> Column:
    """The body's texts joined by one blank; scripts, styles and noscript left out.

    ended: whether names are entities by their semicolon alone, but for &amp. The standard has `&quot<` as a quote; text that was
    cut within an entity and then put into markup has it as what is left.
    """
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(</body\s*>|$)", 1)
    own = F.array_join(pieces(without_code(F.when(html.rlike("(?i)<body[ >]"), body).otherwise(html))), " ")
    odd = html.rlike(OTHER_ENDED if ended else OTHER) | html.rlike(QUOTED)
    return F.when(odd, html_tokens.text_of(F.when(odd, html), ended)).otherwise(own)


def title(html: Column) -> Column:
    """The title, its pieces joined without blanks."""
    return F.array_join(pieces(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)), "")


def meta(html: Column, name: str) -> Column:
    return F.trim(unescape(F.regexp_extract(html, f'(?is)<meta\\s[^>]*?name\\s*=\\s*"{name}"[^>]*?content\\s*=\\s*"([^"]*)"', 1)))


def inside(html: Column, tag: str, between: str) -> Column:
    """Text of each such element, its pieces joined by `between`."""
    return F.transform(F.regexp_extract_all(html, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>"), F.lit(1)), lambda x: F.array_join(pieces(x), between))


def plain(html: Column) -> Column:
    """Whether HREF finds just a page's anchors, as it does in simple markup without scripts. The tokenizer is about as fast,
    so nothing is taken out of a page first to make it plain."""
    return ~html.rlike(ODD)


def plain_hrefs(html: Column) -> Column:
    """A plain page's references, entities as they are written."""
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))


def hrefs(html: Column) -> Column:
    """References of a page's anchors, in order, decoded; of plain pages by the few entities alone."""
    return F.when(plain(html), F.transform(plain_hrefs(html), unescape_few)).otherwise(html_tokens.hrefs_of(F.when(~plain(html), html)))


def unescape_few(text: Column) -> Column:
    """The few entities, where they end as entities do; the ampersand last, so that nothing is decoded twice."""
    for entity, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def links(pages: DataFrame, key: str = "page_id", same_domain_only: bool = False) -> DataFrame:
    """(key, pos, link): distinct valid links of each page in order of their first place. Null pages have none.

    same_domain_only: those whose authority is the page's, as written.
    """
    odd = F.when(~plain(F.col("html")), F.col("html"))
    rows = pages.select(key, "url", "html", odd.alias("odd"))
    # most references are simple; what is not, and entities that the few do not cover, is left to the standard library
    simple = lambda h: urls.resolve_simple(F.col("url"), F.when(~h.rlike(FEW), unescape_few(h)))
    own = F.transform(F.when(F.col("odd").isNull(), plain_hrefs(F.col("html"))), lambda h: F.struct(h.alias("href"), simple(h).alias("simple")))
    rows = rows.select(key, "url", "odd", own.alias("own"))
    # one call of Python for a page, whatever it needs: each such step of a plan has a worker of its own in every task
    hard = F.when(F.exists("own", lambda r: r["simple"].isNull()), F.transform("own", lambda r: F.when(r["simple"].isNull(), r["href"])))
    rows = rows.select(key, "url", "odd", "own", hard.alias("hard"))
    asked = F.col("odd").isNotNull() | F.col("hard").isNotNull()
    rows = rows.select(key, "url", "odd", "own", html_tokens.page_links_of(F.when(asked, F.col("url")), F.col("odd"), F.col("hard")).alias("found"))
    ref = lambda href, simple, link: F.struct(href.alias("href"), simple.alias("simple"), link.alias("link"))
    none = F.lit(None).cast("string")
    read = F.transform("found", lambda f: ref(f["href"], none, f["link"]))
    known = F.zip_with("own", F.coalesce("found", F.array().cast("array<struct<href: string, link: string>>")), lambda r, f: ref(none, r["simple"], f["link"]))
    rows = rows.select(key, "url", F.posexplode(F.when(F.col("odd").isNotNull(), read).otherwise(known)).alias("pos", "ref"))
    link = F.coalesce("ref.simple", urls.resolve_simple(F.col("url"), F.col("ref.href")), "ref.link")
    # a filter within a generator: as a plain one it would be pushed down, and all be evaluated twice
    rows = rows.select(key, "url", "pos", F.explode(F.filter(F.array(link), urls.is_valid)).alias("link"))
    if same_domain_only:
        rows = rows.where(urls.netloc(F.col("link")) == urls.netloc(F.col("url")))
    return rows.groupBy(key, "link").agg(F.min("pos").alias("pos"))


def link_count_by_domain(pages: DataFrame) -> DataFrame:
    return links(pages).groupBy(urls.domain(F.col("link")).alias("domain")).agg(F.count("*").alias("links"))
