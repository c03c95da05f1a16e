"""A forgiving HTML tree on the standard library's tokenizer, and the eight page fields taken from it.

Each field is taken on its own: one that fails has its default, and an entry in errors. Pages come in
Arrow batches, one parse a page for all fields.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from webweft.functions import html_tokens
from webweft.functions.batches import by_row
from webweft.functions.urls import SKIPPED

#: Elements without an end tag, and those whose start tag ends an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
#: An open element is not looked for beyond these.
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}

SCHEMA = (
    "url string, title string, text string, links array<string>, metadata struct<title:string,description:string,keywords:string>, "
    "images array<struct<src:string,alt:string>>, headings struct<h1:array<string>,h2:array<string>,h3:array<string>>, "
    "tables array<array<array<string>>>, lists array<struct<type:string,items:array<string>>>, errors array<string>"
)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def all(self, *tags: str) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            if n.tag in tags:
                yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def pieces(self, without: tuple[str, ...] = ()) -> Iterator[str]:
        stack: list = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if s := n.strip():
                    yield s
            elif n.tag not in without:
                stack += list(reversed(n.children))

    def text(self, between: str = "", without: tuple[str, ...] = ()) -> str:
        return between.join(self.pieces(without))


class _Builder(HTMLParser):
    """sign: what stands for & in the markup, where a name is no entity in texts; attributes have their own rule."""

    def __init__(self, sign: str = ""):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.sign = sign

    def _written(self, s: str) -> str:
        return s.replace(self.sign, "&") if self.sign else s

    def _leave(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Ends the outermost open element of these within scope: a new row ends the cell and the row that are open."""
        n, last = self.at, None
        while n.parent is not None and n.tag not in scope:
            if n.tag in tags:
                last = n
            n = n.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            scope = SCOPE.get(tag, ("td", "th", "li", "table"))
            self._leave(CLOSES[tag], scope)
        if attrs and "&" in (written := self._written(self.get_starttag_text() or "")):
            attrs = html_tokens.attributes(written)  # an entity without its end is none before =
        node = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
        if tag == "textarea":
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        # in a text area only entities are markup; newer tokenizers decode them themselves
        self.at.children.append(self._written(unescape(data) if self.cdata_elem == "textarea" and not getattr(self, "_escapable", False) else data))


def tree(html: str | None, ended: bool = False) -> Node:
    """ended: whether names in texts are entities by their semicolon alone, but for &amp."""
    html, sign = html or "", ""
    if ended and "&" in html:
        sign = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)  # one that the page does not have
        html = html_tokens.mark_unended(html, sign)
    b = _Builder(sign)
    b.feed(html)
    b.close()
    return b.root


def valid(url: str) -> bool:
    parts = urlsplit(url)
    return parts.scheme in ("http", "https") and bool(parts.netloc)


def metadata(root: Node, url: str) -> dict:
    out = {"title": next((t.text() for t in root.all("title")), ""), "description": "", "keywords": ""}
    for name in ("description", "keywords"):
        tag = next((m for m in root.all("meta") if m.attrs.get("name") == name), None)
        out[name] = tag.attrs.get("content", "").strip() if tag else ""
    return out


def links(root: Node, url: str, same_domain_only: bool = False) -> list[str]:
    out: dict[str, None] = {}
    for a in root.all("a"):
        href = a.attrs.get("href")
        if href is None or href.strip().startswith(SKIPPED):
            continue
        full = urldefrag(urljoin(url, href.strip()))[0]
        if valid(full) and (not same_domain_only or urlsplit(full).netloc == urlsplit(url).netloc):
            out.setdefault(full)
    return list(out)


def images(root: Node, url: str) -> list[dict]:
    found = ((urljoin(url, i.attrs["src"].strip()), i.attrs.get("alt", "").strip()) for i in root.all("img") if "src" in i.attrs)
    return [{"src": s, "alt": a} for s, a in found if valid(s)]


def headings(root: Node, url: str) -> dict:
    return {h: [x.text() for x in root.all(h)] for h in ("h1", "h2", "h3")}


def tables(root: Node, url: str) -> list[list[list[str]]]:
    out = []
    for t in root.all("table"):
        rows = [[c.text(" ") for c in tr.all("th", "td")] for tr in t.all("tr")]
        if any(rows):
            out.append([r for r in rows if r])
    return out


def lists(root: Node, url: str) -> list[dict]:
    found = ((x.tag, [c.text(" ") for c in x.children if isinstance(c, Node) and c.tag == "li"]) for x in root.all("ul", "ol"))
    return [{"type": t, "items": i} for t, i in found if i]


def _matches(node: Node, simple: str) -> bool:
    tag, _, cls = simple.partition(".")
    tag, _, ident = tag.partition("#")
    return (not tag or tag == "*" or node.tag == tag) and (not ident or node.attrs.get("id") == ident) and (not cls or cls in node.attrs.get("class", "").split())


def select(root: Node, selector: str) -> list[Node]:
    """Elements by a selector of names, #id, .class and descendants."""
    steps = selector.split()

    def below(n: Node, k: int) -> bool:
        if k < 0:
            return True
        p = n.parent
        while p is not None:
            if _matches(p, steps[k]) and below(p, k - 1):
                return True
            p = p.parent
        return False

    every = root.all(*{n.tag for n in _walk(root)})
    return [n for n in every if _matches(n, steps[-1]) and below(n, len(steps) - 2)]


def _walk(root: Node) -> Iterator[Node]:
    for c in root.children:
        if isinstance(c, Node):
            yield c
            yield from _walk(c)


def text(root: Node, url: str, selector: str | None = None) -> str:
    found = select(root, selector) if selector else [next(root.all("body"), root)]
    return " ".join(x for x in (n.text(" ", ("script", "style", "noscript")) for n in found) if x)


#: Field by field: how it is taken, and what it is if that fails.
FIELDS: dict[str, tuple[Callable, Callable]] = {
    "metadata": (metadata, lambda: {"title": "", "description": "", "keywords": ""}),
    "links": (links, list),
    "images": (images, list),
    "headings": (headings, lambda: {"h1": [], "h2": [], "h3": []}),
    "tables": (tables, list),
    "lists": (lists, list),
    "text": (text, str),
}


def parse_page(html: str | None, url: str, fields: dict | None = None, ended: bool = False) -> dict:
    """The page's fields; a field that raises has its default, and its name and error in errors.

    A page that the tokenizer itself can't read has every default, and one error. A null page is empty. ended: as for tree().
    """
    errors: list[str] = []
    fields = FIELDS if fields is None else fields
    out: dict = {"url": url}
    try:
        root = tree(html, ended)
    except Exception as e:
        out |= {name: default() for name, (_, default) in fields.items()}
        return out | {"title": "", "errors": [f"parse: {type(e).__name__}: {e}"]}
    for name, (take, default) in fields.items():
        try:
            out[name] = take(root, url)
        except Exception as e:
            out[name] = default()
            errors.append(f"{name}: {type(e).__name__}: {e}")
    return out | {"title": out["metadata"]["title"], "errors": errors}


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = (), ended: bool = False) -> DataFrame:
    """pages with the column page: all fields, by one parse. ended: as for tree()."""

    parse = by_row(lambda u, h: parse_page(h, u, ended=ended), to_arrow_type(StructType.fromDDL(SCHEMA)), f"struct<{_as_struct(SCHEMA)}>")
    # a filter on a field would be pushed below the parse, and every page be parsed twice
    parse = parse.asNondeterministic()
    return pages.select(*keep, url, parse(F.col(url), F.col(html)).alias("page"))


def _top_fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def _as_struct(schema: str) -> str:
    return ",".join(":".join(x.split(" ", 1)) for x in _top_fields(schema))


def page_summary(page: Column) -> list[Column]:
    """Lengths and counts of a parsed page."""
    return [F.length(page["text"]).alias("text_chars"), *(F.size(page[k]).alias(f"n_{k}") for k in ("links", "images", "tables", "lists")), F.size(page["headings"]["h1"]).alias("n_h1")]


class PageLinks:
    """Table function: a row for each link of a page, in order. register() names it for SQL."""

    @classmethod
    def register(cls, spark: SparkSession, name: str = "page_links") -> None:
        spark.udtf.register(name, udtf(cls, returnType="pos int, link string"))

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        yield from enumerate(parse_page(html, url)["links"])
