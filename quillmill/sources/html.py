"""Pages parsed in Arrow batches: blocks, links and a few facts of each page, as columns.

The tree comes from the standard library's parser. Void elements hold nothing, a new paragraph, list item, row
or cell closes the open one of its kind, and an end tag without its start is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.slices import sliced

# fixed values: what is noise in a page
NOISE_TAGS = frozenset(("script", "style", "noscript", "form", "button", "input", "select", "textarea", "iframe", "svg", "canvas", "nav", "header", "footer"))
NOISE_CLASSES = frozenset(("screenreader-only", "sr-only"))
# fixed values: elements whose blocks stand by themselves
BLOCK_TAGS = frozenset(("article", "aside", "blockquote", "div", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "main", "ol", "p", "pre", "section", "table", "ul"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset(("ul", "ol", "table", "div", "section", "article", "body"))
_WS = re.compile(r"[\s﻿]+")
_BLOCKS = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("list_type", pa.string()), ("text", pa.string())]))
_LINKS = pa.list_(pa.struct([(c, pa.string()) for c in ("href", "url", "label", "rel")]))
BLOCKS = "array<struct<type:string,level:int,list_type:string,text:string>>"
LINKS = "array<struct<href:string,url:string,label:string,rel:string>>"


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.children))

    def is_noise(self) -> bool:
        return self.tag in NOISE_TAGS or bool(NOISE_CLASSES & set(self.attrs.get("class", "").split())) or self.attrs.get("aria-hidden") == "true"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in _CLOSES.get(tag, ()):
                del self.open[i:]
                break
            if self.open[i].tag in _SCOPES or (tag == "p" and self.open[i].tag in BLOCK_TAGS):
                break
        if tag == "body" or tag == "html":
            return
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _one_line(s: str) -> str:
    return _WS.sub(" ", s).strip()


def _prune(node: Node) -> None:
    for n in list(node.walk()):
        n.children = [c for c in n.children if not (isinstance(c, Node) and (c.is_noise() or c.tag in ("head", "title")))]


def _append(node: Node | str, out: list[dict]) -> None:
    line = _one_line(node if isinstance(node, str) else node.text())
    if not line:
        return
    block = lambda kind, text, level=None, list_type=None: out.append({"type": kind, "level": level, "list_type": list_type, "text": text})
    if isinstance(node, str):
        block("paragraph", line)
    elif re.fullmatch("h[1-6]", node.tag):
        block("heading", line, int(node.tag[1]))
    elif node.tag in ("p", "blockquote", "pre"):
        block({"p": "paragraph", "blockquote": "quote", "pre": "code"}[node.tag], line)
    elif node.tag in ("ul", "ol"):
        for c in node.children:
            if isinstance(c, Node) and c.tag == "li" and (t := _one_line(c.text())):
                block("list_item", t, None, "numbered" if node.tag == "ol" else "bulleted")
    elif node.tag == "table":
        for row in node.walk():
            if row.tag == "tr" and (cells := [t for c in row.walk() if c.tag in ("th", "td") and (t := _one_line(c.text()))]):
                block("paragraph", " | ".join(cells))
    elif inner := [c for c in node.children if isinstance(c, Node) and c.tag in BLOCK_TAGS]:
        for c in inner:
            _append(c, out)
    else:
        block("paragraph", line)


def page_blocks(html: str | None, title: str = "") -> list[dict]:
    if not html or not html.strip():
        return []
    root, out = tree(html), []
    _prune(root)
    for c in root.children:
        _append(c, out)
    if title and not any(b["type"] == "heading" for b in out):
        out.insert(0, {"type": "heading", "level": 1, "list_type": None, "text": _one_line(title)})
    return out


def page_text(html: str) -> str:
    """All text of a page but its noise."""
    root = tree(html)
    _prune(root)
    return root.text()


def page_links(html: str | None, url: str | None) -> list[dict]:
    out = []
    for n in tree(html or "").walk():
        if n.tag == "a" and (href := n.attrs.get("href", "").strip()):
            try:
                absolute = urljoin(url or "", href)
            except ValueError:
                absolute = None
            out.append({"href": href, "url": absolute, "label": _one_line(n.text()), "rel": n.attrs.get("rel", "")})
    return out


def blocks(html: Column) -> Column:
    @F.arrow_udf(BLOCKS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(((b,) for b in batches), lambda pages: pa.array([page_blocks(h) for h in pages.to_pylist()], _BLOCKS))

    return run(html)


def links(html: Column, url: Column) -> Column:
    @F.arrow_udf(LINKS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return sliced(batches, lambda pages, urls: pa.array([page_links(h, u) for h, u in zip(pages.to_pylist(), urls.to_pylist())], _LINKS))

    return run(html, url)


def _title(html: str | None) -> str:
    root = tree(html or "")
    for want in ("h1", "title"):
        for n in root.walk():
            if n.tag == want and (t := _one_line(n.text())):
                return re.sub(r"\s*\|\s*[^|]*$", "", t) if want == "title" else t
    return ""


def title(html: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(((b,) for b in batches), lambda pages: pa.array([_title(h) for h in pages.to_pylist()], pa.string()))

    return run(html)


def whole_references(html: Column) -> Column:
    """Pages in which only character references that end with a semicolon count, as the queries' SQL has it. The parser by itself also reads some that
    were cut off before it ("&amp"), as browsers do."""
    return F.regexp_replace(html, "&(?![A-Za-z][A-Za-z0-9]*;|#[0-9]+;|#[xX][0-9A-Fa-f]+;)", "&amp;")


def page_rows(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pages (page_id, url, html): block rows (page_id, ord, type, level, list_type, text) and link rows (page_id, ord,
    href, url, label, rel)."""
    b = pages.select("page_id", F.posexplode(blocks(F.col("html"))).alias("ord", "b")).select("page_id", "ord", "b.*")
    k = pages.select("page_id", F.posexplode(links(F.col("html"), F.col("url"))).alias("ord", "l")).select("page_id", "ord", "l.*")
    return b, k
