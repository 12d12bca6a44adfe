"""Pages as rich-text blocks: each block has runs of text with their marks and link.

Marks come from the inline elements around a text. A page's tree is parsed once, in Arrow batches; the limits of
the sink (length of a run, blocks a body) are applied here, as they decide what a block is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.slices import sliced
from quillmill.functions.text import SPACES
from quillmill.sources.html import BLOCK_TAGS, Node, tree

# fixed values: the sink's limits, the marks of inline elements, the kinds of block elements
PIECE, BLOCKS = 1900, 1000
MARKS = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "u": "underline", "s": "strikethrough", "strike": "strikethrough", "code": "code"}
KINDS = {"h1": "heading_1", "h2": "heading_2", "h3": "heading_3", "p": "paragraph", "blockquote": "quote"}

_RUN = pa.struct([("text", pa.string()), ("href", pa.string()), *((m, pa.bool_()) for m in ("bold", "italic", "strikethrough", "underline", "code"))])
_BLOCKS = pa.list_(pa.struct([("type", pa.string()), ("runs", pa.list_(_RUN))]))
SCHEMA = "array<struct<type:string,runs:array<struct<text:string,href:string,bold:boolean,italic:boolean,strikethrough:boolean,underline:boolean,code:boolean>>>>"
_WS = re.compile(f"[{re.escape(SPACES)}]+")


def _runs(text: str, marks: frozenset[str], href: str | None) -> list[dict]:
    """A text in runs that fit the sink, cut at the last space of the second half."""
    out, rest = [], text
    while rest:
        at = len(rest)
        if at > PIECE:
            at = rest.rfind(" ", 0, PIECE + 1)
            at = at if at >= PIECE // 2 else PIECE
        out.append({"text": rest[:at], "href": href or None, **{m: m in marks for m in ("bold", "italic", "strikethrough", "underline", "code")}})
        rest = rest[at:].lstrip(SPACES)
    return out


def inline(node: Node) -> list[dict]:
    """The runs of all text below a node, outer marks and links handed down."""
    out: list[dict] = []
    todo: list[tuple[Node | str, frozenset[str], str | None]] = [(node, frozenset(), None)]
    while todo:
        n, marks, href = todo.pop()
        if isinstance(n, str):
            if n.strip(SPACES):
                out += _runs(_WS.sub(" ", n), marks, href)
            continue
        marks = marks | {MARKS[n.tag]} if n.tag in MARKS else marks
        href = (n.attrs.get("href") or href) if n.tag == "a" else href
        if n.tag == "br":
            out += _runs("\n", marks, href)
        elif n.tag == "img":
            alt = n.attrs.get("alt", "").strip(SPACES)
            out += _runs(f"[Image: {alt}]", marks, href) if alt else []
        else:
            todo += [(c, marks, href) for c in reversed(n.children)]
    return out


def _line(node: Node) -> str:
    return _WS.sub(" ", node.text()).strip(SPACES)


def paragraphs(text: str) -> list[dict]:
    parts = (p.strip(SPACES) for p in re.split(r"\n{2,}", text))
    return [{"type": "paragraph", "runs": _runs(p, frozenset(), None)} for p in parts if p]


def _blocks(node: Node | str) -> list[dict]:
    if isinstance(node, str):
        return paragraphs(node.strip(SPACES))
    if node.tag in KINDS:
        own = [(KINDS[node.tag], inline(node))]
    elif node.tag == "pre":
        own = [("code", _runs(_line(node), frozenset({"code"}), None))]
    elif node.tag == "hr":
        return [{"type": "divider", "runs": []}]
    elif node.tag in ("ul", "ol"):
        kind = "bulleted_list_item" if node.tag == "ul" else "numbered_list_item"
        own = [(kind, inline(c)) for c in node.children if isinstance(c, Node) and c.tag == "li"]
    elif node.tag == "table":
        rows = [" | ".join(t for c in r.walk() if c.tag in ("th", "td") and (t := _line(c))) for r in node.walk() if r.tag == "tr"]
        return [b for r in rows for b in paragraphs(r)]
    elif inner := [c for c in node.children if isinstance(c, Node) and c.tag in BLOCK_TAGS - {"figure", "main"}]:
        return [b for c in inner for b in _blocks(c)]
    else:
        return paragraphs(_line(node))
    return [{"type": kind, "runs": runs} for kind, runs in own if runs]


def page(html: str | None, fallback: str | None) -> list[dict]:
    """A page's blocks, at most as many as a body takes; those of the fallback text if it has none."""
    found = [b for c in tree(html).children if not (isinstance(c, Node) and c.tag in ("head", "title")) for b in _blocks(c)] if html and html.strip(SPACES) else []
    return found[:BLOCKS] or paragraphs(fallback or "")


def rich_blocks(html: Column, fallback: Column) -> Column:
    def work(pages: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([page(h, t) for h, t in zip(pages.to_pylist(), texts.to_pylist())], _BLOCKS)

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return sliced(batches, work)

    return run(html, fallback)
