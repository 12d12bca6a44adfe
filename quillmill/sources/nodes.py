"""Pages as a table of nodes, and structural joins over it.

The parser numbers a page's nodes in document order. A node spans [start, end], the numbers of itself and all that is below it, so
"below", "above", "closest" and "the text of" are joins on the page with a containment of intervals, and Spark does them.
The parser alone is Python; it makes rows and decides nothing.

Texts are nodes with the tag #text. An element also has the attributes "#url" (its href, absolute) and "#last" (it is the
last element of its parent). Null pages have no nodes but the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.slices import sliced
from quillmill.functions.text import collapse, filled
from quillmill.sources.html import Node, tree

NODES = "array<struct<start:int,end:int,parent:int,tag:string,attrs:map<string,string>,text:string>>"
_NODES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))
_PART = re.compile(r"""^[\w-]+|\#[\w-]+|\.[\w-]+|\[[\w-]+(?:\*?='[^']*')?\]|:last-child""")


def _numbered(html: str | None, url: str | None) -> list[dict]:
    out: list[dict] = []
    todo: list[tuple[Node | str | None, int, bool]] = [(tree(html or ""), -1, False)]
    while todo:
        n, parent, last = todo.pop()
        if n is None:  # all below the node `parent` is numbered
            out[parent]["end"] = len(out) - 1
            continue
        at = len(out)
        if isinstance(n, str):
            out.append({"start": at, "end": at, "parent": parent, "tag": "#text", "attrs": {}, "text": n})
            continue
        attrs = dict(n.attrs) | ({"#last": ""} if last else {})
        if href := n.attrs.get("href", "").strip():
            try:
                attrs["#url"] = urljoin(url or "", href)
            except ValueError:
                pass
        out.append({"start": at, "end": at, "parent": parent, "tag": n.tag, "attrs": attrs, "text": None})
        todo.append((None, at, False))
        final = next((c for c in reversed(n.children) if isinstance(c, Node)), None)
        todo.extend((c, at, c is final) for c in reversed(n.children))
    return out


def node_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """Of pages (page_id, url, html): a row per node: page_id, start, end, parent, tag, attrs, text, and the columns in `keep`."""

    def work(html: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([_numbered(h, u) for h, u in zip(html.to_pylist(), url.to_pylist())], _NODES)

    @F.arrow_udf(NODES)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return sliced(batches, work)

    return pages.select("page_id", *keep, F.explode(run(F.col("html"), F.col("url"))).alias("n")).select("page_id", *keep, "n.*")


def classes() -> Column:
    return F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+")


def is_a(compound: str) -> Column:
    """Whether a node matches a selector without blanks: tag, #id, .class, [attribute], [attribute='value'], [attribute*='part'], :last-child."""
    hit = F.col("tag") != "#text"
    for part in _PART.findall(compound):
        name = part[1:]
        if part[0] == "#":
            hit &= F.col("attrs")["id"] == name
        elif part[0] == ".":
            hit &= F.array_contains(classes(), name)
        elif part[0] == "[":
            key, within, value = re.fullmatch(r"([\w-]+)(\*?)(?:='(.*)')?", name[:-1]).groups()
            have = F.col("attrs")[key]
            hit &= have.isNotNull() if value is None else have.contains(value) if within else have == value
        elif part == ":last-child":
            hit &= F.col("attrs")["#last"].isNotNull()
        else:
            hit &= F.col("tag") == part
    return F.coalesce(hit, F.lit(False))


def below(inner: DataFrame, outer: DataFrame, how: str = "inner", self_too: bool = False) -> DataFrame:
    """Rows of `inner` (page_id, start, end, ...) joined with the rows of `outer` (page_id, o_start, o_end, ...) that lie above them."""
    first = F.col("o_start") <= F.col("start") if self_too else F.col("o_start") < F.col("start")
    o = outer.withColumnRenamed("page_id", "o_page")
    return inner.join(o, (F.col("page_id") == F.col("o_page")) & first & (F.col("start") <= F.col("o_end")), how).drop("o_page")


def as_outer(nodes: DataFrame, *keep: str) -> DataFrame:
    return nodes.select("page_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"), *keep)


def hits(nodes: DataFrame, uses: dict[str, tuple[str, ...]]) -> DataFrame:
    """Nodes that selectors find: (use, pref, page_id, start, end, attrs); pref counts a use's selectors. A selector is one compound or two,
    an outer one first."""
    table = [(use, pref, *s.split()[::-1], *([None] if len(s.split()) == 1 else [])) for use, selectors in uses.items() for pref, s in enumerate(selectors)]
    compounds = sorted({c for row in table for c in row[2:] if c})
    of = F.filter(F.array(*[F.when(is_a(c), F.lit(c)) for c in compounds]), lambda c: c.isNotNull())
    marked = nodes.where("tag <> '#text'").select("page_id", "start", "end", "attrs", F.explode(of).alias("compound"))
    wanted = F.broadcast(nodes.sparkSession.createDataFrame(table, "use string, pref int, own string, outer_ string"))  # one row per selector
    own = marked.join(wanted, F.col("compound") == F.col("own")).drop("compound", "own")
    outer = marked.select("page_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("compound").alias("o_is"))
    nested = below(own.where("outer_ is not null"), outer).where("o_is = outer_").select("use", "pref", "page_id", "start", "end", "attrs").dropDuplicates(["use", "pref", "page_id", "start"])
    return own.where("outer_ is null").select("use", "pref", "page_id", "start", "end", "attrs").unionByName(nested)


def texts_of(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """`spans` (page_id, start, end, ...) with `text`: all text below, in order, on one line."""
    t = nodes.where("tag = '#text'").select("page_id", "start", "end", F.col("text").alias("t"))
    own = spans.select("page_id", F.col("start").alias("o_start"), F.col("end").alias("o_end")).distinct()
    whole = below(t, own).groupBy("page_id", "o_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "t"))), lambda x: x["t"]), "").alias("text"))
    return spans.join(whole.withColumnRenamed("o_start", "start"), ["page_id", "start"], "left").withColumn("text", collapse(F.col("text")))


def first_texts(nodes: DataFrame, found: DataFrame, by: list[str], attrs: tuple[str, ...] = ("data-course-name",)) -> DataFrame:
    """Per group of found nodes (columns `by`, pref, page_id, start, end, attrs) the text of the first selector that has one: of each
    selector only the first node counts, and its attributes stand in for a missing text."""
    nth = F.row_number().over(Window.partitionBy(*by, "pref").orderBy("start"))
    first = texts_of(nodes, found.withColumn("__n", nth).where("__n = 1").drop("__n"))
    said = F.coalesce(F.nullif("text", F.lit("")), *[F.nullif(F.col("attrs")[a], F.lit("")) for a in attrs])
    return first.withColumn("text", said).where(filled(F.col("text"))).groupBy(*by).agg(F.min_by("text", "pref").alias("text"))


def closest(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """`inner` (page_id, start, end, ...) with the span (o_start, o_end) of the nearest node of `outer` at or above each, null if there is none."""
    at = below(inner.select("page_id", "start", "end"), as_outer(outer).distinct(), self_too=True).groupBy("page_id", "start").agg(F.max(F.struct("o_start", "o_end")).alias("o"))
    return inner.join(at, ["page_id", "start"], "left").withColumns({"o_start": F.col("o.o_start"), "o_end": F.col("o.o_end")}).drop("o")
