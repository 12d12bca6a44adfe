"""Chunks with overlap, and heading trails.

A document's blocks are an ordered array, so its chunks follow row by row; nothing is shuffled. Packing with overlap is a
fold whose state is the open chunk; it runs over Arrow batches, one document at a time.
Lengths are in characters, which are UTF-16 units for texts of the basic plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.slices import sliced
from quillmill.functions.text import SPACES, collapse, filled, let, plain_text, stable_hash, text

SIZE, OVERLAP, LEAST = 2200, 250, 600
VERSION = "phase4-v1"
_CHUNKS = pa.list_(pa.struct([("chunk_text", pa.string()), ("heading_context", pa.string())]))


def split_long(c: Column, size: int) -> Column:
    """Pieces of at most `size` characters, cut at the last space unless that lies in the first half."""
    most = F.ceil(F.length(c) / (size // 2)).cast("int")
    start = F.struct(F.array().cast("array<string>").alias("out"), text(c).alias("rest"))

    def step(x: Column, _: Column) -> Column:
        rest = x["rest"]

        def place(head: Column) -> Column:
            at = F.length(head) - F.instr(F.reverse(head), " ")  # 0-based, of the last space; the length if none
            return F.when((F.instr(head, " ") == 0) | (at < size // 2), size).otherwise(at)

        cut_off = let(let(rest.substr(F.lit(1), F.lit(size + 1)), place), lambda cut: F.struct(F.concat(x["out"], F.array(text(rest.substr(F.lit(1), cut)))).alias("out"), text(rest.substr(cut + 1, F.length(rest))).alias("rest")))
        return F.when(F.length(rest) > size, cut_off).otherwise(x)

    done = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), start, step, lambda x: F.concat(x["out"], F.array(x["rest"])))
    return F.filter(done, lambda p: p != "")


def _split(text_: str, size: int) -> list[str]:
    """split_long() of one text."""
    all_, out, at = text_.strip(SPACES), [], 0
    while len(all_) - at > size:
        cut = all_.rfind(" ", at, at + size + 1) - at
        cut = cut if cut >= size // 2 else size
        out.append(all_[at : at + cut].strip(SPACES))
        at += cut
        while all_[at] in SPACES:  # the text ends with something else
            at += 1
    return [p for p in (*out, all_[at:]) if p]


def _units(blocks: list[dict], size: int) -> list[tuple[str, str]]:
    """(text, heading) of blocks: headings only set the trail of what follows."""
    out, trail = [], [""] * 6
    for b in blocks:
        own = (b["text"] or "").strip(SPACES)
        if own and b["type"] == "heading":
            level = max(1, min(6, b["level"] or 1))
            trail = [*trail[: level - 1], own, *[""] * (6 - level)]
        elif own:
            heading = " > ".join(t for t in trail if t)
            out += [(p, heading) for p in _split(own, size)]
    return out


def _pack(units: list[tuple[str, str]], size: int, overlap: int) -> list[list[tuple[str, str]]]:
    """A unit that does not fit starts the next chunk, after the whole units that make up the last `overlap` characters of
    the chunk before it. Two units are two characters apart."""
    out, now, length = [], [], 0
    for u in units:
        if now and length + 2 + len(u[0]) > size:
            out.append(now)
            tail, n = [], 0
            while len(tail) < len(now) and n < overlap:
                tail.insert(0, now[-1 - len(tail)])
                n += len(tail[0][0]) + (2 if len(tail) > 1 else 0)
            now, length = tail, n
        length += len(u[0]) + (2 if now else 0)
        now = [*now, u]
    return [*out, now] if now else out


def chunk_array(blocks: Column, fallback: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """A document's chunks in order, (chunk_text, heading_context) each, from its blocks (type, level, text). Documents without
    any block but headings are cut from their `fallback` text."""
    size = max(LEAST, size or SIZE)
    overlap = max(0, min(size // 2, overlap or OVERLAP))

    def work(own: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for b, t in zip(own.to_pylist(), texts.to_pylist()):
            packed = _pack(_units(b or [], size) or [(p, "") for p in _split(t or "", size)], size, overlap)
            out.append([("\n\n".join(x for x, _ in c), next((h for _, h in c if h), "")) for c in packed])
        return pa.array([[{"chunk_text": x, "heading_context": h} for x, h in c] for c in out], _CHUNKS)

    @F.arrow_udf("array<struct<chunk_text:string,heading_context:string>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return sliced(batches, work)

    return run(blocks, fallback)


def chunks(docs: DataFrame, id_col: str, blocks: Column, fallback: Column, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: content_object_id, chunk_index, chunk_id, chunk_text, heading_context, token_estimate."""
    own = docs.select(F.col(id_col).cast("string").alias("content_object_id"), *keep, F.posexplode(chunk_array(blocks, fallback, size, overlap)).alias("chunk_index", "__c"))
    return numbered(own.select("content_object_id", *keep, "chunk_index", "__c.chunk_text", "__c.heading_context"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds chunk_id and token_estimate to rows (content_object_id, chunk_index, chunk_text, heading_context)."""
    number = F.lpad(F.col("chunk_index").cast("string"), 4, "0")
    return rows.withColumn("chunk_id", F.concat_ws(":", F.lit("chunk"), "content_object_id", number, stable_hash(F.concat_ws("|", "heading_context", "chunk_text")))).withColumn(
        "token_estimate", F.greatest(F.lit(1), F.ceil(F.length("chunk_text") / 4)).cast("int")
    )


_LIST_ITEM = r"^([*\-•]|\d+\.)\s+"


def text_blocks(c: Column, title: Column | None = None) -> Column:
    """Blocks of a plain text: its title as first heading, then one block per paragraph, list items told apart."""
    parts = F.filter(F.transform(F.split(plain_text(c), r"\n{2,}"), collapse), lambda p: p != "")
    item = lambda p: p.rlike(_LIST_ITEM)
    block = lambda p: F.struct(
        F.when(item(p), "list_item").otherwise("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), F.when(item(p), F.when(p.rlike(r"^\d"), "numbered").otherwise("bulleted")).alias("list_type"), F.regexp_replace(p, _LIST_ITEM, "").alias("text")
    )
    blocks = F.transform(parts, block)
    if title is None:
        return blocks
    head = F.struct(F.lit("heading").alias("type"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("list_type"), collapse(title).alias("text"))
    return F.when(filled(title), F.concat(F.array(head), blocks)).otherwise(blocks)


def heading_trail(rows: DataFrame, by: str, order: str, level: str, label: str, levels: int = 6) -> DataFrame:
    """Adds `trail` to ordered rows with a heading level (null: no heading): the open headings, joined by " > ".
    A heading closes those of its level and below."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda k: F.max(F.when(F.col(level) == k, F.col(order))).over(w)
    out, parts = rows, []
    for k in range(1, levels + 1):
        above = F.max(F.when(F.col(level) < k, F.col(order))).over(w)
        own = F.max_by(F.when(F.col(level) == k, F.col(label)), F.when(F.col(level) == k, F.col(order))).over(w)
        parts.append(F.when(above.isNull() | (at(k) > above), F.nullif(own, F.lit(""))))
    return out.withColumn("trail", F.concat_ws(" > ", *parts))
