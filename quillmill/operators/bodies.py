"""What a content row's page holds, block by block, in the batches that a sink takes.

A body is at most a few thousand blocks, so it is put together as an array in its row and nothing is shuffled: where it is from, the
attached artifact, and the extracted or own text as rich blocks. Positions and batches follow when the array is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import render
from quillmill.functions.text import text_or
from quillmill.operators import sink
from quillmill.sources import rich_blocks

# fixed value: blocks that are appended at a time
BATCH = 100
_TEXTS = ("content_type", "source_page_title", "source_url", "source_page_url", "source_section", "external_url", "file_name", "upload", "extraction_status", "extracted_text", "extracted_html", "body_html", "body_text", "excerpt")
_MARKS = ("bold", "italic", "strikethrough", "underline", "code")


def _block(kind: Column, said: Column) -> Column:
    run = F.struct(said.alias("text"), F.lit(None).cast("string").alias("href"), *[F.lit(False).alias(m) for m in _MARKS])
    return F.struct(kind.alias("type"), F.array(run).alias("runs"))


def rows(records: DataFrame, at: Column, strict: bool = False) -> DataFrame:
    """(content_object_id, pos, batch, type, runs, text) of each record's body. Of an extracted or own text the first 1000 blocks are kept, with the
    heading and the line that stand before an extracted one.

    Defined cases: missing columns and null texts count as empty; a record without any text has the blocks that say where it is from; an
    empty table gives no rows. strict: as a query's SQL puts lines together: none is left out for an empty value, a null makes its line null, and
    a text that was extracted has its heading even if it is empty."""
    have = records.withColumns({c: F.lit(None).cast("string") for c in _TEXTS if c not in records.columns} | {c: F.lit(0) for c in ("word_count", "chunk_count") if c not in records.columns})
    c = F.col
    parts = sink.body_parts(c("content_type"), c("upload"), c("file_name"), c("source_url"), c("source_page_url"), c("external_url"), c("extraction_status"), c("extracted_text"), c("word_count"), c("chunk_count"), strict)
    have = have.withColumn("__parts", parts).withColumn("__what", F.element_at(F.transform("__parts", lambda p: p["kind"]), -1))
    whole = c("__what") == "extracted"
    own = rich_blocks.rich_blocks(F.when(whole, c("extracted_html")).when(c("__what") == "body", c("body_html")), F.when(c("__what") == "body", text_or("body_text", "excerpt")))
    have = have.withColumn("__own", own)
    origin = F.transform(render.provenance(c("source_page_title"), text_or("source_url", "source_page_url"), c("source_section"), at, strict), lambda x: _block(F.lit("paragraph"), x))
    said = F.filter("__parts", lambda p: ~p["kind"].isin("extracted", "body"))
    kinds = F.transform(said, lambda p: _block(F.when(p["kind"] == "heading", "heading_2").otherwise(p["kind"]), p["text"]))
    before = F.when(whole, F.size(kinds) - 2).otherwise(F.size(kinds))  # the heading and its line count with the text
    body = F.concat(origin, F.slice(kinds, 1, before), F.slice(F.concat(F.slice(kinds, before + 1, F.size(kinds)), F.coalesce("__own", F.array().cast(rich_blocks.SCHEMA))), 1, rich_blocks.BLOCKS))
    out = have.select("content_object_id", F.posexplode(body).alias("pos", "__b")).select("content_object_id", "pos", "__b.*")
    return out.withColumns({"batch": F.floor(c("pos") / BATCH).cast("int"), "text": F.when(~F.exists("runs", lambda r: r["text"].isNull()), F.array_join(F.transform("runs", lambda r: r["text"]), ""))})
