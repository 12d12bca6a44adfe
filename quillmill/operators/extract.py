"""Extraction from record to chunks: one frame, routed by kind, with an error column for each row.

Pages and Word files are parsed in one Arrow pass (a row of another kind passes null), plain texts and PDF items are put
together by columns, and what follows is the same for all: blocks, text, counts, chunks and the outcome. A record that cannot be
read fails by itself. Only PDF items are shuffled, as they come as rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import render
from quillmill.functions.slices import sliced
from quillmill.functions.text import is_script_gate, once, text, text_or, units, word_count
from quillmill.operators import chunking, extraction, jobs, pdf
from quillmill.sources import docx, html

# fixed values: why a record is not extracted
NO_URL = "Missing source URL for extraction."
GATE_FILE = "Canvas returned a JavaScript gate page instead of the file bytes."
GATE_PAGE = "Canvas returned a JavaScript gate page instead of extractable content."
NOT_READ = "The source could not be read."
CHUNK_COLUMNS = ("content_object_id", "source_document_id", "course_id", "course_name", "content_type", "source_page_url", "source_page_title", "source_category", "extraction_version")
_PARSED = pa.struct([("blocks", pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("list_type", pa.string()), ("text", pa.string())]))), ("text", pa.string()), ("error", pa.string())])
_PARSED_SQL = f"struct<blocks:{html.BLOCKS},text:string,error:string>"
#: What describe() asks for, with what a column counts as where a record does not have it.
_GIVEN = {c: "string" for c in ("content_object_id", "content_type", "extension", "media_type", "fetched_type", "source_url", "title", "body_html", "body_text", "excerpt", "text")} | {"content": "binary"}


def _parse(page: str | None, file: bytes | None, title: str | None) -> tuple[list[dict], str | None, str | None] | None:
    """(blocks, text to fall back on, error) of a page or a Word file; None if there is neither."""
    try:
        if page is not None and page.strip():
            found = html.page_blocks(page, title or "")
            return found, None if found else html.page_text(page), None
        if file is not None:
            found = docx.docx_blocks(file, strict=True)
            head = [{"type": "heading", "level": 1, "list_type": None, "text": title.strip()}] if title and title.strip() and not any(b["type"] == "heading" for b in found) else []
            return head + found, None, None
    except Exception as e:  # noqa: BLE001  whatever is wrong with a record is that record's own failure
        return [], None, f"{NOT_READ} {e}".strip()
    return None


def _parsed(page: Column, file: Column, title: Column) -> Column:
    def work(pages: pa.Array, files: pa.Array, titles: pa.Array) -> pa.Array:
        out = [_parse(*x) for x in zip(pages.to_pylist(), files.to_pylist(), titles.to_pylist())]
        return pa.array([None if x is None else dict(zip(("blocks", "text", "error"), x)) for x in out], _PARSED)

    @F.arrow_udf(_PARSED_SQL)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return sliced(batches, work)

    return run(page, file, title)


def describe(records: DataFrame) -> DataFrame:
    """Adds `d`, how each record is extracted, and the columns of a record and its payload that are missing."""
    out = records.withColumns({c: F.lit(None).cast(t) for c, t in _GIVEN.items() if c not in records.columns})
    return out.withColumn("d", extraction.descriptor(F.col("content_type"), F.col("extension"), F.coalesce("media_type", F.lit("")), text("body_html") != ""))


def _refused() -> Column:
    """Why the fetched payload cannot be what was asked for; null if it can."""
    d, kind = F.col("d"), F.upper(F.col("d.source_category"))
    page = F.lower(F.coalesce("fetched_type", F.lit(""))).rlike("text/html|application/xhtml")
    file = d["fetch_mode"] == "fetch_binary"
    return (
        F.when((d["fetch_mode"] != "inline_html") & (text("source_url") == ""), NO_URL).when(file & page & is_script_gate(F.col("text")), GATE_FILE)
        .when(file & page, F.concat(F.lit("Expected "), kind, F.lit(" source, but fetch returned HTML."))).when(d["fetch_mode"].isin("fetch_html", "fetch_text") & is_script_gate(F.col("text")), GATE_PAGE)
    )


def pdf_texts(items: DataFrame) -> DataFrame:
    """items: (content_object_id, page, seq, str, x, y, height). (content_object_id, pdf_text): pages and paragraphs in order."""
    rows = pdf.paragraphs(pdf.lines(items.withColumnRenamed("content_object_id", "doc_id")))
    ordered = F.array_sort(F.collect_list(F.struct("page", "paragraph", "text")))
    return rows.groupBy(F.col("doc_id").alias("content_object_id")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("pdf_text"))


def extract(records: DataFrame, pdf_items: DataFrame | None = None, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Each record (content_object_id, content_type, extension, media_type, source_url, title; payload: body_html, body_text, excerpt,
    text, content, fetched_type) with its outcome: status (completed, failed, unsupported), reason, and the state that follows from it.

    Defined cases: a null payload is an empty one; a record without text fails unless it has a title, which then is its text;
    empty ids are kept; an empty table gives an empty result."""
    rows = describe(records)
    if pdf_items is not None:  # only what is a PDF meets its items
        kind = F.col("d.source_category") == "pdf"
        rows = rows.where(kind).join(pdf_texts(pdf_items), "content_object_id", "left").unionByName(rows.where(~kind).withColumn("pdf_text", F.lit(None).cast("string")))
    else:
        rows = rows.withColumn("pdf_text", F.lit(None).cast("string"))
    d = F.col("d")
    native, kind, inline = d["source_category"] == "canvas_native_html", d["source_category"], d["fetch_mode"] == "inline_html"
    rows = rows.withColumn("__refused", once(F.when(d["supported"], _refused())))
    go = d["supported"] & F.col("__refused").isNull()
    page = F.when(go & inline, F.col("body_html")).when(go & (native | (kind == "html_file")), F.col("text"))
    rows = rows.withColumn("__p", _parsed(page, F.when(go & (kind == "docx"), F.coalesce("content", F.lit(b""))), F.col("title")))
    fall_back = text_or(F.when(native, text_or("body_text", "excerpt")).when(kind == "html_file", F.col("text")), "__p.text")
    plain = F.when(kind == "txt", F.col("text")).when(kind == "pdf", F.col("pdf_text")).otherwise(fall_back)
    own = F.when(F.size("__p.blocks") > 0, F.col("__p.blocks")).when(go & F.col("__p.error").isNull() & (kind != "docx"), chunking.text_blocks(plain, F.col("title")))
    rows = rows.withColumn("__b", once(F.filter(F.coalesce(own, F.array().cast(html.BLOCKS)), lambda b: text(b["text"]) != "")))
    rows = rows.withColumn("__t", once(render.blocks_text(F.col("__b"))))
    rows = rows.withColumn("extracted_text", once(F.when(is_script_gate(F.col("__t")), "").otherwise(F.col("__t"))))
    reason = F.when(~d["supported"], d["reason"]).otherwise(F.coalesce("__refused", "__p.error", F.when(F.col("extracted_text") == "", jobs.NO_TEXT), F.lit("")))
    status = F.when(~d["supported"], "unsupported").when(F.col("reason") != "", "failed").otherwise("completed")
    rows = rows.withColumn("reason", reason).withColumn("status", status)
    done = F.col("status") == "completed"
    blocks = F.when(done, F.col("__b")).otherwise(F.array().cast(html.BLOCKS))
    rows = rows.withColumn("semantic_blocks", blocks).withColumn("extracted_text", F.when(done, F.col("extracted_text")).otherwise(""))
    rows = rows.withColumn("chunks", chunking.chunk_array(F.col("semantic_blocks"), F.col("extracted_text"), size, overlap))
    of = lambda kind: F.filter("semantic_blocks", lambda b: b["type"] == kind)
    n = F.size("chunks")
    by_status = lambda completed, failed, unsupported: F.when(done, completed).when(F.col("status") == "failed", failed).otherwise(unsupported)
    state = {
        "source_category": kind, "extraction_method": d["method"], "extraction_version": F.lit(extraction.VERSION), "extracted_html": render.blocks_html(F.col("semantic_blocks")), "headings": F.transform(of("heading"), lambda b: b["text"]),
        "paragraph_count": F.size(of("paragraph")), "word_count": word_count(F.col("extracted_text")), "char_count": units(F.col("extracted_text")), "chunk_count": n, "automation_ready": done & (n > 0),
        "processing_state": by_status(F.when(n > 0, "chunked").otherwise("extracted"), "extraction_failed", "unsupported_for_extraction"), "extraction_status": by_status("extracted", "failed", "unsupported"),
        "normalization_status": by_status("normalized", "failed", "not_applicable"),
    }
    out = rows.withColumns(state).withColumn("heading_count", F.size("headings"))
    return out.drop("d", "__p", "__b", "__t", "__refused", "pdf_text", *[c for c in _GIVEN if c not in records.columns])


def chunk_rows(extracted: DataFrame) -> DataFrame:
    """A row per chunk with what it is a chunk of. A missing source document is null, other missing texts are empty."""
    have = lambda c: F.col(c) if c in extracted.columns else F.lit(None).cast("string")
    document = text_or(have("document_id"), F.try_element_at(have("source_document_ids"), F.lit(1)) if "source_document_ids" in extracted.columns else F.lit(None).cast("string"))
    meta = {c: F.coalesce(have(c), F.lit("")) for c in CHUNK_COLUMNS} | {"source_document_id": document, "source_page_title": F.coalesce(text_or(have("source_page_title"), have("file_name")), F.lit(""))}
    one = extracted.where("chunk_count > 0").select(*[c.alias(n) for n, c in meta.items()], F.posexplode("chunks").alias("chunk_index", "__c"))
    return chunking.numbered(one.select(*meta, "chunk_index", "__c.*"))


def drain(queue: DataFrame, records: DataFrame, pdf_items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs every queued job once: (jobs with status, attempts and reason; extracted records of these jobs). A record is extracted once,
    however many jobs ask for it; a job whose record is gone is unsupported."""
    began = jobs.started(queue)
    ran = began.where(F.col("status") == "processing")
    done = extract(records.join(ran.select("content_object_id").distinct(), "content_object_id", "left_semi"), pdf_items)
    own = describe(records).select("content_object_id", F.col("d.supported").alias("supported"), F.col("d.reason").alias("unsupported_reason"))
    some = F.substring(text("extracted_text"), 1, 1).alias("extracted_text")  # whether there is a text is all that a job asks
    results = done.where(F.col("status") != "unsupported").select("content_object_id", some, F.when(F.col("status") == "failed", F.col("reason")).alias("error"))
    return jobs.finished(ran, own, results).unionByName(began.where(F.col("status") != "processing").withColumn("reason", F.lit(""))), done
