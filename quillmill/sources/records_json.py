"""Rows of a remote store from JSON pages: (page_id, url, properties), the properties an object of typed values by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import text, text_or

_PARTS = "array<struct<plain_text:string,text:struct<content:string>>>"


def rich_text(c: Column) -> Column:
    """A JSON list of text parts as one text."""
    return text(F.array_join(F.transform(F.from_json(c, _PARTS), lambda p: F.coalesce(text_or(p["plain_text"], p["text"]["content"]), F.lit(""))), ""))


def _get(properties: Column, name: str, path: str) -> Column:
    return F.get_json_object(properties, f"$['{name}'].{path}")


def read_text(properties: Column, name: str) -> Column:
    """A property as text, by its type; empty if it is missing."""
    of = lambda path: F.coalesce(_get(properties, name, path), F.lit(""))
    kind = _get(properties, name, "type")
    return F.coalesce(
        F.when(kind.isin("title", "rich_text"), rich_text(F.when(kind == "title", of("title")).otherwise(of("rich_text")))).when(kind == "select", of("select.name")).when(kind == "url", of("url")).when(kind == "date", of("date.start")).when(kind == "number", of("number")),
        F.lit(""),
    )


def read_date(properties: Column, name: str) -> Column:
    return F.coalesce(_get(properties, name, "date.start"), F.lit(""))


def read_select(properties: Column, name: str) -> Column:
    return F.coalesce(_get(properties, name, "select.name"), F.lit(""))


def read_checkbox(properties: Column, name: str) -> Column:
    return F.coalesce(_get(properties, name, "checkbox") == "true", F.lit(False))


def read_number(properties: Column, name: str) -> Column:
    return F.coalesce(_get(properties, name, "number").try_cast("double"), F.lit(0.0))


# fixed values: the names of properties in the store
def content_rows(pages: DataFrame) -> DataFrame:
    p = F.col("properties")
    return pages.select(
        "page_id", "url", read_text(p, "Content Object ID").alias("content_object_id"), read_text(p, "Canvas Course ID").alias("course_id"), read_text(p, "Course Name").alias("course_name"), text_or(read_text(p, "Title"), F.lit("Content")).alias("title"),
        read_select(p, "Content Type").alias("content_type"), read_select(p, "Source Section").alias("source_section"), read_text(p, "Source Page Title").alias("source_page_title"), read_text(p, "Source URL").alias("source_url"),
        read_text(p, "Week/Module").alias("week_or_module"), read_date(p, "Date Discovered").alias("discovered_at"), read_select(p, "Processing Status").alias("processing_status"), read_select(p, "Extraction Status").alias("extraction_status"),
        read_select(p, "Readiness").alias("readiness"), read_checkbox(p, "Extracted Text Present").alias("has_text"), read_number(p, "Word Count").alias("word_count"), read_number(p, "Chunk Count").alias("chunk_count"),
    )


def task_rows(pages: DataFrame) -> DataFrame:
    p = F.col("properties")
    return pages.select(
        "page_id", "url", read_text(p, "Content Object ID").alias("content_object_id"), read_text(p, "Canvas Course ID").alias("course_id"), read_text(p, "Course Name").alias("course_name"), text_or(read_text(p, "Title"), F.lit("Task")).alias("title"),
        read_date(p, "Due Date").alias("due_date"), read_checkbox(p, "Due Date Available").alias("has_due_date"), read_select(p, "Processing Status").alias("processing_status"), read_text(p, "Source URL").alias("source_url"), read_checkbox(p, "Automation Ready").alias("automation_ready"),
    )


def tolerant(c: Column, schema: str) -> Column:
    """(value, raw_text): the parsed JSON, or the text where it is none."""
    parsed = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(c).isNotNull()
    return F.struct(F.when(ok, parsed).alias("value"), F.when(~ok & (F.coalesce(c, F.lit("")) != ""), c).alias("raw_text"))
