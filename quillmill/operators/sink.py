"""Rows as the columns that a remote workspace shows. Empty dates, numbers, links and choices are null, empty texts stay empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import filled, text, text_or


def _words(name: Column | str, *others: Column | str) -> Column:
    return F.coalesce(text_or(name, *others), F.lit(""))


def _choice(c: Column | str) -> Column:
    return F.nullif(text(c), F.lit(""))


def _yes(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _named(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns.items()])


def courses(rows: DataFrame, mode: Column, status: Column, synced_at: Column, hub: Column) -> DataFrame:
    """rows: (course_id, course_name, term, course_url)."""
    # fixed values: names of columns, here and below
    return _named(rows, {
        "Course Name": text_or("course_name", F.concat(F.lit("Course "), "course_id")), "Canvas Course ID": _words("course_id"), "Term": _words("term"), "Canvas URL": _choice("course_url"),
        "Import Scope / Mode": _choice(mode), "Sync Status": _choice(status), "Last Synced": synced_at, "Course Hub Page ID": F.coalesce(hub, F.lit("")),
    })


def content(rows: DataFrame, status: Column, synced_at: Column) -> DataFrame:
    """rows: an inventory with its extraction state (extraction.merge_state), the columns week_or_module, discovered_at,
    local_download_path, is_hosted and is_downloadable being optional."""
    have = lambda name, blank: F.col(name) if name in rows.columns else F.lit(blank)
    some = F.length(text("extracted_text")) > 0
    ready = _yes("automation_ready") | (status == "artifact_attached") | (F.coalesce("chunk_count", F.lit(0)) > 0) | some
    return _named(rows, {
        "Title": text_or("source_page_title", "file_name", "content_type"), "Content Object ID": _words("content_object_id"), "Canvas Course ID": _words("course_id"), "Course Name": _words("course_name"), "Content Type": _choice("content_type"),
        "Source Section": _choice("source_section"), "Source Page Title": _words("source_page_title"), "Source URL": text_or("source_page_url", "external_url", "source_url"), "Canvas URL": text_or("source_url", "external_url", "source_page_url"),
        "Week/Module": _words(have("week_or_module", "")), "Date Discovered": _choice(have("discovered_at", "")), "Processing Status": _choice(status), "Extraction Status": text_or("extraction_status", F.lit("not_started")),
        "Readiness": text_or("content_readiness_state", F.lit("discovered")), "Source Category": text_or("source_category", F.lit("unsupported")), "Extraction Method": _words("extraction_method"), "Extracted Text Present": _yes(some),
        "Word Count": F.coalesce("word_count", F.lit(0)), "Char Count": F.coalesce("char_count", F.lit(0)), "Chunk Count": F.coalesce("chunk_count", F.lit(0)), "Unsupported Reason": _words("unsupported_reason", "failure_reason"), "Last Synced": synced_at,
        "Automation Ready": _yes(ready), "Local Download Path": _words(have("local_download_path", "")), "File Name": _words("file_name"), "Is Canvas Hosted": _yes(have("is_hosted", False)), "Is Downloadable": _yes(have("is_downloadable", False)), "Is External": _yes("is_external"),
    })


def deliverables(rows: DataFrame, status: Column, synced_at: Column) -> DataFrame:
    due = filled(F.col("due_date"))
    return _named(rows, {
        "Title": text_or("source_page_title", F.lit("Canvas deliverable")), "Content Object ID": _words("content_object_id"), "Canvas Course ID": _words("course_id"), "Course Name": _words("course_name"), "Source URL": text_or("source_url", "source_page_url"),
        "Due Date": _choice("due_date"), "Due Date Available": due, "Processing Status": _choice(status), "Last Synced": synced_at, "Automation Ready": due,
    })


def outputs(rows: DataFrame, synced_at: Column) -> DataFrame:
    """rows: outputs joined with their runs, whose columns run_id, target_scope, window_start and window_end come as run_*."""
    ids = F.when(F.size("related_course_ids") > 0, F.col("related_course_ids")).when(filled(F.col("course_id")), F.array("course_id")).otherwise(F.array().cast("array<string>"))
    return _named(rows, {
        "Title": text_or("title", "output_id", F.lit("Automation Output")), "Output ID": _words("output_id"), "Automation ID": _words("automation_id"), "Artifact Type": text_or("artifact_type", F.lit("overview")), "Run ID": _words("run_id", "run_run_id"),
        "Target Scope": text_or("target_scope", "run_target_scope", F.lit("workspace")), "Canvas Course IDs": F.array_join(ids, ", "), "Course Names": F.array_join(F.coalesce("course_names", F.array().cast("array<string>")), ", "),
        "Window Start": text_or("window_start", "run_window_start"), "Window End": text_or("window_end", "run_window_end"), "Source Count": F.coalesce("source_count", F.lit(0)), "Summary": _words("summary"), "Created At": text_or("created_at", synced_at), "Updated At": synced_at,
    })


def hub_lines(url: Column, term: Column, mode: Column, synced_at: Column, parent: Column) -> Column:
    """The lines of a course's summary, in order."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    lines = F.array(
        line("Canvas URL", url), F.when(filled(term), line("Term", term)), line("Workspace mode", F.when(mode == "class_specific", mode).otherwise("general")), line("Last synced", synced_at), F.when(filled(parent), line("Parent workspace", parent))
    )
    return F.filter(lines, lambda x: x.isNotNull())


def artifact_kind(upload: Column, file_name: Column) -> Column:
    """pdf or file; null without an upload."""
    return F.when(filled(upload), F.when(F.coalesce(file_name, F.lit("")).rlike(r"(?i)\.pdf$"), "pdf").otherwise("file"))


def body_parts(content_type: Column, upload: Column, file_name: Column, source_url: Column, page_url: Column, external_url: Column, status: Column, extracted: Column, words: Column, chunks: Column, strict: bool = False) -> Column:
    """What a content row's page is made of, in order, after its provenance: (kind, text). Kinds: pdf and file (the attached artifact),
    paragraph, heading, extracted (the extracted text follows) and body (the page's own text follows). strict: an empty extracted text is one
    too, and a null count makes its line null."""
    part = lambda kind, c=None: F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), (F.lit("") if c is None else c).alias("text"))
    from_where = text_or(source_url, page_url, F.lit(""))
    some = extracted.isNotNull() if strict else F.length(text(extracted)) > 0
    count = lambda c: (c if strict else F.coalesce(c, F.lit(0))).cast("string")
    told = F.concat(F.lit("Extraction: "), text_or(status, F.lit("extracted")), F.lit(" · "), count(words), F.lit(" words · "), count(chunks), F.lit(" chunks"))
    found = F.when(some, F.array(part("heading", F.lit("Extracted Content")), part("paragraph", told), part("extracted")))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    kind = artifact_kind(upload, file_name)
    note = F.when(filled(upload), F.concat(F.lit("Artifact attached from "), from_where, F.lit("."))).otherwise(F.concat(F.lit("Artifact not attached yet. Source: "), from_where, F.lit(".")))
    artifact = F.concat(F.when(kind.isNotNull(), F.array(part(kind, F.coalesce(file_name, F.lit(""))))).otherwise(none), F.array(part("paragraph", note)), F.coalesce(found, none))
    outside = F.array(part("paragraph", F.concat(F.lit("External resource: "), text_or(external_url, source_url, page_url, F.lit("")))))
    return F.when(content_type == "file_artifact", artifact).when(content_type == "external_resource", outside).otherwise(F.coalesce(found, F.array(part("body"))))
