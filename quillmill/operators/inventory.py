"""One inventory of courses, content items, deliverables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.text import filled, is_script_gate, let, one_of, stable_hash, text, text_or
from quillmill.operators.extraction import EXTRACTABLE, descriptor

# fixed values: types of inventory rows, and what may be made of them
TYPES = ("course", "canvas_page", "assignment", "syllabus", "module_resource", "external_resource", "file_artifact", "text_extract", "deliverable", "study_asset_container")
GENERAL = ("weekly_content_recap", "class_summary", "flashcard_generation", "review_question_generation")
DIRECT_SECTIONS = ("pages", "assignments", "syllabus", "modules", "home")


def type_of_section(section: Column) -> Column:
    return F.when(section == "assignments", "assignment").when(section == "syllabus", "syllabus").when(section == "modules", "module_resource").otherwise("canvas_page")


def source_type(section: Column, content_type: Column) -> Column:
    return (
        F.when(content_type == "external_resource", "external_resource").when(content_type == "file_artifact", "canvas_file").when(section == "assignments", "canvas_assignment").when(section == "syllabus", "canvas_syllabus")
        .when(section == "modules", "canvas_module").when(section == "pages", "canvas_page").otherwise("canvas_course")
    )


def eligible(content_type: Column, path_type: Column) -> Column:
    names = lambda *v: F.array(*[F.lit(x) for x in v])
    direct = path_type.isin("direct_ingest", "hybrid")
    return (
        F.when(content_type == "deliverable", names("weekly_task_overview", "class_summary")).when(content_type == "study_asset_container", names("flashcard_generation", "review_question_generation")).when(content_type == "file_artifact", names(*GENERAL))
        .when(direct & (content_type == "assignment"), names("weekly_content_recap", "class_summary", "review_question_generation")).when(direct & content_type.isin("canvas_page", "syllabus", "module_resource"), names(*GENERAL))
        .otherwise(F.array().cast("array<string>"))
    )


def page_title(title: Column, otherwise: Column) -> Column:
    return let(text(title), lambda t: F.when((t == "") | is_script_gate(t), text(otherwise)).otherwise(t))


def is_bogus_preview(items: DataFrame) -> Column:
    """A file preview whose text stands for missing content."""
    url = text_or("source_page_url", "source_url") if "source_url" in items.columns else text_or("source_page_url")
    return F.coalesce(let(urls.parts(url), urls.is_file_preview) & is_script_gate(text_or("body_text", "excerpt", "source_page_title")), F.lit(False))


_COLUMNS = ("content_object_id", "content_type", "source_type", "course_id", "course_name", "source_url", "source_section", "source_page_title", "source_page_url", "content_path_type", "source_document_ids", "file_name", "body_text", "content_hash", "due_date", "external_url", "is_external", "automation_eligibility", "seq")


def _row(df: DataFrame, **cols: Column) -> DataFrame:
    blank = {"source_document_ids": F.array().cast("array<string>"), "is_external": F.lit(False), "due_date": F.lit(None).cast("string"), "automation_eligibility": F.array().cast("array<string>")}
    return df.select(*[cols.get(c, blank.get(c, F.lit(""))).alias(c) for c in _COLUMNS])


def course_rows(courses: DataFrame) -> DataFrame:
    return _row(courses, content_object_id=F.concat(F.lit("course:"), "course_id"), content_type=F.lit("course"), source_type=F.lit("canvas_course"), course_id=text("course_id"), course_name=text("course_name"), source_url=text("course_url"), source_section=F.lit("home"), source_page_title=text("course_name"), content_path_type=F.lit("unknown"), seq=F.col("seq"))


def _first(df: DataFrame, *key: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("__n = 1").drop("__n")


def content_rows(items: DataFrame) -> DataFrame:
    """The first row per type, course and page (or URL, or title)."""
    kind = one_of(F.col("content_type"), TYPES, type_of_section(F.col("source_section")))
    external = F.coalesce("is_external", F.lit(False)) | (kind == "external_resource")
    body = filled(text("body_html")) | filled(text("body_text"))
    path = F.when(external, "unknown").when(body, "direct_ingest").otherwise("unknown")
    own_id = text_or("id", F.concat_ws(":", kind, stable_hash(text_or("source_page_url", "external_url", "source_page_title"))))
    rows = _row(
        items, content_object_id=own_id, content_type=kind, source_type=source_type(F.col("source_section"), kind), course_id=text("course_id"), course_name=text("course_name"), source_url=F.coalesce(text_or("source_page_url", "external_url"), F.lit("")),
        source_section=text_or(text("source_section"), F.lit("home")), source_page_title=page_title(F.col("source_page_title"), F.col("title")), source_page_url=text("source_page_url"), content_path_type=path, body_text=text("body_text"),
        content_hash=text("content_hash"), due_date=F.nullif(text("due_date"), F.lit("")), external_url=text("external_url"), is_external=external, automation_eligibility=F.when(external, F.array().cast("array<string>")).otherwise(eligible(kind, path)), seq=F.col("seq"),
    )
    return _first(rows, F.col("content_type"), F.col("course_id"), text_or("source_page_url", "external_url", "source_page_title"))


def deliverable_rows(items: DataFrame) -> DataFrame:
    """Assignments once more, as what is due."""
    own = items.where(one_of(F.col("content_type"), TYPES, type_of_section(F.col("source_section"))) == "assignment")
    body = filled(text("body_html")) | filled(text("body_text"))
    rows = _row(
        own, content_object_id=F.concat_ws(":", F.lit("deliverable"), "course_id", stable_hash(text_or("source_page_url", "source_page_title", "id"))), content_type=F.lit("deliverable"), source_type=F.lit("canvas_assignment"), course_id=text("course_id"),
        course_name=text("course_name"), source_url=text("source_page_url"), source_section=F.lit("assignments"), source_page_title=page_title(F.col("source_page_title"), F.lit("Canvas deliverable")), source_page_url=text("source_page_url"),
        content_path_type=F.when(body, "direct_ingest").otherwise("unknown"), body_text=text("body_text"), content_hash=text("content_hash"), due_date=F.nullif(text("due_date"), F.lit("")),
        automation_eligibility=eligible(F.lit("deliverable"), F.lit("")), seq=F.col("seq"),
    )
    return _first(rows, F.col("content_object_id"))


def _document_pages(docs: DataFrame, kind: Column, prefix: Column, key: Column, hashed: Column) -> DataFrame:
    w = Window.partitionBy("course_id", key)
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id")).over(w)), lambda x: x["id"]))
    rows = docs.withColumn("__ids", ids)
    section = F.when(kind == "deliverable", F.lit("assignments")).otherwise(F.col("source_section"))
    full = _row(
        rows, content_object_id=F.concat_ws(":", prefix, "course_id", stable_hash(hashed)), content_type=kind, source_type=F.when(kind == "deliverable", "canvas_assignment").otherwise(source_type(section, kind)), course_id=text("course_id"), course_name=text("course_name"),
        source_url=text_or("source_page_url", "url"), source_section=section, source_page_title=page_title(F.col("source_page_title"), text_or("file_name", "link_text")), source_page_url=text("source_page_url"), content_path_type=F.lit("direct_ingest"),
        source_document_ids=F.col("__ids"), automation_eligibility=eligible(kind, F.lit("direct_ingest")), seq=F.col("seq"),
    )
    return _first(full, F.col("content_object_id"))


def document_page_rows(docs: DataFrame) -> DataFrame:
    """Pages and deliverables told from documents alone, for inventories without content items."""
    place = text_or("source_page_url", "source_page_title")
    own = docs.where(F.col("source_section").isin(*DIRECT_SECTIONS) & place.isNotNull())
    kind = type_of_section(F.col("source_section"))
    pages = _document_pages(own, kind, kind, F.concat_ws(":", "source_section", place), F.concat_ws(":", "source_section", place))
    due = _document_pages(own.where(F.col("source_section") == "assignments"), F.lit("deliverable"), F.lit("deliverable"), place, place)
    return pages.unionByName(due)


def file_rows(docs: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce("is_external", F.lit(False)), "external_file").when(F.coalesce("is_hosted", F.lit(False)), "canvas_file").otherwise("course_file")
    return _row(
        docs, content_object_id=F.concat(F.lit("file_artifact:"), "id"), content_type=F.lit("file_artifact"), source_type=kind, course_id=text("course_id"), course_name=text("course_name"), source_url=text("url"), source_section=text_or(text("source_section"), F.lit("home")),
        source_page_title=page_title(F.col("source_page_title"), text_or("file_name", "link_text")), source_page_url=text("source_page_url"), content_path_type=F.when(F.coalesce("is_downloadable", F.lit(False)), "file_artifact").otherwise("unknown"),
        source_document_ids=F.array("id"), file_name=F.coalesce(text_or("file_name", "link_text"), F.lit("")), is_external=F.coalesce("is_external", F.lit(False)), automation_eligibility=eligible(F.lit("file_artifact"), F.lit("file_artifact")), seq=F.col("seq"),
    )


def build(courses: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """The union of all rows with what can be extracted of them. Documents stand in for pages only where there is no
    usable content item at all."""
    usable = items.where(~is_bogus_preview(items))
    some = usable.limit(1).count() > 0
    parts = [course_rows(courses), file_rows(docs), content_rows(usable), deliverable_rows(usable)]
    if not some:
        parts.append(document_page_rows(docs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_extraction_defaults(out)


def with_extraction_defaults(rows: DataFrame) -> DataFrame:
    ext = text_or(urls.extension(F.col("file_name")), urls.extension(F.col("source_url")), urls.extension(F.col("source_page_url")))
    d = descriptor(F.col("content_type"), ext, F.lit(""), filled(F.col("body_text")))
    out = rows.withColumn("__d", d)
    takes_part = F.col("content_type").isin(*EXTRACTABLE)
    ok = F.col("__d.supported")
    pick = lambda a, b, c: F.when(~takes_part, a).when(~ok, b).otherwise(c)
    return out.select(
        *rows.columns, F.col("__d.source_category").alias("source_category"), (takes_part & ok).alias("supported_extraction"), pick("discovered", "unsupported_for_extraction", "discovered").alias("processing_state"),
        pick("not_applicable", "unsupported", "not_started").alias("extraction_status"), pick("not_applicable", "not_applicable", "not_started").alias("normalization_status"), pick("not_applicable", "not_started", "not_started").alias("enrichment_status"),
        F.when(takes_part & ok, F.lit("")).otherwise(F.col("__d.reason")).alias("unsupported_reason"), pick("discovered", "unsupported_for_extraction", "discovered").alias("content_readiness_state"), F.when(takes_part & ok, F.col("__d.method")).otherwise("").alias("extraction_method"),
    )


def summary(rows: DataFrame) -> DataFrame:
    t = F.col("content_type")
    return rows.agg(
        F.count("*").alias("total_records"), F.count_if(t == "course").alias("courses"), F.count_if(F.col("content_path_type") == "direct_ingest").alias("direct_ingest_candidates"), F.count_if(t == "file_artifact").alias("file_artifact_candidates"),
        F.count_if(F.col("supported_extraction") & F.col("extraction_status").isin("not_started", "pending")).alias("extraction_pending_items"), F.count_if(F.col("extraction_status") == "extracted").alias("extracted_items"),
        F.count_if(F.col("extraction_status") == "unsupported").alias("unsupported_items"), F.count_if(t == "deliverable").alias("deliverables"),
    )
