"""What to write where: plan rows, their readiness, the contract over them, and checks of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import filled, one_of, text, text_or
from quillmill.operators.inventory import eligible

_CONTENT = ("canvas_page", "assignment", "syllabus", "module_resource", "external_resource", "file_artifact", "text_extract")


def planned_readiness() -> Column:
    c, status = F.col, F.col("extraction_status")
    return (
        F.when(F.coalesce("automation_ready", F.lit(False)) | (c("content_readiness_state") == "automation_ready"), "automation_ready")
        .when((c("enrichment_status") == "notion_enriched") | (c("processing_state") == "notion_enriched"), "notion_enriched").when((F.coalesce("chunk_count", F.lit(0)) > 0) | (c("processing_state") == "chunked"), "chunked")
        .when((status == "extracted") | (c("processing_state") == "extracted"), "extracted").when(c("processing_state") == "downloaded", "downloaded").when(status == "unsupported", "unsupported_for_extraction")
        .when(c("supported_extraction") & status.isin("not_started", "pending"), "extraction_pending").otherwise(text_or("content_readiness_state", F.lit("discovered")))
    )


def location(path: Column) -> Column:
    return F.when(path == "direct_ingest", "page_body_blocks").when(path == "file_artifact", "page_attachment_and_artifact_metadata").when(path == "hybrid", "page_attachment_and_page_body_blocks").otherwise("database_properties_only")


def select_courses(inventory: DataFrame, courses: DataFrame | None) -> DataFrame:
    """Rows of the chosen courses (course_id), and rows without a course; all rows if none is chosen."""
    if courses is None:
        return inventory
    own = inventory.where(filled(F.col("course_id"))).join(courses.select("course_id").distinct(), "course_id", "left_semi")
    return own.unionByName(inventory.where(~filled(F.col("course_id"))))


def plan(inventory: DataFrame, courses: DataFrame | None = None) -> DataFrame:
    """One row per planned object: contents, deliverables, one study-asset container and one hub per course."""
    rows = select_courses(inventory, courses)
    common = ["content_object_id", "content_type", "course_id", "content_path_type", "extraction_status", "supported_extraction", "automation_ready", "chunk_count", "due_date", "source_url", "automation_eligibility"]
    base = rows.where(F.col("content_type").isin(*_CONTENT, "deliverable"))
    kind = F.when(F.col("content_type") == "deliverable", "deliverable").otherwise("content")
    planned = base.select(
        F.concat_ws(":", F.concat(kind, F.lit("_plan")), "content_object_id").alias("plan_object_id"), kind.alias("plan_type"), *common, planned_readiness().alias("readiness"), (F.col("content_path_type") != "unknown").alias("holds_content"),
        location(F.col("content_path_type")).alias("location"), F.lit(False).alias("future_output"),
    )
    hubs = rows.where(F.col("content_type") == "course").select("course_id", "source_url").dropDuplicates(["course_id"])

    def of_course(plan_type: str, content_type: str, future: bool) -> DataFrame:
        return hubs.select(
            F.concat_ws(":", F.lit(f"{plan_type}_plan"), "course_id").alias("plan_object_id"), F.lit(plan_type).alias("plan_type"), F.lit("").alias("content_object_id"), F.lit(content_type).alias("content_type"), "course_id", F.lit("unknown").alias("content_path_type"),
            F.lit("not_applicable").alias("extraction_status"), F.lit(False).alias("supported_extraction"), F.lit(False).alias("automation_ready"), F.lit(0).alias("chunk_count"), F.lit(None).cast("string").alias("due_date"), "source_url",
            eligible(F.lit(content_type), F.lit("")).alias("automation_eligibility"), F.lit("discovered").alias("readiness"), F.lit(False).alias("holds_content"), F.lit("database_properties_only").alias("location"), F.lit(future).alias("future_output"),
        )

    return planned.unionByName(of_course("study_asset", "study_asset_container", True)).unionByName(of_course("course_hub", "course", False))


def plan_summary(rows: DataFrame) -> DataFrame:
    kind, content = F.col("plan_type"), F.col("plan_type") == "content"
    return rows.agg(
        F.count_if(kind == "course_hub").alias("course_hubs"), F.count_if(content).alias("content_entries"), F.count_if(kind == "deliverable").alias("deliverables"), F.count_if(kind == "study_asset").alias("study_asset_containers"),
        F.count_if(content & (F.col("content_path_type") == "direct_ingest")).alias("direct_ingest_candidates"), F.count_if(content & (F.col("content_path_type") == "file_artifact")).alias("file_artifact_candidates"),
        F.count_if(content & F.col("supported_extraction") & F.col("extraction_status").isin("not_started", "pending")).alias("extraction_pending_items"),
        F.count_if((kind != "course_hub") & (F.size("automation_eligibility") > 0)).alias("automation_eligible_records"), F.count_if(content & (F.col("automation_ready") | (F.col("chunk_count") > 0))).alias("automation_ready_now"),
    )


def readiness_level(rows: DataFrame) -> DataFrame:
    """One row: how far the planned contents are as a whole."""
    own = rows.where(F.col("plan_type") == "content")
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    return own.agg(some(F.col("holds_content")).alias("a"), some((F.col("extraction_status") == "extracted") | (F.col("chunk_count") > 0)).alias("b"), some(F.col("automation_ready") | (F.col("readiness") == "automation_ready")).alias("c")).select(
        F.when(~F.col("a"), "metadata_only").when(F.col("c"), "automation_ready_partial").when(F.col("b"), "content_ready").otherwise("metadata_only").alias("readiness_level")
    )


def contract(rows: DataFrame) -> DataFrame:
    """What text each planned object can offer to automations."""
    own = rows.where(F.col("plan_type") != "course_hub")
    has_text = F.col("automation_ready") | (F.col("chunk_count") > 0) | (F.col("extraction_status") == "extracted")
    available = (
        F.when(F.col("future_output"), "future_output_container").when(has_text, "extracted_text_ready").when(F.col("content_path_type") == "direct_ingest", "planned_direct_ingest").when(F.col("supported_extraction"), "pending_extraction").otherwise("unavailable")
    )
    return own.select(text("course_id").alias("course_id"), text_or(text("content_object_id"), text("plan_object_id")).alias("content_object_id"), text_or(text("content_type"), text("plan_type")).alias("content_type"), available.alias("text_availability"), filled(F.col("due_date")).alias("has_due_date"), text("source_url").alias("source_url"), "automation_eligibility")


def contract_summary(rows: DataFrame) -> DataFrame:
    """One row. automation_ready_now is 0 by definition: a contract promises texts, not finished automations."""
    a = F.col("text_availability")
    return rows.agg(
        F.count("*").alias("total_records"), F.count_if(a.isin("planned_direct_ingest", "extracted_text_ready")).alias("records_with_text_path"), F.count_if(a == "pending_extraction").alias("extraction_pending_records"), F.count_if("has_due_date").alias("due_date_ready_records"),
        F.count_if(filled(F.col("source_url"))).alias("source_traceable_records"), F.count_if(F.size("automation_eligibility") > 0).alias("automation_eligible_records"), F.lit(0).cast("long").alias("automation_ready_now"),
    )


# fixed values: what a stored plan may say
MODES = ("general", "class_specific")
LEVELS = ("metadata_only", "content_ready", "automation_ready_partial")


def stored_plans(raw: DataFrame) -> DataFrame:
    """Plans in one form, whatever was stored: texts trimmed (null if empty), modes and levels closed, empty warnings and reasons gone. Columns
    that are missing get their defaults; others stay."""
    have = lambda c, t: F.col(c) if c in raw.columns else F.lit(None).cast(t)
    blank = lambda c: F.nullif(text(have(c, "string")), F.lit(""))
    some = lambda c: F.filter(F.coalesce(have(c, "array<string>"), F.array().cast("array<string>")), filled)
    own = {
        "plan_id": blank("plan_id"), "generated_at": blank("generated_at"), "workspace_mode": one_of(text(have("workspace_mode", "string")), MODES, "general"), "readiness_level": one_of(text(have("readiness_level", "string")), LEVELS, "metadata_only"),
        "warnings": some("warnings"), "blocked_reasons": some("blocked_reasons"),
    }
    return raw.select(*[c for c in raw.columns if c not in own], *[c.alias(n) for n, c in own.items()])


def stored_mappings(raw: DataFrame) -> DataFrame:
    """Mappings to a workspace in one form: its page, mode and time, and the ids of its five databases, null where there is none."""
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    own = {"destination_page_id": text(have("destination_page_id")), "workspace_mode": one_of(text(have("workspace_mode")), MODES, "general"), "updated_at": F.nullif(text(have("updated_at")), F.lit(""))}
    own |= {c: F.nullif(have(c), F.lit("")) for c in ("courses", "content", "deliverables", "study_assets", "automation_outputs")}
    return raw.select(*[c for c in raw.columns if c not in own], *[c.alias(n) for n, c in own.items()])


def check(name: str, df: DataFrame, bad: Column, blocking: bool) -> DataFrame:
    """One row of a check: ok, warning or blocked, by how many rows are bad."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad")).select(F.lit(name).alias("check"), "rows", "bad", F.when(F.col("bad") == 0, "ok").otherwise("blocked" if blocking else "warning").alias("status"))


def checks(df: DataFrame, named: dict[str, tuple[Column, bool]]) -> DataFrame:
    """check() of all of these {name: (bad, blocking)} over one table, in one scan of it: a row per check."""
    bad = [F.count_if(F.coalesce(c, F.lit(False))) for c, _ in named.values()]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), b.alias("bad"), F.lit("blocked" if blocking else "warning").alias("__s")) for (n, (_, blocking)), b in zip(named.items(), bad)])
    out = df.agg(F.count("*").alias("rows"), rows.alias("__r")).select("rows", F.explode("__r").alias("__r")).select("__r.*", "rows")
    return out.select("check", "rows", "bad", F.when(F.col("bad") == 0, "ok").otherwise(F.col("__s")).alias("status"))


def worst(checks: DataFrame) -> DataFrame:
    order = F.array(*[F.lit(x) for x in ("ok", "warning", "blocked")])
    return checks.agg(F.max_by("status", F.array_position(order, F.col("status"))).alias("status"))
