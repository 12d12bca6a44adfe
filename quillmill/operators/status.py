"""Where a workspace stands: its label and message, the destination, and the manifest's counts. Inputs are one-row frames or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.text import filled, let, text_or

# fixed values: labels of readiness, and the messages in order of precedence
LABELS = {"metadata_only": "Metadata only", "content_ready": "Content ready", "automation_ready_partial": "Automation-ready partial"}
MANIFEST_VERSION = 3
# fixed values: hosts of the workspace, and query keys that name a page
HOSTS = ("notion.so", "notion.site")
PAGE_KEYS = ("p", "pageId", "page_id")
_ID = "[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}"


def destination(given: Column) -> Column:
    """(page_id, is_valid) of what was entered for a page: an URL of the workspace with an id in a query key or else its path, or a
    text with an id."""
    found = lambda c: F.lower(F.replace(F.regexp_extract(F.coalesce(c, F.lit("")), _ID, 0), F.lit("-"), F.lit("")))

    def of(u: Column) -> Column:
        host = F.lit(False)
        for h in HOSTS:
            host |= (u["host"] == h) | u["host"].endswith(f".{h}")
        in_url = F.coalesce(text_or(*[found(urls.param(u, k)) for k in PAGE_KEYS], found(u["path"])), F.lit(""))
        hex_ = F.when(u.isNull(), found(given)).when(host, in_url).otherwise("")
        dashed = F.concat_ws("-", *[F.substring(hex_, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        return F.struct(F.when(hex_ != "", dashed).alias("page_id"), (hex_ != "").alias("is_valid"))

    return let(urls.parts(given), of)


def overview(job_status: Column, check_status: Column, given: Column, page_id: Column, is_valid: Column, level: Column) -> Column:
    """(state, label): the first thing that stands in the way, else the plan's level."""
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[level], F.lit("Planned"))
    as_ = lambda state, name: F.struct((state if isinstance(state, Column) else F.lit(state)).alias("state"), (name if isinstance(name, Column) else F.lit(name)).alias("label"))
    return (
        F.when((job_status == "blocked") | (check_status == "blocked"), as_("blocked", "Blocked")).when(~filled(given), as_("destination_missing", "Destination needed")).when(~is_valid | ~filled(page_id), as_("blocked", "Destination invalid"))
        .when(level.isNotNull(), as_(level, label)).otherwise(as_("ready_for_planning", "Ready to plan"))
    )


def message(given: Column, is_valid: Column, page_id: Column, courses: Column, documents: Column, has_token: Column, planned: Column, job_status: Column, job_summary: Column, check_summary: Column, synced: Column) -> Column:
    return (
        F.when(~filled(given), "Paste destination Notion page URL or page ID, choose workspace mode, then plan academic workspace.").when(~is_valid, "Destination must be a valid Notion page URL or raw page ID.")
        .when(~filled(page_id), "Destination saved, but page ID is not parseable yet.").when((courses == 0) & (documents == 0), "Run a Canvas scan first so planner has course and content data.")
        .when(~has_token & planned, "Plan ready. Add Notion integration token, then validate and run live sync.").when(~has_token, "Add Notion integration token to validate destination and run live sync.")
        .when(job_status.isin("syncing", "blocked") & filled(job_summary), job_summary).when(filled(check_summary), check_summary).when(synced, "Latest live Notion sync completed.")
        .when(planned, "Academic workspace plan saved. Validate destination, then run live sync.").otherwise("Validate destination and workspace assumptions, then plan academic workspace.")
    )


def manifest_counts(courses: DataFrame, documents: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: what a manifest holds."""
    i = inventory.agg(
        F.count("*").alias("content_records"), F.count_if(F.col("content_path_type") == "direct_ingest").alias("direct_ingest_candidates"), F.count_if(F.col("content_type") == "file_artifact").alias("file_artifact_candidates"),
        F.count_if(F.col("supported_extraction") & F.col("extraction_status").isin("not_started", "pending")).alias("extraction_pending_items"),
    )
    return courses.agg(F.count("*").alias("courses")).join(documents.agg(F.count("*").alias("documents"))).join(i)  # one row each


def documents_of_courses(documents: DataFrame) -> DataFrame:
    """(course_id, n, ids): the documents of each course in order of discovery. Lists are as long as a course has documents; for
    a join, use the documents themselves."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"])
    return documents.groupBy("course_id").agg(F.count("*").alias("n"), ids.alias("ids"))


def by_section(documents: DataFrame, priority: Column) -> DataFrame:
    """Documents with the place of their section among sections and their number, by title, in their course and section."""
    w = Window.partitionBy("course_id", "source_section").orderBy("title", "seq")
    return documents.withColumn("place", priority).withColumn("nth", F.row_number().over(w))


def result(job_id: Column, plan: dict[str, Column], created: Column, updated: Column, skipped: Column, failed: Column, attached: Column, warnings: Column, blocked: Column) -> Column:
    """A sync or planning job's result row: counts, the plan's numbers, and whether it went through."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    counts = {"created_count": created, "updated_count": updated, "skipped_count": skipped, "failed_count": failed, "artifact_attached_count": attached, **plan}
    return F.struct(job_id.alias("job_id"), (~filled(blocked)).alias("success"), F.nullif(blocked, F.lit("")).alias("blocked_reason"), F.array_distinct(warnings).alias("warnings"), *[zero(c).alias(k) for k, c in counts.items()])
