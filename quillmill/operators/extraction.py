"""What can be extracted how, and the queue of extraction jobs as tables.

The state is two tables: records (one per content object) and jobs (an append-only log; `seq` is its order). Each
step is a join and a projection over all its rows at once; ids and times are the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.text import filled, let, one_of, text, text_or

# fixed values: the states a record can be in
PROCESSING = ("discovered", "downloaded", "extraction_pending", "extracted", "extraction_failed", "unsupported_for_extraction", "chunked", "notion_enriched", "automation_ready", "blocked")
EXTRACTION = ("not_started", "pending", "extracted", "failed", "unsupported", "not_applicable")
NORMALIZATION = ("not_started", "normalized", "failed", "not_applicable")
ENRICHMENT = ("not_started", "pending", "notion_enriched", "failed", "not_applicable")
READINESS = ("discovered", "downloaded", "extraction_pending", "extracted", "chunked", "notion_enriched", "automation_ready", "unsupported_for_extraction", "blocked")
JOB_STATUSES = ("queued", "processing", "completed", "failed", "unsupported")
NATIVE_TYPES = ("canvas_page", "assignment", "syllabus", "module_resource")
EXTRACTABLE = (*NATIVE_TYPES, "file_artifact")
VERSION = "phase4-v1"
HISTORY = 80

# fixed values: kinds of files by extension and media type
_IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "svg", "heic", "heif", "tif", "tiff")
_KIND_BY_EXT = {"pdf": "pdf", "docx": "docx", "doc": "legacy_word", "txt": "txt", "text": "txt", "html": "html_file", "htm": "html_file", "ppt": "slides", "pptx": "slides", "xls": "spreadsheet", "xlsx": "spreadsheet", "csv": "spreadsheet", **dict.fromkeys(_IMAGES, "image")}
_KIND_BY_MIME = {"application/pdf": "pdf", urls.MIME["docx"]: "docx", "text/plain": "txt", "text/html": "html_file", "application/xhtml+xml": "html_file"}
_METHOD = {"pdf": "pdfjs_text_v1", "docx": "mammoth_docx_v1", "html_file": "html_file_dom_v1", "txt": "plain_text_v1"}
_REASON = {
    "legacy_word": "Legacy .doc extraction is not supported in Phase 4.", "slides": "Slide deck extraction is not supported yet.", "spreadsheet": "Spreadsheet extraction is not supported yet.",
    "image": "Image extraction/OCR is not supported yet.",
}


def _of(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def kind_of_extension(ext: Column) -> Column:
    e = F.lower(text(ext))
    return F.when(e == "", "").otherwise(F.coalesce(_of(_KIND_BY_EXT, e), F.lit("unknown_binary")))


def kind_of_mime(mime: Column) -> Column:
    m = F.lower(F.split(text(mime), ";")[0])
    return F.coalesce(_of(_KIND_BY_MIME, m), F.when(m.startswith("text/"), "txt").when(m.startswith("image/"), "image"), F.lit(""))


def descriptor(content_type: Column, ext: Column, mime: Column, has_body: Column) -> Column:
    """(supported, source_category, artifact_kind, method, fetch_mode, reason)."""
    return let(F.struct(text_or(kind_of_mime(mime), kind_of_extension(ext), F.lit("unknown_binary")).alias("kind"), ext.alias("ext"), text(content_type).alias("t")), lambda x: _described(x["kind"], x["ext"], x["t"], has_body))


def _described(kind: Column, ext: Column, t: Column, has_body: Column) -> Column:
    s = lambda *v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in zip(v, ("supported", "source_category", "artifact_kind", "method", "fetch_mode", "reason"))])
    native = s(True, "canvas_native_html", "canvas_native_html", "canvas_html_dom_v1", F.when(has_body, "inline_html").otherwise("fetch_html"), "")
    known = s(True, kind, kind, F.coalesce(_of(_METHOD, kind), F.lit("")), F.when(kind.isin("txt", "html_file"), "fetch_text").otherwise("fetch_binary"), "")
    binary = F.when(filled(ext), F.concat(F.lit("Unsupported binary file type: ."), F.lower(ext), F.lit("."))).otherwise("Unsupported binary file type.")
    reason = F.when(kind == "unknown_binary", binary).otherwise(F.coalesce(_of(_REASON, kind), F.lit("Source is not supported for extraction.")))
    other = s(False, "unsupported", kind, "", "none", reason)
    external = s(False, "unsupported", "external_resource", "", "none", "External resource metadata is tracked, but body extraction is not supported.")
    none = s(False, "unsupported", "not_applicable", "", "none", "This normalized record type does not participate in Phase 4 extraction.")
    missing = s(False, "unsupported", "unknown", "", "none", "Record is missing normalized content metadata.")
    return F.when(t == "", missing).when(t.isin(*NATIVE_TYPES), native).when((t == "file_artifact") & kind.isin(*_METHOD), known).when(t == "file_artifact", other).when(t == "external_resource", external).otherwise(none)


def normalize_records(raw: DataFrame) -> DataFrame:
    """Records with closed states and defaults. Columns that are missing get their defaults."""
    have = set(raw.columns)
    c = lambda name, kind="string": F.col(name) if name in have else F.lit(None).cast(kind)
    n = lambda name: F.coalesce(c(name, "int").cast("int"), F.lit(0)).alias(name)
    return raw.select(
        text(c("content_object_id")).alias("content_object_id"), one_of(c("processing_state"), PROCESSING, "discovered").alias("processing_state"), one_of(c("extraction_status"), EXTRACTION, "not_started").alias("extraction_status"),
        one_of(c("normalization_status"), NORMALIZATION, "not_started").alias("normalization_status"), one_of(c("enrichment_status"), ENRICHMENT, "not_started").alias("enrichment_status"), text(c("extraction_method")).alias("extraction_method"),
        text_or(text(c("extraction_version")), F.lit(VERSION)).alias("extraction_version"), text(c("extracted_text")).alias("extracted_text"), n("word_count"), n("char_count"), n("heading_count"), n("chunk_count"),
        F.coalesce(c("chunk_ids", "array<string>"), F.array().cast("array<string>")).alias("chunk_ids"), text(c("unsupported_reason")).alias("unsupported_reason"), text(c("failure_reason")).alias("failure_reason"),
        F.coalesce(c("automation_ready", "boolean"), F.lit(False)).alias("automation_ready"), c("updated_at", "timestamp").alias("updated_at"),
    )


def recover_queue(jobs: DataFrame) -> DataFrame:
    """The queue after a crash: what was being processed is queued again; the first job of each object stays."""
    first = F.row_number().over(Window.partitionBy("content_object_id").orderBy("seq"))
    queue = jobs.where(filled(F.col("content_object_id"))).withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(one_of(F.col("status"), JOB_STATUSES, "queued")))
    return queue.withColumn("__n", first).where("__n = 1").drop("__n")


def enqueue(records: DataFrame, state: DataFrame, queue: DataFrame, force: bool = False) -> DataFrame:
    """records with `outcome`: skipped, unsupported or enqueued. records: (content_object_id, supported, seq, ...)."""
    done = (F.col("extraction_status") == "extracted") | F.col("processing_state").isin("chunked", "notion_enriched", "automation_ready")
    known = state.select("content_object_id", F.coalesce(done, F.lit(False)).alias("__done"))
    queued = queue.select("content_object_id").distinct().withColumn("__queued", F.lit(True))
    joined = records.join(known, "content_object_id", "left").join(queued, "content_object_id", "left")
    again = F.row_number().over(Window.partitionBy("content_object_id").orderBy("seq")) > 1
    outcome = (
        F.when(~filled(text("content_object_id")), "skipped").when(~F.col("supported"), "unsupported").when(F.lit(not force) & F.coalesce("__done", F.lit(False)), "skipped")
        .when(F.coalesce("__queued", F.lit(False)) | again, "skipped").otherwise("enqueued")
    )
    return joined.withColumn("outcome", outcome).drop("__done", "__queued")


def upsert_records(state: DataFrame, patches: DataFrame, keys: tuple[str, ...] = ("content_object_id",)) -> DataFrame:
    """The state with patches (one row per key; null: leave as is) applied to their keys; new keys are added."""
    p = patches.select(*keys, *[F.col(c).alias(f"__{c}") for c in patches.columns if c not in keys])
    joined = state.join(p, list(keys), "full")
    return joined.select(*[F.col(c) if c in keys or f"__{c}" not in joined.columns else F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in state.columns])


def finish(queue: DataFrame, finished: DataFrame) -> tuple[DataFrame, DataFrame]:
    """finished: (job_id, status, last_error, seq). The queue without these jobs, and their rows for the history."""
    left = queue.join(finished.select("job_id"), "job_id", "left_anti")
    done = queue.drop("status", "last_error", "seq").join(finished, "job_id")
    return left, done


def history(log: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The newest entry of each job, newest first, at most `keep`."""
    newest = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    return log.withColumn("__n", newest).where("__n = 1").drop("__n").orderBy(F.desc("seq")).limit(keep)


def readiness(enrichment: Column, chunk_count: Column, processing: Column, ready: Column, base: Column) -> Column:
    """The readiness that follows from extraction, else the record's own."""
    auto = lambda other: F.when(ready, "automation_ready").otherwise(other)
    return (
        F.when(enrichment == "notion_enriched", auto("notion_enriched")).when((chunk_count > 0) | (processing == "chunked"), auto("chunked")).when(processing == "unsupported_for_extraction", "unsupported_for_extraction")
        .when(processing == "extraction_failed", "blocked").when(processing.isin("extracted", "downloaded", "extraction_pending"), processing).otherwise(one_of(base, READINESS, "discovered"))
    )


def merge_state(inventory: DataFrame, records: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """The inventory with its extraction state: from the record where there is one, else the row's own or a default.
    chunks: (content_object_id, chunk_index, chunk_id)."""
    r = normalize_records(records)
    r = r.select("content_object_id", *[F.col(c).alias(f"x_{c}") for c in r.columns if c != "content_object_id"])
    out = inventory.join(r, "content_object_id", "left")
    if chunks is not None:
        per = chunks.groupBy("content_object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("x_listed"))
        out = out.join(per, "content_object_id", "left")
    else:
        out = out.withColumn("x_listed", F.lit(None).cast("array<string>"))
    base = lambda name, otherwise: F.coalesce(F.col(name), F.lit(otherwise)) if name in inventory.columns else F.lit(otherwise)
    listed = F.coalesce(F.size("x_listed"), F.lit(0))
    n_chunks = F.when(F.coalesce("x_chunk_count", F.lit(0)) > 0, F.col("x_chunk_count")).otherwise(F.greatest(listed, F.lit(0)))
    ready = F.coalesce(F.col("x_automation_ready") | ((F.col("x_chunk_count") > 0) & (F.col("x_extraction_status") == "extracted")), F.lit(False))
    zero = lambda name: F.coalesce(F.col(f"x_{name}"), F.lit(0)).alias(name)
    blank = lambda name: F.coalesce(F.col(f"x_{name}"), F.lit("")).alias(name)
    ids = F.when(F.size("x_chunk_ids") > 0, F.col("x_chunk_ids")).otherwise(F.coalesce("x_listed", F.array().cast("array<string>")))
    state = [
        F.coalesce("x_processing_state", base("processing_state", "discovered")).alias("processing_state"), F.coalesce("x_extraction_status", base("extraction_status", "not_started")).alias("extraction_status"),
        F.coalesce("x_normalization_status", F.lit("not_started")).alias("normalization_status"), F.coalesce("x_enrichment_status", F.lit("not_started")).alias("enrichment_status"), blank("extraction_method"),
        F.coalesce("x_extraction_version", F.lit(VERSION)).alias("extraction_version"), blank("extracted_text"), zero("word_count"), zero("char_count"), zero("heading_count"), n_chunks.alias("chunk_count"), ids.alias("chunk_ids"),
        text_or("x_unsupported_reason", base("unsupported_reason", ""), F.lit("")).alias("unsupported_reason"), blank("failure_reason"), ready.alias("automation_ready"),
        readiness(F.col("x_enrichment_status"), n_chunks, F.col("x_processing_state"), ready, base("content_readiness_state", "discovered")).alias("content_readiness_state"),
    ]
    names = {"processing_state", "extraction_status", "normalization_status", "enrichment_status", "extraction_method", "extraction_version", "extracted_text", "word_count", "char_count", "heading_count", "chunk_count", "chunk_ids", "unsupported_reason", "failure_reason", "automation_ready", "content_readiness_state"}
    out = out.withColumn("x_chunk_ids", F.coalesce("x_chunk_ids", F.array().cast("array<string>")))
    return out.select(*[c for c in inventory.columns if c not in names], *state)


def summary(records: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of counts over extractable records; pending is what is queued or processed."""
    ready = F.coalesce("automation_ready", F.lit(False)) | (F.col("content_readiness_state") == "automation_ready")
    counts = records.where(F.col("content_type").isin(*EXTRACTABLE)).agg(
        F.count("*").alias("total"), F.count_if(F.col("extraction_status") == "extracted").alias("extracted"), F.count_if(F.col("extraction_status") == "failed").alias("failed"),
        F.count_if(F.col("extraction_status") == "unsupported").alias("unsupported"), F.count_if((F.col("chunk_count") > 0) | (F.col("processing_state") == "chunked")).alias("chunked"),
        F.count_if((F.col("enrichment_status") == "notion_enriched") | (F.col("processing_state") == "notion_enriched")).alias("enriched"), F.count_if(ready).alias("automation_ready"),
    ).withColumn("one", F.lit(1))
    pending = queue.agg(F.count_if(F.col("status").isin("queued", "processing")).alias("pending")).withColumn("one", F.lit(1))
    return counts.join(F.broadcast(pending), "one").drop("one")
