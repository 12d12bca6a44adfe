"""Extraction jobs as a batch: what waits is started, each job ends by itself as completed, unsupported or failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.text import text, text_or

# fixed values: why a job ends without a text
LOST = "Source record no longer participates in extraction."
NO_TEXT = "No extractable text found."


def waiting(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """Queued jobs in order of arrival: all of them, or the next ones."""
    own = queue.where(F.col("status") == "queued").orderBy("seq")
    return own if limit is None else own.limit(limit)


def of_object(queue: DataFrame, objects: DataFrame) -> DataFrame:
    """The jobs of given objects (content_object_id)."""
    return queue.join(objects.select("content_object_id").distinct(), "content_object_id", "left_semi")


def started(queue: DataFrame) -> DataFrame:
    """What was queued is processed, one attempt more."""
    on = F.col("status") == "queued"
    return queue.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + F.when(on, 1).otherwise(0)).withColumn("status", F.when(on, "processing").otherwise(F.col("status")))


def finished(jobs: DataFrame, records: DataFrame, results: DataFrame) -> DataFrame:
    """Every job with its outcome and reason. records: (content_object_id, supported, unsupported_reason); results:
    (content_object_id, extracted_text, error), of jobs that were run (null text: not run). A job whose record is gone is unsupported, one
    error fails one job, and so does a text that is empty or blank."""
    r = records.select("content_object_id", F.col("supported").alias("__ok"), F.col("unsupported_reason").alias("__why"), F.lit(True).alias("__here"))
    x = results.select("content_object_id", F.col("error").alias("__error"), F.col("extracted_text").alias("__text"))
    out = jobs.join(r, "content_object_id", "left").join(x, "content_object_id", "left")
    here = F.coalesce("__here", F.lit(False))
    error = F.coalesce(text_or("__error"), F.when(F.col("__text").isNotNull() & (text("__text") == ""), NO_TEXT))
    status = F.when(~here | ~F.coalesce("__ok", F.lit(False)), "unsupported").when(error.isNotNull(), "failed").when(F.col("__text").isNull(), "queued").otherwise("completed")
    reason = F.when(~here, F.lit(LOST)).when(~F.coalesce("__ok", F.lit(False)), F.coalesce("__why", F.lit(""))).otherwise(F.coalesce(error, F.lit("")))
    return out.withColumn("status", status).withColumn("reason", reason).drop("__ok", "__why", "__here", "__error", "__text")


def extension_of(inferred: Column, file_name: Column, source_url: Column, page_url: Column) -> Column:
    """The inferred extension, else the first that any of the others has."""
    return F.lower(F.coalesce(text_or(text(inferred), urls.extension(file_name), urls.extension(source_url), urls.extension(page_url)), F.lit("")))


def artifacts_of(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """File rows that stand for one of the documents (id) at least."""
    listed = artifacts.select("content_object_id", F.explode("source_document_ids").alias("id")).join(documents.select("id"), "id", "left_semi")
    return artifacts.join(listed.select("content_object_id").distinct(), "content_object_id", "left_semi")


def chunk_records(raw: DataFrame) -> DataFrame:
    """Chunks in one form: texts trimmed, missing numbers 0, a missing document null."""
    texts = ("chunk_id", "chunk_text", "heading_context", "content_object_id", "course_id", "course_name", "content_type", "source_page_title")
    have = lambda c: text(c) if c in raw.columns else F.lit("")
    return raw.select(
        *[have(c).alias(c) for c in texts], F.coalesce(F.col("chunk_index").cast("int"), F.lit(0)).alias("chunk_index"), F.coalesce(F.col("token_estimate").cast("int"), F.lit(0)).alias("token_estimate"), F.nullif(have("source_document_id"), F.lit("")).alias("source_document_id"),
        text_or(have("extraction_version"), F.lit("phase4-v1")).alias("extraction_version"),
    )


def sync_records(documents: DataFrame, known: DataFrame) -> DataFrame:
    """A sync row for every document (id), from the known one (document_id, exported, ready, page_id, last_status) or by default: ready,
    not exported, not started."""
    k = known.select("document_id", *[F.col(c).alias(f"__{c}") for c in ("exported", "ready", "page_id", "last_status")])
    out = documents.select(F.col("id").alias("document_id")).join(k, "document_id", "left")
    return out.select(
        "document_id", F.coalesce("__exported", F.lit(False)).alias("exported"), F.coalesce("__ready", F.lit(True)).alias("ready"), F.nullif("__page_id", F.lit("")).alias("page_id"), text_or("__last_status", F.lit("not_started")).alias("last_status")
    )
