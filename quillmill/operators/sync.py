"""Keyed, incremental upserts into a target by way of a table of what was sent before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import filled, text, text_or
from quillmill.operators.dedupe import first_filled

MAX_UPLOAD = 20 * 1024 * 1024


def content_key(stable: bool = False) -> Column:
    """What has to change for a row to be sent again. With `stable` only its content counts, not the enrichment
    status, which sending changes itself."""
    parts = [
        text_or("content_hash", "source_url", "source_page_url", F.lit("")), text_or("extraction_status", F.lit("not_started")), text_or("enrichment_status", F.lit("not_started")), F.coalesce("chunk_count", F.lit(0)).cast("string"),
        F.when(filled(text("extracted_text")), "has_text").otherwise("no_text"), text_or(text("extraction_method"), F.lit("no_method")),
    ]
    return text(F.concat_ws("|", *([parts[0], *parts[3:]] if stable else parts)))


def actions(rows: DataFrame, state: DataFrame, target: DataFrame, stable: bool = False) -> DataFrame:
    """rows with `action`: skipped, updated (a page is known, or the target has the key) or created, and the new
    `status`. state: (object_id, page_id, content_hash, last_status); target: (object_id)."""
    s = state.select("object_id", F.col("page_id").alias("__page"), F.col("content_hash").alias("__hash"), F.col("last_status").alias("__last"))
    t = target.select("object_id").distinct().withColumn("__there", F.lit(True))
    file = F.col("content_type") == "file_artifact"
    sent = F.when(file, F.col("__last") == "artifact_attached").otherwise(F.col("__last").isin("notion_created", "notion_updated"))
    same = filled(text("__page")) & (text("__hash") == F.col("content_key")) & sent
    known = filled(text("__page"))
    has_text = filled(text("extracted_text"))
    status = (
        F.when(file & has_text, "notion_enriched").when(file, "artifact_pending").when(F.col("content_path_type") == "direct_ingest", F.when(has_text, "notion_enriched").when(known, "notion_updated").otherwise("notion_created"))
        .when(F.col("content_type") == "external_resource", F.when(known, "notion_updated").otherwise("notion_created")).otherwise("planned")
    )
    joined = rows.withColumn("content_key", content_key(stable)).join(s, "object_id", "left").join(t, "object_id", "left")
    action = F.when(F.coalesce(same, F.lit(False)), "skipped").when(known | F.coalesce("__there", F.lit(False)), "updated").otherwise("created")
    return joined.withColumn("action", action).withColumn("status", F.when(F.col("action") == "skipped", F.col("__last")).otherwise(status)).withColumn("page_id", text_or("__page", F.concat(F.lit("page:"), "object_id"))).drop("__page", "__hash", "__last", "__there")


def with_misses(plans: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planned rows found in the inventory, and a message for each that is not."""
    found = plans.select(F.col("content_object_id").alias("object_id")).join(inventory.withColumnRenamed("content_object_id", "object_id"), "object_id")
    missed = plans.join(inventory.select("content_object_id"), "content_object_id", "left_anti")
    return found, missed.select("content_object_id", F.concat(F.lit("Missing content inventory for "), "content_object_id", F.lit(".")).alias("message"))


def next_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """The state after sending: rows that were sent replace their old ones."""
    new = done.where("action <> 'skipped'").select("object_id", "page_id", F.col("content_key").alias("content_hash"), F.col("status").alias("last_status"))
    return state.join(new.select("object_id"), "object_id", "left_anti").select("object_id", "page_id", "content_hash", "last_status").unionByName(new)


def counts(done: DataFrame) -> DataFrame:
    return done.groupBy("action").agg(F.count("*").alias("n"))


def final_status(done: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: completed, partially_completed or failed."""
    ok = done.agg(F.count("*").alias("ok")).withColumn("one", F.lit(1))
    bad = failed.agg(F.count("*").alias("bad")).withColumn("one", F.lit(1))
    return ok.join(F.broadcast(bad), "one").select(F.when(F.col("bad") == 0, "completed").when(F.col("ok") > 0, "partially_completed").otherwise("failed").alias("status"))


def attachment_status(size: Column, uploaded: Column) -> Column:
    return F.when(filled(uploaded), "artifact_attached").when(size > MAX_UPLOAD, "artifact_pending").otherwise("artifact_attached")


def batches(blocks: DataFrame, by: str, order: str, size: int = 100) -> DataFrame:
    """Numbers each row's batch of `size` within its page."""
    return blocks.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def overlay(defaults: DataFrame, stored: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows replace defaults of the same key as a whole; the given keys come first, in order, then others."""
    both = defaults.withColumn("__p", F.lit(1)).unionByName(stored.withColumn("__p", F.lit(0)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(key).orderBy("__p"))
    at = F.array_position(F.array(*[F.lit(x) for x in order]).cast("array<string>"), F.col(key).cast("string"))
    return both.withColumn("__n", first).where("__n = 1").drop("__n", "__p").withColumn("position", F.when(at > 0, at).otherwise(len(order) + 1).cast("int"))


def first_by_priority(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """For each key the value of the first part that has it."""
    rows = [p.select(key, value).withColumn("seq", F.lit(i)) for i, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(key).agg(first_filled(value))
