"""What automations write: definitions, outputs, artifacts and result summaries in one form, and their titles and headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.dates import range_label
from quillmill.functions.text import distinct_texts, filled, one_of, text, text_or

# fixed values: the allowed values of each field; the first is the default where none is named
OUTPUT_TYPES = ("overview", "recap", "study_seed")
SCOPES = ("workspace", "course")
SOURCES = ("content", "tasks", "both")
WINDOWS = ("weekly", "rolling", "custom")
CADENCES = ("manual", "weekly")
ARTIFACT_TYPES = ("overview", "recap", "digest", "study_seed")
STATUSES = ("idle", "planning", "collecting", "generating", "writing", "completed", "failed", "blocked")


def _maybe(c: Column | str) -> Column:
    return F.nullif(text(c), F.lit(""))


def definitions(raw: DataFrame) -> DataFrame:
    """raw: (automation_id, slug, name, description, enabled, output_type, target_scope, input_sources, window_type, cadence)."""
    slug = text(F.coalesce(text_or("slug", "automation_id"), F.lit("")))
    return raw.select(
        text(F.coalesce(text_or("automation_id", slug), F.lit(""))).alias("automation_id"), slug.alias("slug"), text_or(text("name"), slug, F.lit("Automation")).alias("name"), text("description").alias("description"), F.coalesce("enabled", F.lit(True)).alias("enabled"),
        one_of(F.col("output_type"), OUTPUT_TYPES, "overview").alias("output_type"), one_of(F.col("target_scope"), SCOPES, "workspace").alias("target_scope"), one_of(F.col("input_sources"), SOURCES, "content").alias("input_sources"),
        one_of(F.col("window_type"), WINDOWS, "weekly").alias("window_type"), one_of(F.col("cadence"), CADENCES, "manual").alias("cadence"),
    )


def find(defs: DataFrame, automation_id: str) -> DataFrame:
    return defs.where(F.col("automation_id") == automation_id).limit(1)


def output_id(run_id: Column, suffix: Column) -> Column:
    return F.concat_ws(":", text(run_id), text_or(text(suffix), F.lit("output")))


def title(name: Column, start: Column, end: Column, suffix: Column | None = None) -> Column:
    """The definition's name and what it is about, or the window."""
    return F.concat(name, F.lit(" · "), text_or(F.lit(None).cast("string") if suffix is None else suffix, range_label(start, end)))


def short_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMM d"), F.lit("Unknown date"))


def envelopes(raw: DataFrame, now: Column, *keep: str) -> DataFrame:
    """Outputs joined with their runs (run_* columns) in one form: the output's own values before the run's."""
    return raw.select(
        *keep, text("output_id").alias("output_id"), text("run_run_id").alias("run_id"), text("automation_id").alias("automation_id"), _maybe("course_id").alias("course_id"), distinct_texts(F.col("related_course_ids")).alias("related_course_ids"), distinct_texts(F.col("course_names")).alias("course_names"),
        text_or(text("title"), F.lit("Automation Output")).alias("title"), text("summary").alias("summary"), one_of(F.col("artifact_type"), ARTIFACT_TYPES, "overview").alias("artifact_type"),
        one_of(text_or("target_scope", "run_target_scope"), SCOPES, "workspace").alias("target_scope"), text("run_window_start").alias("window_start"), text("run_window_end").alias("window_end"), F.coalesce("source_count", F.lit(0)).alias("source_count"), text_or(text("created_at"), now).alias("created_at"), now.alias("updated_at"),
    )


def artifact(output: Column, kind: Column, content: Column, is_text: Column) -> Column:
    """(output_id, artifact_type, content): content that is no text comes as JSON already and stays; missing content is {}."""
    return F.struct(text(output).alias("output_id"), one_of(kind, ARTIFACT_TYPES, "overview").alias("artifact_type"), F.when(is_text, F.coalesce(content, F.lit(""))).otherwise(text_or(content, F.lit("{}"))).alias("content"))


def headline(name: Column, written: Column, window: Column, error: Column) -> Column:
    told = F.concat(name, F.lit(" wrote "), written.cast("string"), F.when(written == 1, " output for ").otherwise(" outputs for "), window, F.lit("."))
    return text_or(error, told)


def summaries(runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per run (run_id, automation_id, status, name, window, error, updated_at, tasks, content): its headline and counts.
    outputs: (run_id, output_id, title, written)."""
    per = outputs.groupBy("run_id").agg(F.count("*").alias("output_count"), F.count_if("written").alias("written_count"))
    out = runs.join(per, "run_id", "left").na.fill(0, ["output_count", "written_count"])
    return out.select(
        text("automation_id").alias("automation_id"), text("run_id").alias("run_id"), one_of(F.col("status"), STATUSES, "idle").alias("status"), headline(F.col("name"), F.col("written_count"), F.col("window"), F.col("error")).alias("headline"), "output_count", "written_count",
        "tasks", "content", (F.col("tasks") + F.col("content")).alias("total"), "updated_at",
    )


def latest(summaries_: DataFrame, defaults: tuple[str, ...]) -> DataFrame:
    """The newest summary of each automation, default automations first and in their order, then by id."""
    newest = summaries_.groupBy("automation_id").agg(F.max_by(F.struct(*[c for c in summaries_.columns if c != "automation_id"]), F.struct("updated_at", "run_id")).alias("s"))
    place = F.array_position(F.array(*[F.lit(d) for d in defaults]), F.col("automation_id"))
    return newest.select("automation_id", "s.*", F.when(place > 0, place).otherwise(len(defaults) + 1).cast("int").alias("place"))


def metadata(**values: Column) -> Column:
    """A JSON text of what an output is from, in the given order, nulls included."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in values.items()]), {"ignoreNullFields": "false"})


def enhance(outputs: DataFrame, hook=None, enabled: bool = False) -> tuple[DataFrame, bool]:
    """The outputs through a hook (frame to frame) where one is given and enabled, and whether it was used."""
    return (hook(outputs), True) if enabled and hook is not None else (outputs, False)
