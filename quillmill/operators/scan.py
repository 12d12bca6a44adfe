"""The state of a scan over many courses: courses in their order, progress per course, and what the whole scan comes to.

Progress is a log of patches (course_id, seq, ...): a course's row is its starting row with, column by column, the
last patch that is not null. That is an aggregation, however the log was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.text import filled, text, text_or

COUNTS = ("pages_visited", "document_count", "duplicate_count", "downloadable_count", "external_count", "ignored_count")


def prepared(courses: DataFrame) -> DataFrame:
    """Scan courses: their id told from the URL if it is missing, a name, the map nav (section to URL), and the section of their
    own URL where none is given."""
    p = urls.parts(F.col("course_url"))
    course_id = text_or(text("course_id"), urls.course_id(p))
    out = courses.withColumn("course_id", course_id).withColumn("course_name", text_or(text("course_name"), F.concat(F.lit("Course "), "course_id")))
    return out.withColumn("nav", F.coalesce("nav", F.create_map().cast("map<string,string>"))).withColumn("section", text_or("section", urls.section(p, F.col("course_id"))))


def merged(courses: DataFrame) -> DataFrame:
    """One row per course: the longest name (the first of equals), the first term and section, and the nav maps laid over each
    other, later ones on top."""
    first = lambda c: F.min_by(c, F.when(filled(F.col(c)), F.col("seq"))).alias(c)
    rows = courses.groupBy("course_id").agg(F.min_by("course_name", F.struct(-F.length("course_name"), "seq")).alias("course_name"), first("term"), first("section"))
    entries = courses.select("course_id", "seq", F.explode("nav").alias("key", "value")).groupBy("course_id", "key").agg(F.max_by("value", "seq").alias("value"))
    nav = entries.groupBy("course_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("nav"))  # an entry per section
    return rows.join(nav, "course_id", "left").withColumn("nav", F.coalesce("nav", F.create_map().cast("map<string,string>")))


def in_order(courses: DataFrame, order: DataFrame, keep_others: bool = False) -> DataFrame:
    """courses in the order of the ids in `order` (course_id, pos), misses dropped; others are left out or come last, by id."""
    out = courses.join(order.groupBy("course_id").agg(F.min("pos").alias("pos")), "course_id", "left" if keep_others else "inner")
    return out.orderBy(F.col("pos").asc_nulls_last(), "course_id")


def progress(courses: DataFrame, patches: DataFrame) -> DataFrame:
    """A row per course of either side: courses (course_id, course_name) start as queued; patches (course_id, seq, status,
    message, counts) are laid over."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}") for c in ("status", "message", *COUNTS)]
    out = courses.join(patches.groupBy("course_id").agg(*last), "course_id", "full")
    return out.select(
        "course_id", F.coalesce("course_name", "course_id").alias("course_name"), F.coalesce("__status", F.lit("queued")).alias("status"), F.coalesce("__message", F.lit("Queued")).alias("message"), *[F.coalesce(f"__{c}", F.lit(0)).cast("long").alias(c) for c in COUNTS]
    )


def outcome(rows: DataFrame) -> DataFrame:
    """One row for the scan: its counts, and error as its status only if no course was completed. Errors of a course leave the
    others alone."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    done = F.when((F.col("completed") == 0) & (F.col("failed") > 0), "error").when(F.col("waiting") > 0, "scanning").otherwise("completed")
    counts = rows.agg(of("completed").alias("completed"), of("error").alias("failed"), of("queued", "scanning").alias("waiting"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    return counts.withColumn("courses_scanned", F.col("completed") + F.col("failed")).withColumn("status", done)


def page_results(rows: DataFrame, context: DataFrame, by: tuple[str, ...] = ("page_url",)) -> tuple[DataFrame, DataFrame]:
    """rows: (page_url, ok, error, course_id, course_name, title). Good pages with the course of their context (page_url, course_id,
    course_name) where they name none themselves, and bad ones with their message. by: the columns that tell which context is whose,
    where URLs come again. A row stays one row: of several contexts with the same `by` the one with the smallest course id counts."""
    c = context.groupBy(*by).agg(F.min(F.struct("course_id", "course_name")).alias("__c")).select(*by, F.col("__c.course_id").alias("__id"), F.col("__c.course_name").alias("__name"))
    good = rows.where(F.coalesce("ok", F.lit(False))).join(c, list(by), "left").withColumn("course_id", text_or("course_id", "__id")).withColumn("course_name", text_or("course_name", "__name")).drop("__id", "__name", "ok", "error")
    bad = rows.where(~F.coalesce("ok", F.lit(False))).select("page_url", text_or("error", F.lit("Unknown page scan failure.")).alias("error"))
    return good, bad


def is_html(mime: Column) -> Column:
    return F.lower(F.coalesce(mime, F.lit(""))).rlike(r"text/html|application/xhtml\+xml")
