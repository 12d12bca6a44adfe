"""Digests over tasks and content: windows, scopes, groups by course, counts, topics and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import dates, render
from quillmill.functions.text import STOPWORDS, collapse, filled, is_useful_phrase, phrase, text, text_or, title_case, title_segments, type_label

URGENT_MS = 2 * 24 * 3600 * 1000


def in_scope(course: Column, courses: list[str]) -> Column:
    """Rows of the given courses; rows without course always; all rows if none is given."""
    return F.lit(True) if not courses else (~filled(course) | course.isin(*courses))


def course_key(items: DataFrame) -> DataFrame:
    """Adds course_key and course_label: by id, or by name where the id is empty."""
    label = text_or(text("course_name"), text("course_id"), F.lit("Unassigned Course"))
    return items.withColumn("course_label", label).withColumn("course_key", text_or(text("course_id"), F.concat(F.lit("course:"), label)))


def tasks(rows: DataFrame, now: Column, preset: str = "current_week", courses: list[str] | None = None, gaps: int = 20) -> tuple[DataFrame, DataFrame]:
    """Tasks that fall due in the window, and the first `gaps` tasks by name that have no due date. `due` is text."""
    timed = dict(rows.dtypes)["due_date"] == "timestamp"  # then the window reaches the scan
    scoped = rows.where(in_scope(F.col("course_id"), courses or [])).withColumn("due", F.col("due_date") if timed else dates.parse(F.col("due_date")))
    due = scoped.where(F.col("due").between(*dates.window(now, preset)))
    missing = scoped.where(F.col("due_date").isNull() if timed else ~filled(text("due_date"))).orderBy(F.collate("title", "UNICODE"), "seq").limit(gaps)
    return due, missing


def is_urgent(due: Column, now: Column) -> Column:
    """Due within two days, or overdue."""
    return F.coalesce(F.unix_millis(due) - F.unix_millis(now) <= URGENT_MS, F.lit(False))


def tasks_by_course(due: DataFrame, now: Column) -> DataFrame:
    """course_id, course_name, due_count, urgent_count, first_due."""
    return course_key(due).groupBy("course_key").agg(
        F.min_by(F.nullif(text("course_id"), F.lit("")), "seq").alias("course_id"), F.min_by("course_label", "seq").alias("course_name"), F.count("*").alias("due_count"), F.count_if(is_urgent(F.col("due"), now)).alias("urgent_count"), F.min("due").alias("first_due")
    ).drop("course_key")


def references(urgent: DataFrame, due: DataFrame, missing: DataFrame, limit: int = 80) -> DataFrame:
    """Urgent tasks, tasks and gaps one after another, repeats kept, at most `limit`."""
    parts = [df.select("content_object_id", "seq").withColumn("part", F.lit(i)) for i, df in enumerate((urgent, due, missing))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("part", "seq").limit(limit)


def snippet(*fields: str) -> Column:
    return F.substring(collapse(text_or(*fields)), 1, 240)


def counts_by_type(content: DataFrame) -> DataFrame:
    """course_key, course_name, items, counts_by_type (map)."""
    per = course_key(content).groupBy("course_key", text_or("content_type", F.lit("unknown")).alias("type")).agg(F.min_by("course_label", "seq").alias("label"), F.min("seq").alias("seq"), F.count("*").alias("n"))
    return per.groupBy("course_key").agg(F.min_by("label", "seq").alias("course_name"), F.sum("n").alias("items"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts_by_type"))


def overview(content: DataFrame) -> DataFrame:
    """One row for all and one per course: grain, course_key, items, courses."""
    keyed = course_key(content).groupBy("course_key").agg(F.count("*").alias("items"))
    whole = keyed.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.count("*").alias("courses")).select(F.lit("workspace").alias("grain"), F.lit(None).cast("string").alias("course_key"), "items", "courses")
    return whole.unionByName(keyed.select(F.lit("course").alias("grain"), "course_key", "items", F.lit(1).cast("long").alias("courses")))


def bullets(content: DataFrame, limit: int = 8) -> DataFrame:
    """The first items of each course as lines: title, type and snippet."""
    s = snippet("text_snippet", "title")
    line = F.concat(F.col("title"), F.lit(" ("), type_label(F.col("content_type")), F.lit(")"))
    line = F.when((s != "") & (s != F.col("title")), F.concat(line, F.lit(" - "), s)).otherwise(line)
    nth = F.row_number().over(Window.partitionBy("course_key").orderBy("seq"))
    return course_key(content).withColumn("n", nth).where(F.col("n") <= limit).select("course_key", "n", line.alias("bullet"))


def ranked_phrases(content: DataFrame, k: int = 6, collated: bool = True) -> DataFrame:
    """course_key, rank, phrase, normalized, score: title segments count 3, module segments 2, headings 4, segments of
    the snippet 1. Of the forms of a phrase the longest is its label, the first on ties."""
    keyed = course_key(content).withColumn("__snippet", snippet("text_snippet", "title"))
    headings = F.col("headings") if "headings" in content.columns else F.array().cast("array<string>")
    module = F.col("week_or_module") if "week_or_module" in content.columns else F.lit("")
    none = F.array().cast("array<string>")

    def weigh(parts: Column, weight: int) -> Column:
        return F.transform(parts, lambda p: F.struct(p.alias("text"), F.lit(weight).alias("weight")))

    weighted = F.concat(weigh(title_segments(F.col("title")), 3), weigh(title_segments(module), 2), weigh(F.coalesce(headings, none), 4), weigh(title_segments(F.col("__snippet")), 1))
    rows = keyed.select("course_key", "seq", F.posexplode(weighted).alias("pos", "p")).select("course_key", "seq", "pos", "p.text", "p.weight").withColumn("normalized", phrase(F.col("text")))
    scored = rows.where(is_useful_phrase(F.col("normalized"))).groupBy("course_key", "normalized").agg(
        F.sum("weight").alias("score"), text(F.min_by("text", F.struct(-F.length("text"), F.col("seq"), F.col("pos")))).alias("phrase")
    )
    label = F.collate("phrase", "UNICODE") if collated else F.col("phrase")
    nth = F.row_number().over(Window.partitionBy("course_key").orderBy(F.desc("score"), label, "normalized"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k).select("course_key", "rank", "phrase", "normalized", "score")


def ranked_tokens(content: DataFrame, k: int = 10, phrases: DataFrame | None = None) -> DataFrame:
    """course_key, rank, token, label, score: how often each word of four letters or more occurs in title, headings and
    snippet. Words within one of the course's `phrases` are left out before ranking."""
    headings = F.array_join(F.col("headings"), " ") if "headings" in content.columns else F.lit("")
    words = F.split(phrase(F.concat_ws(" ", "title", headings, snippet("text_snippet", "title"))), " ")
    rows = course_key(content).select("course_key", F.explode(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS))).alias("token"))
    counted = rows.groupBy("course_key", "token").agg(F.count("*").alias("score"))
    if phrases is not None:
        taken = phrases.groupBy("course_key").agg(F.collect_list("normalized").alias("__taken"))  # a few per course
        counted = counted.join(taken, "course_key", "left").where(~F.coalesce(F.exists("__taken", lambda p: p.contains(F.col("token"))), F.lit(False))).drop("__taken")
    nth = F.row_number().over(Window.partitionBy("course_key").orderBy(F.desc("score"), "token"))
    return counted.withColumn("rank", nth).where(F.col("rank") <= k).select("course_key", "rank", "token", title_case(F.col("token")).alias("label"), "score")


# fixed values: prefixes of lines that tell where a text is from
PROVENANCE = ("Source page:", "Canvas URL:", "Source section:", "Synced at:", "Extraction:", "Artifact attached", "Artifact not attached", "External resource:")


def page_context(blocks: DataFrame, prefixes: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """Per page of ordered blocks (page_id, ord, type, text): up to 12 headings, a snippet of the first three texts (700
    characters), and the body (6000)."""
    kept = blocks.where(filled(text("text")) & ~F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: text("text").startswith(p)))
    head = F.col("type").isin("heading_1", "heading_2", "heading_3") & (F.col("text") != "Extracted Content")
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "text")))), lambda x: x["text"])
    return kept.groupBy("page_id").agg(ordered(head).alias("h"), ordered(~head).alias("t")).select(
        "page_id", F.slice("h", 1, 12).alias("headings"), F.substring(F.array_join(F.slice("t", 1, 3), " "), 1, 700).alias("snippet"), F.substring(F.array_join("t", "\n"), 1, 6000).alias("body_text")
    )


def recaps(content: DataFrame, topics: int = 6) -> DataFrame:
    """One row per course as it is written out: course_key, summary, body_html."""
    keyed = course_key(content)
    refs = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", "title", "course_label", "content_type"))), 1, 40), lambda r: F.struct(r["title"].alias("title"), r["course_label"].alias("course_name"), r["content_type"].alias("content_type"), F.lit("").alias("date"), F.lit("").alias("url")))
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("course_key").orderBy("seq")))
    head = first.where(F.col("__n") <= 40).groupBy("course_key").agg(refs.alias("refs"))
    sizes = keyed.groupBy("course_key").agg(F.count("*").alias("items"), F.min_by("course_label", "seq").alias("course_name"))
    listed = bullets(content).groupBy("course_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "bullet"))), lambda b: b["bullet"]).alias("bullets"))
    ranked = ranked_phrases(content, topics).groupBy("course_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda p: p["phrase"]).alias("topics"))
    rows = sizes.join(head, "course_key", "left").join(listed, "course_key", "left").join(ranked, "course_key", "left")
    summary = F.concat(F.col("items").cast("string"), F.lit(" content items summarized for "), "course_name", F.lit("."))
    return rows.select("course_key", summary.alias("summary"), render.recap_html(summary, F.col("bullets"), F.col("topics"), F.col("refs")).alias("body_html"))


def course_seed(content: DataFrame) -> DataFrame:
    """One row: the first course by name, its topics, terms and key items."""
    keyed = course_key(content)
    first = keyed.groupBy("course_key").agg(F.min_by("course_label", "seq").alias("name")).orderBy(F.collate("name", "UNICODE"), "course_key").limit(1)
    own = content.join(keyed.join(F.broadcast(first), "course_key").select("seq"), "seq")
    phrases = ranked_phrases(own, 8)
    tokens = ranked_tokens(own, 10, phrases)
    ordered = lambda df, c: df.groupBy("course_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]).alias(c))
    return first.join(ordered(phrases, "phrase"), "course_key", "left").join(ordered(tokens, "label"), "course_key", "left").select("course_key", "name", F.col("phrase").alias("major_topics"), F.col("label").alias("study_concepts"))
