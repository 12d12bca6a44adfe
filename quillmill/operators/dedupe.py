"""Identity keys and dedupe with field-by-field merging.

Every input carries `seq`, the order of discovery, each number once. dedupe_content() and merge_courses() are plain
aggregations, primary_key_dedupe() too, for inputs whose file ids agree with their URLs. dedupe_documents() follows aliases in
order; see there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.text import filled, is_script_gate, let, text_or
from quillmill.session import stored


def document_identity(docs: DataFrame) -> DataFrame:
    """Adds canonical_url, file_id, scope (origin and course) and key."""
    u = urls.parts(F.col("url"))
    out = docs.withColumn("canonical_url", F.coalesce(text_or("canonical_url", let(u, urls.canonical)), F.lit("")))
    out = out.withColumn("file_id", text_or("file_id", let(u, urls.file_id)))
    origin = urls.parts(text_or("source_page_url", "url"))["origin"]
    out = out.withColumn("scope", F.concat_ws(":", F.coalesce(origin, F.lit("")), text_or("course_id", F.lit("unknown-course"))))
    name = urls.normal_file_name(text_or("file_name", "link_text", let(u, urls.file_name)))
    key = lambda kind, c: F.concat_ws(":", F.lit(kind), F.col("scope"), c)
    return out.withColumn("key", F.when(filled(F.col("canonical_url")), key("url", F.col("canonical_url"))).when(F.col("file_id").isNotNull(), key("file", F.col("file_id"))).otherwise(key("name", name)))


def content_identity(items: DataFrame) -> DataFrame:
    """Adds canonical_url and key: course, type, and URL or else title."""
    url = let(urls.parts(text_or("external_url", "source_page_url")), urls.canonical)
    scope = F.concat_ws(":", text_or("course_id", F.lit("unknown-course")), text_or("content_type", F.lit("content")))
    title = urls.normal_file_name(text_or("source_page_title", "title", "course_name", F.lit("content")))
    return items.withColumn("canonical_url", url).withColumn("key", F.concat_ws(":", F.lit("content"), scope, text_or(url, title)))


def longest(c: str) -> Column:
    """The longest text; of equal ones the first."""
    v = F.col(c)
    return F.coalesce(F.max_by(v, F.when(filled(v), F.struct(F.length(v), -F.col("seq")))), F.max_by(v, -F.col("seq"))).alias(c)


def first_filled(c: str) -> Column:
    v = F.col(c)
    return F.min_by(v, F.when(v.isNotNull() & (v.cast("string") != ""), F.col("seq"))).alias(c)


def last_filled(c: str) -> Column:
    v = F.col(c)
    return F.max_by(v, F.when(v.isNotNull() & (v.cast("string") != ""), F.col("seq"))).alias(c)


def best_title(c: str) -> Column:
    """As longest(), but a text that stands for missing content loses against any other, even an empty one."""
    v = F.col(c)
    return F.max_by(v, F.struct(~is_script_gate(v), F.length(F.coalesce(v, F.lit(""))), -F.col("seq"))).alias(c)


def best_section(c: str = "source_section") -> Column:
    return F.min_by(F.col(c), F.struct(urls.section_priority(F.col(c)), F.col("seq"))).alias(c)


def dedupe_content(items: DataFrame) -> DataFrame:
    """One row per identity: longest texts, the last hash, the first due date; `merged` counts what was merged in."""
    keyed = content_identity(items)
    texts = [c for c in ("course_name", "title", "body_html", "body_text", "excerpt", "week_or_module") if c in items.columns]
    firsts = [c for c in ("id", "course_id", "content_type", "source_page_url", "due_date", "external_url", "discovered_at") if c in items.columns]
    aggs = [best_section(), best_title("source_page_title"), *map(longest, texts), *map(first_filled, firsts), last_filled("content_hash"), F.max(F.coalesce("is_external", F.lit(False))).alias("is_external")]
    out = keyed.groupBy("key").agg(*aggs, F.min("seq").alias("seq"), (F.count("*") - 1).alias("merged"))
    return out.withColumn("id", text_or("id", "key"))


def merge_courses(courses: DataFrame) -> DataFrame:
    """One row per course: the longest name, other fields as first given."""
    named = courses.withColumn("course_name", text_or("course_name", F.concat(F.lit("Course "), F.col("course_id"))))
    rest = [c for c in named.columns if c not in ("course_id", "course_name", "seq")]
    return named.groupBy("course_id").agg(longest("course_name"), *map(first_filled, rest), F.min("seq").alias("seq"))


_TEXTS = ("course_name", "file_name", "link_text", "folder_hint")

def primary_key_dedupe(docs: DataFrame) -> DataFrame:
    """One row per primary key, merged as in dedupe_documents()."""
    return _merge(document_identity(docs))


#: Neighbouring numbers of seq that are looked through at a time for one file id.
SPAN = 100_000


def _last_url_before(rows: DataFrame) -> DataFrame:
    """rows: (scope, file_id, seq, key, url), url null where a row has no URL. Adds `before`, the last URL key among earlier rows of the
    file id, and `known`, whether there is any earlier row. A file id of very many rows is looked through in spans of seq, and
    the spans' last rows hand on what came before."""
    rows = rows.withColumn("span", F.floor(F.col("seq") / SPAN))
    by, inside = ["scope", "file_id"], Window.partitionBy("scope", "file_id", "span").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*by, "span").agg(F.max_by("url", F.when(F.col("url").isNotNull(), F.col("seq"))).alias("last"))
    earlier = Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*by, "span", F.last("last", ignorenulls=True).over(earlier).alias("carried"), (F.count("*").over(earlier) > 0).alias("had"))
    near = rows.withColumn("near", F.last("url", ignorenulls=True).over(inside)).withColumn("nth", F.count("*").over(inside))
    out = near.join(carried, [*by, "span"])
    return out.withColumn("before", F.coalesce("near", "carried")).withColumn("known", F.col("had") | (F.col("nth") > 0)).drop("near", "nth", "carried", "had", "span")


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given by (node, parent), one row per node that has a parent, by pointer doubling: there are as many
    rounds as the logarithm of its depth."""
    at = stored(parents.select("node", F.col("parent").alias("root")))
    while True:
        jump = at.select(F.col("node").alias("n"), F.col("root").alias("r"))
        step = stored(at.join(jump, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        at = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return at


def alias_groups(keyed: DataFrame) -> DataFrame:
    """`keyed` (of document_identity()) with `key` replaced by that of the group that each row joins.

    In order of seq a row joins the group of the first of its names (URL, file id) that is known, else it founds one, and then all its
    names stand for that group; groups that exist apart stay apart. So an URL's group is settled where the URL first comes up: by
    the row's file id if that is known by then, and what a file id stands for is the group of the URL it last came with. That makes every
    URL point to an earlier URL (or to a file id that came without one) or to nothing: a forest, whose roots are the groups.
    Pointers come from a window over rows of one file id, roots from pointer doubling; nothing is folded row by row."""
    filed = keyed.where("file_id is not null")
    if not filed.limit(1).count():
        return keyed
    has_url = filled(F.col("canonical_url"))
    rows = stored(_last_url_before(filed.select("scope", "file_id", "seq", "key", F.when(has_url, F.col("key")).alias("url"))))
    file_key = F.concat_ws(":", F.lit("file"), "scope", "file_id")
    first = keyed.where(has_url).groupBy("key").agg(F.min("seq").alias("seq"), F.min_by("file_id", "seq").alias("file_id")).where("file_id is not null").select("seq")
    parents = rows.where("known and url is not null").join(first, "seq", "left_semi").select(F.col("key").alias("node"), F.coalesce("before", file_key).alias("parent"))
    roots = _roots(parents.where("node <> parent"))
    bare = rows.where("url is null and before is not null").select(F.col("seq").alias("__seq"), F.col("before").alias("__before"))
    named = keyed.join(bare, F.col("seq") == F.col("__seq"), "left").withColumn("key", F.coalesce("__before", "key")).drop("__seq", "__before")
    return named.join(roots, F.col("key") == F.col("node"), "left").withColumn("key", F.coalesce("root", "key")).drop("node", "root")


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """One row per document under any of its names (URL, file id, file name) within its course scope. The id
    (`key`) is that of the group's first row, even where a hosted row later replaces the URL."""
    return _merge(alias_groups(document_identity(docs)))


def _merge(keyed: DataFrame) -> DataFrame:
    hosted = F.coalesce("is_hosted", F.lit(False))
    host = F.struct(~hosted, F.col("seq"))
    ordered = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("v")))), lambda x: x["v"]), filled))
    return keyed.groupBy("key").agg(
        first_filled("course_id"), best_section(), best_title("source_page_title"), *map(longest, _TEXTS), F.min_by("url", host).alias("url"), F.min_by("canonical_url", host).alias("canonical_url"), first_filled("file_id"),
        F.max(hosted).alias("is_hosted"), F.max(F.coalesce("is_downloadable", F.lit(False))).alias("is_downloadable"), F.min(F.coalesce("is_external", F.lit(False))).alias("is_external"),
        ordered("source_section").alias("seen_in_sections"), ordered("source_page_url").alias("source_page_urls"), first_filled("discovered_at"), F.min("seq").alias("seq"), (F.count("*") - 1).alias("merged"),
    )


def by_section_and_name(docs: DataFrame) -> DataFrame:
    name = F.collate(text_or("file_name", "link_text", "url"), "UNICODE")
    return docs.orderBy(urls.section_priority(F.col("source_section")), name, "seq")
