"""Links of pages told apart: files of the course, files elsewhere, pages to follow, outside resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.text import let, stable_hash, text, text_or

# fixed values: hosts that are no resources of a course
NO_RESOURCE_HOSTS = ("facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com")


def file_name_of(label: Column, p: Column) -> Column:
    """The link's text if it ends like a file name, else the name in the URL, else the text."""
    return let(text(label), lambda t: F.when(urls.extension(t) != "", t).otherwise(text_or(urls.file_name(p), t, F.lit(""))))


def classify(links: DataFrame, origin: Column, course: Column) -> DataFrame:
    """links: (url, label, ...). Adds kind (hosted, external, document, ignored; null: no URL), file_name, extension, mime,
    file_id, target_url, canonical_url, is_downloadable."""
    p = F.col("__p")
    out = links.withColumn("__p", urls.parts(F.col("url"))).withColumn("file_id", let(p, urls.file_id)).withColumn("file_name", file_name_of(F.col("label"), p))
    out = out.withColumn("extension", urls.extension(text_or("file_name", "url")))
    same = F.coalesce(p["origin"] == origin, F.lit(False))
    hosted = same & (F.col("file_id").isNotNull() | p["path"].contains(F.concat(F.lit("/courses/"), course, F.lit("/files"))))
    is_doc = urls.is_document(F.col("extension"))
    kind = F.when(p.isNotNull(), F.when(hosted, "hosted").when(is_doc & ~same, "external").when(is_doc, "document").otherwise("ignored"))
    out = out.withColumn("kind", kind)
    target = F.when(F.col("kind") == "hosted", urls.download_url(p, F.col("url"), course, origin)).otherwise(F.col("url"))
    out = out.withColumn("target_url", target).withColumn("canonical_url", let(urls.parts(F.col("target_url")), urls.canonical))
    return out.withColumn("mime", urls.mime_of(F.col("extension"))).withColumn("is_downloadable", F.coalesce(F.col("kind").isin("hosted", "external", "document"), F.lit(False))).drop("__p")


def is_resource(links: DataFrame, origin: Column) -> Column:
    """A link to another site that may be worth keeping: no file, no social network, a label of three characters."""
    host = F.regexp_replace(urls.parts(F.col("url"))["host"], r"^www\.|:\d+$", "")
    outside = F.coalesce(urls.parts(F.col("url"))["origin"] != origin, F.lit(False))
    return outside & ~F.coalesce(host.isin(*NO_RESOURCE_HOSTS), F.lit(False)) & ~urls.is_document(urls.extension(F.col("url"))) & (F.length(text("label")) >= 3)


def follows(url: Column, origin: Column, course: Column, mode: Column) -> Column:
    """Whether a page of this mode leads to that URL in the crawl."""

    def test(p: Column) -> Column:
        at = lambda s: url.endswith(F.concat(F.lit("/courses/"), course, F.lit(f"/{s}")))
        sec = urls.section(p, course)
        go = (
            F.when(mode == "modules", sec.isin("pages", "assignments") | url.contains("/modules/items/")).when(mode == "pages", (sec == "pages") & ~at("pages")).when(mode == "assignments", (sec == "assignments") & ~at("assignments"))
            .when(mode.isin("home", "syllabus"), sec.isin("pages", "assignments")).otherwise(F.lit(False))
        )
        return urls.in_course(p, origin, course) & ~urls.is_ignored_route(p, origin, course) & sec.isNotNull() & go

    return F.coalesce(let(urls.parts(url), test), F.lit(False))


def first_per_page(rows: DataFrame, key: str = "canonical_url") -> DataFrame:
    """The first link of each page to each URL."""
    n = F.row_number().over(Window.partitionBy("page_id", key).orderBy("ord"))
    return rows.where(F.col(key) != "").withColumn("__n", n).where("__n = 1").drop("__n")


def resources(links: DataFrame, origin: Column, course: Column) -> DataFrame:
    """Outside resources of pages (page_id, page_url, ord, url, label), each once a page, as content items."""
    kept = links.where(is_resource(links, origin)).withColumn("canonical_url", let(urls.parts(F.col("url")), urls.canonical))
    own_id = F.concat(F.lit("external:"), stable_hash(F.concat_ws(":", course, "page_url", "canonical_url")))
    return first_per_page(kept).select(own_id.alias("id"), F.lit("external_resource").alias("content_type"), "page_id", F.col("page_url").alias("source_page_url"), F.col("url").alias("external_url"), F.col("label").alias("title"), F.lit(True).alias("is_external"))


def page_stats(classified: DataFrame) -> DataFrame:
    """Per page: links by kind."""
    return classified.groupBy("page_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("hosted", "external", "document", "ignored")], F.count_if(F.col("kind").isNull()).alias("no_url"))
