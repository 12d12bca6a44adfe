"""Frontier scans over crawled pages and their link table: hop by hop, in order of discovery, nothing visited twice. scan() is one
scan of a few pages; scan_courses() runs any number of courses at a time, each with a quota of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.text import let, text_or
from quillmill.session import stored

MAX_PAGES = 250


def seeds(courses: DataFrame) -> DataFrame:
    """(course_id, seq, url, section): the six section pages of each course in fixed order."""
    # fixed values: where sections lie below a course
    at = {"files": "/files", "modules": "/modules", "pages": "/pages", "assignments": "/assignments", "syllabus": "/assignments/syllabus", "home": ""}
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.concat("course_url", F.lit(p)).alias("url")) for s, p in at.items()])
    return courses.select("course_id", F.posexplode(rows).alias("seq", "s")).select("course_id", "seq", "s.url", "s.section")


def scan(start: DataFrame, links: DataFrame, limit: int = MAX_PAGES) -> DataFrame:
    """(url, hop, pos): the first `limit` pages that are discovered from start (url, seq) by links (src, dst, ord), first come,
    first served, however many hops away. Each hop reads the link table once, against the pages of the last one; what is
    kept at a time is at most `limit` rows, so it is collected as the next hop's literal frame."""
    spark = start.sparkSession
    schema = "url string, hop int, pos int"
    first = start.select("url", "seq" if "seq" in start.columns else F.lit(0).alias("seq")).where("url is not null").groupBy("url").agg(F.min("seq").alias("seq"))
    rows = [(r.url, 0, i + 1) for i, r in enumerate(first.orderBy("seq", "url").limit(limit).collect())]
    seen, frontier = list(rows), rows
    while frontier and len(seen) < limit:
        at = F.broadcast(spark.createDataFrame(frontier, schema).select(F.col("url").alias("src"), "pos"))
        known = F.broadcast(spark.createDataFrame(seen, schema).select(F.col("url").alias("dst")))
        found = links.join(at, "src").where("dst is not null").join(known, "dst", "left_anti").groupBy("dst").agg(F.min(F.struct("pos", "ord")).alias("by"))
        new = found.orderBy("by", "dst").limit(limit - len(seen)).collect()
        frontier = [(r.dst, frontier[0][1] + 1, len(seen) + i + 1) for i, r in enumerate(new)]
        seen += frontier
    return spark.createDataFrame(seen, schema)


def queued(courses: DataFrame) -> DataFrame:
    """(course_id, seq, url, section), what a course's scan starts with: its six section pages in fixed order, the links of its own
    navigation (`nav`, section to URL) in their place where it has them, then the page it was found on (`current_url`)."""
    out = seeds(courses)
    if "nav" in courses.columns:
        nav = courses.select("course_id", F.explode("nav").alias("section", "__nav"))
        out = out.join(nav, ["course_id", "section"], "left").withColumn("url", text_or("__nav", "url")).drop("__nav")
    out = out.select("course_id", "seq", "url", "section")
    if "current_url" in courses.columns:
        at = F.coalesce(let(urls.parts(F.col("current_url")), lambda p: urls.section(p, F.col("course_id"))), F.lit("home"))
        out = out.unionByName(courses.where("current_url <> ''").select("course_id", F.lit(1000).alias("seq"), F.col("current_url").alias("url"), at.alias("section")))
    return out


#: Pages that a scan holds on the driver, as literal frames; beyond that they are tables.
FEW = 20_000
_PAGE = "course_id string, url string, section string, hop int, pos long"


class _Pages:
    """The pages that were visited, hop by hop."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.rows, self.tables = spark, [], []

    def add(self, hop: DataFrame) -> DataFrame | None:
        """The hop's pages as a frame that is computed already; None if there are none."""
        if not self.tables:
            rows = hop.limit(FEW + 1 - len(self.rows)).collect()
            if len(self.rows) + len(rows) <= FEW:
                self.rows += rows
                return self.spark.createDataFrame(rows, _PAGE) if rows else None
            if self.rows:
                self.tables.append(stored(self.spark.createDataFrame(self.rows, _PAGE)))
        out = stored(hop)
        self.tables.append(out)
        return out if out.limit(1).count() else None

    def frame(self) -> DataFrame:
        out = self.tables[0] if self.tables else self.spark.createDataFrame(self.rows, _PAGE)
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out


def scan_courses(courses: DataFrame, start: DataFrame, links: DataFrame, failed: DataFrame | None = None, limit: int = MAX_PAGES) -> DataFrame:
    """(course_id, url, section, hop, pos, error): for each course the first `limit` pages that are discovered from its start pages
    (course_id, url, section, seq), first come, first served.

    courses: (course_id, origin). links: (src, dst, ord, kind) by canonical URL; kind `follow` stays within the course, `page` (of a
    listing that goes on) is followed anywhere and keeps the section it was found in. failed: (url, error), pages that could not be read:
    they are visited, with their error, and lead nowhere, and other pages and courses go on.

    A hop is one job for all courses, with the links of the pages found in the hop before; hops end when nobody finds anything. Where a page
    lies within its course is the row's rank, cut at what the course has left of its quota. Visited pages are literal frames while
    they are few (counted), and beyond that a table for each hop.

    Defined cases: null URLs and links are no pages; a page that several pages link to counts where it was found first; courses without start
    pages have no rows; a course that comes twice has one scan."""
    spark = start.sparkSession
    homes = stored(courses.groupBy("course_id").agg(F.min("origin").alias("origin")))
    told = lambda p: F.struct(p["origin"].alias("origin"), urls.course_id(p).alias("course"), urls.section(p, urls.course_id(p)).alias("section"))
    links = stored(links.where("src is not null and dst is not null").select("src", "dst", "ord", "kind", let(urls.parts(F.col("dst")), told).alias("to")))
    bad = None if failed is None else stored(failed.groupBy(F.col("url").alias("bad")).agg(F.min("error").alias("error")))
    by = Window.partitionBy("course_id").orderBy("by", "url")
    seen = _Pages(spark)
    first = start.where("url is not null and course_id is not null").groupBy("course_id", "url").agg(F.min("seq").cast("long").alias("by"), F.min_by("section", "seq").alias("section"))
    found, hop = first.withColumn("had", F.lit(0)), 0
    while True:
        kept = found.withColumn("pos", (F.row_number().over(by) + F.col("had")).cast("long")).where(F.col("pos") <= limit)
        new = seen.add(kept.select("course_id", "url", "section", F.lit(hop).alias("hop"), "pos"))
        if new is None:
            break
        frontier = new.select("course_id", F.col("url").alias("src"), F.col("section").alias("from"), "pos")
        if bad is not None:
            frontier = frontier.join(bad, F.col("src") == F.col("bad"), "left_anti")
        inside = (F.col("kind") == "page") | F.coalesce((F.col("to.course") == F.col("course_id")) & (F.col("to.origin") == F.col("origin")), F.lit(False))
        out = links.join(frontier, "src").join(homes, "course_id").where(inside)
        out = out.withColumn("section", F.when(F.col("kind") == "page", F.col("from")).otherwise(F.coalesce("to.section", "from")))
        out = out.groupBy("course_id", F.col("dst").alias("url")).agg(F.min(F.struct("pos", "ord")).alias("by"), F.min_by("section", F.struct("pos", "ord")).alias("section"))
        all_ = seen.frame()
        had = all_.groupBy("course_id").agg(F.count("*").alias("had")).where(F.col("had") < limit)
        found, hop = out.join(had, "course_id").join(all_.select("course_id", "url"), ["course_id", "url"], "left_anti"), hop + 1
    seen = seen.frame()
    error = F.lit(None).cast("string")
    if bad is not None:
        seen, error = seen.join(bad, F.col("url") == F.col("bad"), "left"), F.concat(F.lit("Scan failed for "), "url", F.lit(": "), "error")
    return seen.select("course_id", "url", "section", "hop", F.col("pos").cast("int").alias("pos"), error.alias("error"))


def outcomes(courses: DataFrame, scanned: DataFrame) -> DataFrame:
    """A row per course: pages visited, errors, and status: error if no page of it could be read, completed else."""
    per = scanned.groupBy("course_id").agg(F.count("*").alias("pages_visited"), F.count("error").alias("errors"))
    out = courses.select("course_id").distinct().join(per, "course_id", "left").na.fill(0, ["pages_visited", "errors"])
    return out.withColumn("status", F.when(F.col("pages_visited") > F.col("errors"), "completed").otherwise("error"))
