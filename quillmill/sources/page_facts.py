"""What a course page says of itself: title, due date, module, readable text, folders of its files, and the courses
that a dashboard lists.

A page is parsed to rows of nodes once (nodes.py); what is chosen from them, and in which order of preference, are joins and
aggregations by page. Null pages give empty texts, no due date and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.text import SPACE, collapse, filled, is_script_gate, text, units
from quillmill.session import stored
from quillmill.sources.html import NOISE_TAGS
from quillmill.sources.nodes import as_outer, below, classes, closest, first_texts, hits, is_a, node_rows, texts_of

# fixed values: where pages keep what, as CSS selectors in order of preference
TITLE_AT = ("h1.page-title", ".header-bar h1", ".page-header h1", "main h1", "h1")
MODULE_AT = (".context_module .ig-header-title", ".context_module h2", "#context_modules .header-bar", "#context_modules h2")
CONTENT_AT = {
    "pages": (".show-content", ".page-body", "#wiki_page_show .user_content", ".user_content", "main .content-box"),
    "assignments": (".assignment-description .user_content", ".assignment-description", "#assignment_show .user_content", ".description.user_content", ".user_content"),
    "syllabus": ("#syllabus .user_content", "#syllabus_body", ".syllabus .user_content", ".user_content", "#syllabus"),
    "home": ("#course_show_primary .user_content", "#content .show-content", ".show-content", ".user_content", "main .content-box"),
    "modules": ("#context_modules", ".context_modules", ".context_module", "#modules"),
}
CONTENT_ELSE_AT = ("main", "#content", ".ic-Layout-contentMain", ".content-box", ".user_content")
COURSE_NAME_AT = ("[data-course-name]", ".course-title", "#course_show_secondary h1", ".ic-app-nav-toggle-and-crumbs h1", ".page-header h1", ".ellipsible", "#breadcrumbs li:last-child")
# fixed values: classes of what surrounds the content
CHROME_CLASSES = ("ic-app-nav-toggle-and-crumbs", "header-bar", "page-toolbar", "page-action-list", "edit-content", "al-trigger-container", "ui-dialog", "screenreader-only", "sr-only")
FILE_ROW_AT = (".ef-item-row", ".files-folder", ".ic-Table-row", "[data-testid='file-row']", "tr")
CRUMBS_AT = (".breadcrumbs a", ".ef-folder-content__path a")
CARD_AT = (".ic-DashboardCard", ".course-list-table-row", "[data-testid='dashboard-course-card']", "tr", "li", ".item")
CARD_NAME_AT = ("[data-course-name]", ".ic-DashboardCard__header-title", ".course-list-course-title", ".name", "strong", "h1", "h2", "h3")
CARD_TERM_AT = ("[data-term]", ".course-list-term", ".term", ".ic-DashboardCard__header-subtitle", ".course-term", "[data-testid='course-term']")
NO_COURSE_NAMES = ("grades", "modules", "files", "pages", "assignments", "home", "syllabus", "announcements", "more options")
TERM_WORDS = r"(?i)\b(term|semester|quarter|fall|spring|summer|winter)\b"
# fixed values: elements that end a line
LINE_TAGS = (
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td",
    "th", "tr", "ul",
)
# fixed values: link labels that name a section
SECTION_LABELS = {"modules": "modules", "module": "modules", "assignments": "assignments", "assignment": "assignments", "pages": "pages", "page": "pages", "files": "files", "file": "files", "syllabus": "syllabus", "home": "home"}


def _tidy(c: Column) -> Column:
    """Single blanks, no blanks at line ends, at most one blank line."""
    for find, put in (("\u00a0", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        c = F.regexp_replace(c, find, put)
    return F.btrim(c, F.lit(" \t\n\r\f\x0b\ufeff"))


def _is_chrome() -> Column:
    return F.col("tag").isin(*NOISE_TAGS, "head", "title") | F.arrays_overlap(classes(), F.array(*[F.lit(c) for c in CHROME_CLASSES])) | (F.coalesce(F.col("attrs")["aria-hidden"], F.lit("")) == "true") | F.col("attrs")["hidden"].isNotNull()


def readable(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, body_text) of one span per page (page_id, start, end): text with a line per block, links as "label (href)", images by their alternative
    text. An item gets a bullet if blocks inside it have ended its line already. Page chrome below the root is left out.

    What is said and what ends a line are events in document order; an end says something only right after a text, which is a lag."""
    span = as_outer(roots).withColumnRenamed("o_start", "r_start").withColumnRenamed("o_end", "r_end").withColumnRenamed("page_id", "r_page")
    inside = nodes.join(span, (F.col("page_id") == F.col("r_page")) & F.col("start").between(F.col("r_start"), F.col("r_end"))).drop("r_page", "r_end")
    lower = F.col("start") > F.col("r_start")
    hidden = as_outer(inside.where(lower & (F.col("tag") != "#text") & _is_chrome())).withColumn("own", F.lit(True))
    links = as_outer(inside.where(F.col("tag") == "a")).withColumn("own", F.lit(False))  # a link speaks for all below it
    shut = hidden.unionByName(links).withColumnRenamed("page_id", "o_page")
    shown = inside.join(shut, (F.col("page_id") == F.col("o_page")) & (F.col("start") <= F.col("o_end")) & ((F.col("o_start") < F.col("start")) | F.col("own") & (F.col("o_start") == F.col("start"))), "left_anti").drop("text").join(inside.where("tag = '#text'").select("page_id", "start", "text"), ["page_id", "start"], "left")
    labels = texts_raw(nodes, shown.where("tag = 'a'").select("page_id", "start", "end"))
    shown = shown.join(labels, ["page_id", "start"], "left")
    attr = lambda a: F.coalesce(F.col("attrs")[a], F.lit(""))
    label, alt = _tidy(F.coalesce("label", F.lit(""))), _tidy(attr("alt"))
    piece = (
        F.when(F.col("tag") == "#text", _tidy(F.col("text"))).when(F.col("tag") == "br", F.lit("\n")).when(F.col("tag") == "a", F.concat(label, F.when((label != "") & (attr("href") != ""), F.concat(F.lit(" ("), attr("href"), F.lit(")"))).otherwise("")))
        .when(F.col("tag") == "img", F.when(alt != "", F.concat(F.lit("[Image: "), alt, F.lit("]"))))
    )
    said = shown.withColumn("piece", piece).where(F.coalesce("piece", F.lit("")) != "").select("page_id", F.struct(F.col("start").alias("at"), F.lit(0).alias("late"), F.lit(0).alias("inner")).alias("order"), "piece", F.lit(None).cast("int").alias("item"), F.lit(None).cast("int").alias("item_end"))
    item = F.col("tag") == "li"
    ends = shown.where(F.col("tag").isin(*LINE_TAGS)).select("page_id", F.struct(F.col("end").alias("at"), F.lit(1).alias("late"), (-F.col("start")).alias("inner")).alias("order"), F.lit(None).cast("string").alias("piece"), F.when(item, F.col("start")).alias("item"), F.when(item, F.col("end")).alias("item_end"))
    by_page = Window.partitionBy("page_id").orderBy("order")
    events = said.unionByName(ends).withColumn("prior", F.lag("piece").over(by_page))
    events = events.withColumn("said", F.coalesce("piece", F.when(F.col("prior").isNotNull() & (F.col("prior") != "\n"), F.lit("\n"))))
    spoken = events.where("said is not null").select("page_id", "order", "said")
    items = events.where("item is not null and said is null").select(F.col("page_id").alias("i_page"), "item", F.col("order").alias("item_order"))
    marked = items.join(spoken, (F.col("i_page") == F.col("page_id")) & (F.col("order.at") >= F.col("item")) & (F.col("order") < F.col("item_order"))).groupBy("page_id", "item").agg(F.min("order").alias("order"))
    bullets = marked.groupBy("page_id", "order").agg(F.count("*").cast("int").alias("bullets"))
    lines = spoken.join(bullets, ["page_id", "order"], "left").withColumn("said", F.concat(F.repeat(F.lit("• "), F.coalesce("bullets", F.lit(0))), "said"))
    joined = lines.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "said"))), lambda x: x["said"]), " ").alias("t"))
    blank = f"{SPACE}*"
    return joined.select("page_id", _tidy(F.regexp_replace(F.regexp_replace("t", f"•{SPACE}+", "• "), f"{blank}\n{blank}", "\n")).alias("body_text"))


def texts_raw(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(page_id, start, label): all text below, as it is."""
    t = nodes.where("tag = '#text'").select("page_id", "start", F.col("text").alias("t"))
    return below(t, as_outer(spans)).groupBy("page_id", F.col("o_start").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "t"))), lambda x: x["t"]), "").alias("label")).withColumnRenamed("at", "start")


def sanitized_title(title: Column, otherwise: Column) -> Column:
    """The title, or the other one where it is empty or a notice that scripts are off."""
    return F.when(filled(collapse(title)) & ~is_script_gate(title), collapse(title)).otherwise(collapse(otherwise))


def facts(pages: DataFrame, section: Column, fallback_title: Column) -> DataFrame:
    """Of pages (page_id, url, html), page_id once: page_id, url, title, due_date, week_or_module, body_text, content_type."""
    kinds = {"assignments": "assignment", "syllabus": "syllabus", "modules": "module_resource"}
    kind = F.coalesce(*[F.when(F.col("section") == s, k) for s, k in kinds.items()], F.lit("canvas_page"))
    own = pages.withColumn("__s", section).withColumn("__o", fallback_title).select("page_id", "url", "html", F.col("__s").alias("section"), F.col("__o").alias("other"))
    nodes = stored(node_rows(own))
    sections = own.select("page_id", "section")
    uses = {"title": TITLE_AT, "module": MODULE_AT, "due": ("time[datetime]",), "head": ("title",), "else": CONTENT_ELSE_AT} | {f"at {k}": v for k, v in CONTENT_AT.items()}
    found = stored(hits(nodes, uses))
    of = lambda use: found.where(F.col("use") == use)
    title = first_texts(nodes, of("title"), ["page_id"]).withColumnRenamed("text", "h")
    head = texts_of(nodes, of("head").groupBy("page_id").agg(F.min_by(F.struct("start", "end"), "start").alias("n")).select("page_id", "n.*")).select("page_id", F.regexp_replace("text", f"{SPACE}+\\|{SPACE}+.+$", "").alias("head"))
    module = first_texts(nodes, of("module"), ["page_id"]).withColumnRenamed("text", "module")
    due = of("due").select("page_id", "start", text(F.col("attrs")["datetime"]).alias("d")).where("d <> ''").groupBy("page_id").agg(F.min_by("d", "start").alias("due_date"))
    places = found.where(F.col("use").startswith("at ")).join(sections, "page_id").where(F.col("use") == F.concat(F.lit("at "), "section")).drop("section").unionByName(of("else").withColumn("pref", F.col("pref") + 100))
    nth = F.row_number().over(Window.partitionBy("page_id", "pref").orderBy("start"))
    held = texts_of(nodes, places.withColumn("__n", nth).where("__n = 1").select("page_id", "pref", "start", "end")).where(filled(F.col("text"))).groupBy("page_id").agg(F.min_by(F.struct("start", "end"), "pref").alias("c"))
    roots = nodes.where("start = 0").select("page_id", "start", "end").join(held, "page_id", "left").select("page_id", F.coalesce("c.start", "start").alias("start"), F.coalesce("c.end", "end").alias("end"))
    out = own.drop("html")
    for part in (title, head, module, due, readable(nodes, roots)):
        out = out.join(part, "page_id", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        "page_id", "url", sanitized_title(F.coalesce("h", "head"), F.col("other")).alias("title"), "due_date", F.when(F.col("section") == "modules", blank("module")).otherwise("").alias("week_or_module"), blank("body_text").alias("body_text"), kind.alias("content_type")
    )


def folder_hint(section: Column, row_text: Column, crumbs: Column) -> Column:
    """Of a file's row: the path below the first crumb, else what follows "Folder:" in the row; null outside of files."""
    named = text(F.regexp_extract(row_text, r"(?i)Folder:" + SPACE + r"*(.+)$", 1))
    below = F.array_join(F.slice(crumbs, 2, F.greatest(F.size(crumbs), F.lit(1))), "/")
    return F.when((section == "files") & filled(row_text), F.when(F.size(crumbs) > 1, below).otherwise(F.nullif(named, F.lit(""))))


def file_name(label: Column, href: Column) -> Column:
    """A label with an extension names the file; else the link's path does, and the label where that has no name."""
    return F.when(filled(urls.extension(label)), text(label)).otherwise(F.coalesce(F.nullif(urls.file_name(urls.parts(href)), F.lit("")), text(label)))


def file_links(pages: DataFrame, section: Column) -> DataFrame:
    """Of pages (page_id, url, html), page_id once: page_id, ord, href, label, file_name, folder_hint, a row for each link."""
    own = pages.withColumn("__s", section).select("page_id", "url", "html", F.col("__s").alias("section"))
    nodes = stored(node_rows(own))
    found = stored(hits(nodes, {"row": FILE_ROW_AT, "crumb": CRUMBS_AT}))
    anchors = nodes.where(is_a("a[href]")).select("page_id", "start", "end", F.col("attrs")["href"].alias("href"))
    anchors = closest(texts_of(nodes, anchors), found.where("use = 'row'")).withColumnRenamed("text", "label")
    rows = texts_of(nodes, anchors.where("o_start is not null").select("page_id", F.col("o_start").alias("start"), F.col("o_end").alias("end")).distinct()).select("page_id", F.col("start").alias("o_start"), F.col("text").alias("row_text"))
    trail = texts_of(nodes, found.where("use = 'crumb'").select("page_id", "start", "end").distinct()).where(filled(F.col("text")))
    crumbs = trail.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]).alias("crumbs"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("start")) - 1
    out = anchors.withColumn("ord", nth.cast("int")).join(rows, ["page_id", "o_start"], "left").join(crumbs, "page_id", "left").join(own.select("page_id", "section"), "page_id")
    out = out.withColumns({"href": text("href"), "row_text": F.coalesce("row_text", F.lit("")), "crumbs": F.coalesce("crumbs", F.array().cast("array<string>"))})
    return out.select("page_id", "ord", "href", "label", file_name(F.col("label"), F.col("href")).alias("file_name"), folder_hint(F.col("section"), F.col("row_text"), F.col("crumbs")).alias("folder_hint"))


def course_name(names: Column) -> Column:
    """The first name, on one line, that is not the name of a page of each course; null if there is none."""
    return F.get(F.filter(F.transform(names, collapse), lambda n: (n != "") & ~F.lower(n).isin(*NO_COURSE_NAMES)), F.lit(0))


def dashboard_courses(pages: DataFrame) -> DataFrame:
    """Of pages (page_id, url, html), page_id once: a row per page, host and course: the longest name (the first of equals) and the first term."""
    nodes = stored(node_rows(pages.select("page_id", "url", "html")))
    found = stored(hits(nodes, {"card": CARD_AT, "name": CARD_NAME_AT, "term": CARD_TERM_AT}))
    anchors = nodes.where(is_a("a[href*='/courses/']") & F.col("attrs")["#url"].isNotNull()).select("page_id", "start", "end", "parent", "attrs")
    above = nodes.select("page_id", F.col("start").alias("parent"), F.col("end").alias("p_end"))
    anchors = closest(texts_of(nodes, anchors), found.where("use = 'card'")).join(above, ["page_id", "parent"], "left")
    anchors = stored(anchors.withColumns({"c_start": F.coalesce("o_start", "parent"), "c_end": F.coalesce("o_end", "p_end")}).drop("o_start", "o_end"))
    cards = anchors.select("page_id", F.col("c_start").alias("o_start"), F.col("c_end").alias("o_end")).distinct()

    def within(use: str) -> DataFrame:
        got = below(found.where(F.col("use") == use), cards)
        return first_texts(nodes, got, ["page_id", "o_start"], ("data-course-name", "data-term")).select("page_id", F.col("o_start").alias("c_start"), F.col("text").alias(use))

    near = texts_of(nodes, below(nodes.where(F.col("tag").isin("td", "span", "div", "p")).select("page_id", "start", "end"), cards)).where(F.col("text").rlike(TERM_WORDS))
    near = near.groupBy("page_id", F.col("o_start").alias("c_start")).agg(F.min_by("text", "start").alias("near"))
    rows = anchors
    for part in (within("name"), within("term"), near):
        rows = rows.join(part, ["page_id", "c_start"], "left")
    a, blank = F.col("attrs"), lambda c: F.coalesce(c, F.lit(""))
    names = F.array(blank("name"), blank(a["aria-label"]), blank(a["title"]), blank("text"))
    rows = rows.select("page_id", F.col("start").alias("seq"), urls.parts(a["#url"]).alias("p"), course_name(names).alias("name"), F.coalesce("term", "near", F.lit("")).alias("term"))
    rows = rows.withColumn("course_id", urls.course_id(F.col("p"))).where(filled(F.col("course_id")) & F.col("name").isNotNull())
    return rows.groupBy("page_id", F.col("p.origin").alias("origin"), "course_id").agg(
        F.min_by("name", F.struct(-units(F.col("name")), "seq")).alias("course_name"), F.min_by(urls.course_home(F.col("p"), F.col("course_id")), "seq").alias("course_url"), F.min_by("term", F.when(filled(F.col("term")), F.col("seq"))).alias("term")
    )


def course_pages(pages: DataFrame) -> DataFrame:
    """Of pages (page_id, url, html) of a course, page_id once: page_id, origin, course_id, course_name (null if the page tells none), section (of the
    page itself), and nav, where each section's first link of the same course leads; home leads to the course itself if no link does.
    Pages outside of courses are left out."""
    p = F.col("p")
    at = pages.select("page_id", "url", "html", urls.parts(F.col("url")).alias("p")).where(urls.course_id(p).isNotNull())
    at = at.select("page_id", F.concat(p["origin"], F.lit("/")).alias("url"), "html", p["origin"].alias("origin"), urls.course_id(p).alias("course_id"), urls.section(p, urls.course_id(p)).alias("section"))
    nodes = stored(node_rows(at))
    own = at.drop("html", "url")
    name = first_texts(nodes, hits(nodes, {"course": COURSE_NAME_AT}), ["page_id"]).withColumnRenamed("text", "course_name")
    links = texts_of(nodes, nodes.where(is_a("a[href]") & F.col("attrs")["#url"].isNotNull()).select("page_id", "start", "end", F.col("attrs")["#url"].alias("to")))
    links = links.join(own.select("page_id", "origin", "course_id"), "page_id").withColumn("l", urls.parts(F.col("to"))).where(urls.in_course(F.col("l"), F.col("origin"), F.col("course_id")))
    label = F.create_map(*[F.lit(x) for kv in SECTION_LABELS.items() for x in kv])[F.lower("text")]
    links = links.withColumn("to_section", F.coalesce(urls.section(F.col("l"), F.col("course_id")), label)).where("to_section is not null")
    first = links.groupBy("page_id", "to_section").agg(F.min_by("to", "start").alias("to"))
    nav = first.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("to_section", "to"))).alias("nav"))  # an entry per section
    home = F.create_map(F.lit("home"), F.concat("origin", F.lit("/courses/"), "course_id"))
    nav_of = F.coalesce("nav", F.create_map().cast("map<string,string>"))
    out = own.join(name, "page_id", "left").join(nav, "page_id", "left")
    return out.select("page_id", "origin", "course_id", "course_name", "section", F.when(F.map_contains_key(nav_of, "home"), nav_of).otherwise(F.map_concat(nav_of, home)).alias("nav"))
