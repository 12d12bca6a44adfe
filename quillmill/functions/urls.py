"""URLs as Spark columns, for absolute http(s) URLs; relative links are resolved where pages are parsed.

parts() splits an URL once into a struct; the other functions take that struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import SPACE, SPACES, filled, let, text, text_or

# fixed values: sections in order of preference, and their labels
SECTIONS = ("files", "modules", "pages", "assignments", "syllabus", "home")
# fixed values: kinds of documents by extension
CATEGORY = {"pdf": "pdf", "doc": "word", "docx": "word", "html": "text", "htm": "text", "xls": "spreadsheet", "xlsx": "spreadsheet", "ppt": "slides", "pptx": "slides", "txt": "text", "zip": "archive"}
MIME = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "html": "text/html", "htm": "text/html", "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "txt": "text/plain", "zip": "application/zip",
}
# fixed values: query keys that do not tell pages apart
NOISE_KEYS = ("module_item_id", "module_item_redirect", "download_frd", "wrap", "verifier", "persist_headless", "force_user", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
# fixed values: parts of paths that are not crawled
IGNORED_ROUTES = ("/discussion_topics", "/quizzes", "/grades", "/people", "/settings", "/external_tools", "/users", "/announcements")
# fixed values: hosts of the learning platform
HOST_SUFFIXES = ("instructure.com", "canvaslms.com")

_URL = r"^(?i:(https?)):/*([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def parts(url: Column) -> Column:
    """(scheme, host, origin, path, query, fragment) or null. Host and scheme in lower case, default ports dropped."""
    def split(g: Column) -> Column:
        scheme, host = F.lower(g[0]), F.regexp_replace(F.lower(g[1]), "^.*@", "")
        port = F.when(scheme == "https", ":443$|:$").otherwise(":80$|:$")
        path = F.when(g[2] == "", F.lit("/")).otherwise(F.replace(g[2], F.lit(" "), F.lit("%20")))
        return let(F.regexp_replace(host, port, F.lit("")), lambda h: F.struct(scheme.alias("scheme"), h.alias("host"), F.concat(scheme, F.lit("://"), h).alias("origin"), path.alias("path"), g[3].alias("query"), g[4].alias("fragment")))

    def groups(u: Column) -> Column:
        return F.when(u.rlike(_URL), let(F.array(*[F.regexp_extract(u, _URL, i) for i in range(1, 6)]), split))

    return let(F.btrim(url, F.lit(SPACES)), groups)


def decode(c: Column) -> Column:
    """Percent-decoded if that can be done; + stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _decode_query(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def params(p: Column) -> Column:
    """Query parameters as an array of (key, value), decoded."""
    pairs = F.filter(F.split(p["query"], "&"), lambda x: x != "")
    at = lambda x: F.instr(x, "=")
    one = lambda x: F.struct(
        _decode_query(F.when(at(x) > 0, x.substr(F.lit(1), at(x) - 1)).otherwise(x)).alias("key"), _decode_query(F.when(at(x) > 0, x.substr(at(x) + 1, F.length(x))).otherwise(F.lit(""))).alias("value")
    )
    return F.transform(pairs, one)


def param(p: Column, key: str) -> Column:
    return F.get(F.filter(params(p), lambda x: x["key"] == key), F.lit(0))["value"]


def clean_path(path: Column) -> Column:
    single = F.regexp_replace(path, "/{2,}", "/")
    return F.when(F.length(single) > 1, F.regexp_replace(single, "/$", "")).when(single == "", F.lit("/")).otherwise(single)


def canonical(p: Column) -> Column:
    """Without fragment and noise keys, parameters in order, path cleaned; empty if there is no URL."""
    kept = F.filter(params(p), lambda x: ~x["key"].isin(*NOISE_KEYS))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(F.concat_ws(":", x["key"], x["value"]).alias("by"), x["key"].alias("key"), x["value"].alias("value"))))
    query = F.array_join(F.transform(ordered, lambda x: F.concat(F.url_encode(x["key"]), F.lit("="), F.url_encode(x["value"]))), "&")
    return F.coalesce(F.concat(p["origin"], clean_path(p["path"]), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))), F.lit(""))


def course_id(p: Column) -> Column:
    return F.nullif(F.regexp_extract(p["path"], r"/courses/(\d+)(?:/|$)", 1), F.lit(""))


def section(p: Column, course: Column) -> Column:
    """By path below the course. A syllabus lies under assignments and counts as one."""
    root = F.concat(F.lit("/courses/"), F.coalesce(course, course_id(p), F.lit("")))
    rest = clean_path(p["path"].substr(F.length(root) + 1, F.length(p["path"])))
    out = F.when(rest == "/", F.lit("home"))
    for name in ("modules", "pages", "assignments", "files"):
        out = out.when((rest == f"/{name}") | rest.startswith(f"/{name}/"), F.lit(name))
    return F.when(p["path"].startswith(root), out)


def is_dashboard(p: Column) -> Column:
    return clean_path(p["path"]).rlike(r"^/dashboard(/|$)|^/courses/?$|^/search/all_courses(/|$)")


def page_mode(p: Column) -> Column:
    return F.when(course_id(p).isNotNull(), "single_course").when(is_dashboard(p), "dashboard").otherwise("unsupported")


def course_home(p: Column, course: Column) -> Column:
    return F.coalesce(F.concat(p["origin"], F.lit("/courses/"), F.coalesce(course, course_id(p))), F.lit(""))


def is_likely_host(host: Column) -> Column:
    hit = F.lit(False)
    for suffix in HOST_SUFFIXES:
        hit |= (host == suffix) | host.endswith(f".{suffix}")
    return F.coalesce(hit, F.lit(False))


def in_course(p: Column, origin: Column, course: Column) -> Column:
    return F.coalesce((p["origin"] == origin) & (course_id(p) == course), F.lit(False))


def is_ignored_route(p: Column, origin: Column, course: Column) -> Column:
    return in_course(p, origin, course) & p["path"].rlike("|".join(IGNORED_ROUTES))


def file_id(p: Column) -> Column:
    from_path = F.nullif(F.regexp_extract(p["path"], r"/(?:courses/\d+/)?files/(\d+)(?:/|$)", 1), F.lit(""))
    preview = param(p, "preview")
    return F.coalesce(from_path, F.when(preview.rlike("^[0-9]+$"), preview))


def download_url(p: Column, url: Column, course: Column, origin: Column) -> Column:
    own = F.when(p["path"].startswith(F.concat(F.lit("/courses/"), course, F.lit("/files/"))), F.concat(F.lit("/courses/"), course)).otherwise(F.lit(""))
    return F.when(p.isNotNull(), F.when(file_id(p).isNull(), url).otherwise(F.concat(origin, own, F.lit("/files/"), file_id(p), F.lit("/download?download_frd=1"))))


def is_file_preview(p: Column) -> Column:
    return F.coalesce(file_id(p).isNotNull() & (p["path"].contains("/files/") | param(p, "preview").isNotNull()), F.lit(False))


def file_name(p: Column) -> Column:
    """The filename parameter, else the last path segment unless it is a number or "download"."""
    named = F.nullif(param(p, "filename"), F.lit(""))
    last = F.coalesce(F.try_element_at(F.filter(F.split(p["path"], "/"), lambda s: s != ""), F.lit(-1)), F.lit(""))
    told = let(text(decode(last)), lambda n: F.when(n.rlike("^[0-9]+$") | (n == "download"), "").otherwise(n))
    return F.coalesce(F.when(named.isNotNull(), text(decode(named))), told, F.lit(""))


def extension(c: Column) -> Column:
    clean = text(F.regexp_replace(F.coalesce(c, F.lit("")), r"[?#][\s\S]*$", ""))
    return F.lower(F.regexp_extract(clean, r"\.([A-Za-z0-9]{1,8})$", 1))


def _lookup(table: dict[str, str], key: Column, otherwise: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[F.lower(F.coalesce(key, F.lit("")))], F.lit(otherwise))


def is_document(ext: Column) -> Column:
    return F.lower(F.coalesce(ext, F.lit(""))).isin(*CATEGORY)


def mime_of(ext: Column) -> Column:
    return _lookup(MIME, ext, "")


def category(ext: Column) -> Column:
    return _lookup(CATEGORY, ext, "other")


def safe_segment(c: Column, otherwise: Column | str) -> Column:
    """A path segment: reserved characters to spaces, no dots or blanks at the ends, at most 96 characters."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', " ")
    clean = text(F.regexp_replace(F.regexp_replace(clean, f"{SPACE}+", " "), f"^(?:[.]|{SPACE})+|(?:[.]|{SPACE})+$", ""))
    return F.substring(text_or(clean, otherwise if isinstance(otherwise, Column) else F.lit(otherwise), F.lit("untitled")), 1, 96)


def normal_file_name(c: Column) -> Column:
    return F.regexp_replace(safe_segment(F.lower(F.coalesce(c, F.lit(""))), ""), f"{SPACE}+", " ")


def with_extension(name: Column, ext: Column) -> Column:
    return F.when(~filled(ext) | (extension(name) == F.lower(ext)), name).otherwise(F.concat(name, F.lit("."), F.lower(ext)))


def section_priority(s: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in SECTIONS]), F.coalesce(s, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(len(SECTIONS) + 1).cast("int")


def section_label(s: Column) -> Column:
    return F.when(s.isin(*SECTIONS), F.initcap(s)).otherwise(s)


def download_path(course_name: Column, course: Column, sec: Column, page_title: Column, name: Column, link: Column, p: Column, ext: Column, root: str = "Downloads") -> Column:
    bare = F.concat(F.lit("document."), text_or(ext, F.lit("bin")))
    file = with_extension(safe_segment(text_or(name, link, file_name(p), bare), bare), ext)
    title = F.when(filled(page_title), safe_segment(page_title, ""))
    return F.concat_ws("/", F.lit(root), safe_segment(text_or(course_name, F.concat(F.lit("Course "), course)), "Course"), safe_segment(text_or(section_label(sec), F.lit("Other")), "Other"), title, file)
