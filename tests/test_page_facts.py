import random

import plain_pages as plain
from pyspark.sql import functions as F

from quillmill.sources import page_facts

PAGES = "page_id long, url string, html string"


def test_facts(spark):
    page = """<html><head><title>Week 1 | Biology | School</title></head><body><main><div class="header-bar"><h1> Cell  walls </h1></div>
      <div class="user_content"><p>Read <a href="/x.pdf">the paper</a> by <time datetime=" "></time><time datetime="2024-02-01">May</time>.</p>
      <ul><li>plain</li><li><p>boxed</p></li></ul><img alt="A cell"><p hidden>secret</p><p>one<br>two</p><script>no()</script></div></main></body></html>"""
    rows = [(1, "u", page), (2, "u", "<title>Only this | Site</title><p>Body</p>"), (3, "u", "<h1>You need to enable JavaScript to run this app.</h1>"), (4, "u", None), (5, "u", "")]
    got = {r.page_id: r for r in page_facts.facts(spark.createDataFrame(rows, PAGES), F.lit("pages"), F.lit("Fallback")).collect()}
    assert (got[1].title, got[1].due_date, got[1].content_type) == ("Cell walls", "2024-02-01", "canvas_page")
    assert got[1].body_text == "Read the paper (/x.pdf) by May .\nplain\n• boxed\n[Image: A cell] one\ntwo"
    assert (got[2].title, got[2].due_date, got[2].body_text) == ("Only this", None, "Body")
    assert [got[k].title for k in (3, 4, 5)] == ["Fallback"] * 3 and [got[k].body_text for k in (4, 5)] == ["", ""]


def test_module_label(spark):
    html = "<div id='context_modules'><div class='context_module'><h2>Week 3</h2><p>x</p></div></div>"
    df = spark.createDataFrame([(1, "u", html)], PAGES)
    assert page_facts.facts(df, F.lit("modules"), F.lit("")).first().week_or_module == "Week 3"
    assert page_facts.facts(df, F.lit("pages"), F.lit("")).first().week_or_module == ""


def test_files(spark):
    row = "<table><tr><td><a href='https://h.example.com/files/9/notes.pdf'>Open</a> Folder: Week 1 </td></tr><tr><td><a href='/a/b'>b.docx</a></td></tr></table><a href='/z'>Z</a>"
    crumbs = "<div class='breadcrumbs'><a>Course</a><a>Files</a><a>Week 2</a></div>"
    df = spark.createDataFrame([(1, "u", row), (2, "u", crumbs + row), (3, "u", None)], PAGES)
    got = [tuple(r) for r in page_facts.file_links(df, F.lit("files")).where("page_id = 1").orderBy("ord").select("file_name", "folder_hint").collect()]
    assert got == [("notes.pdf", "Week 1"), ("b.docx", None), ("Z", None)]
    assert page_facts.file_links(df, F.lit("files")).where("page_id = 2 AND label = 'b.docx'").first().folder_hint == "Files/Week 2"
    assert page_facts.file_links(df, F.lit("pages")).where("folder_hint IS NOT NULL").count() == 0


def test_dashboard(spark):
    html = """<div class="ic-DashboardCard"><a href="/courses/7" aria-label="Biology 101">Bio</a><span>Fall 2024</span></div>
      <li><a href="/courses/7/grades">Grades</a></li><li><a href="/courses/7">Biology</a></li><li><a href="/courses/8">Home</a></li>
      <tr><td><a href="https://b.example.com/courses/7">Other</a></td><td class="term">Term 1</td></tr><a href="/users/7">Me</a>"""
    df = spark.createDataFrame([(1, "https://a.example.com/", html), (2, None, None)], PAGES)
    got = sorted(tuple(r) for r in page_facts.dashboard_courses(df).select("origin", "course_id", "course_name", "term").collect())
    assert got == [("https://a.example.com", "7", "Biology 101", "Fall 2024"), ("https://b.example.com", "7", "Other", "Term 1")]


def _random_page(rnd):
    """Nested elements of all kinds that facts look at."""
    kinds = ["p", "div", "li", "ul", "span", "h1", "h2", "td", "tr", "table", "main", "nav", "section", "a", "strong"]
    attrs = ["", "", "", " class='user_content'", " class='header-bar x'", " class='context_module'", " class='page-header'", " id='content'", " id='context_modules'", " hidden", " class='breadcrumbs'", " class='ic-DashboardCard'", " class='term'", " aria-hidden='true'", " data-course-name='C'"]

    def inner(depth):
        out = []
        for _ in range(rnd.randrange(1, 4)):
            k = rnd.random()
            if k < 0.3 or depth > 5:
                out.append(rnd.choice(["one ", " two\n three", "&nbsp;", "\u2022 x", "Fall term", " ", "Folder: Week 2"]))
            elif k < 0.38:
                out.append(rnd.choice(["<br>", "<img alt='A cell'>", "<img>", "<time datetime='2024-02-0%d'>May</time>" % rnd.randrange(1, 9), "<script>no</script>"]))
            elif k < 0.5:
                out.append(f"<a href='{rnd.choice(['/courses/7', 'https://b.example.com/courses/8/files', 'notes.pdf', '/x/', 'http://[bad'])}'>{rnd.choice(['Open', 'b.docx', '', 'Home', 'Files <b>now</b>'])}</a>")
            else:
                tag = rnd.choice(kinds)
                out.append(f"<{tag}{rnd.choice(attrs)}>{inner(depth + 1)}</{tag}>")
        return "".join(out)

    return f"<title>T{rnd.randrange(9)} | Site</title><body>{inner(0)}</body>"


def test_joins_find_what_a_walk_finds(spark):
    """On random pages and on a whole table."""
    rnd = random.Random(11)
    sections = ["pages", "assignments", "syllabus", "home", "modules", "files", "other"]
    rows = [(i, "https://a.example.com/p/", _random_page(rnd)) for i in range(250)] + [(1000 + r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    of = F.element_at(F.array(*[F.lit(s) for s in sections]), (F.col("page_id") % len(sections) + 1).cast("int"))
    got = {r.page_id: r for r in page_facts.facts(pages, of, F.lit("")).collect()}
    links = {(r.page_id, r.ord): r for r in page_facts.file_links(pages, F.lit("files")).collect()}
    seen = 0
    for i, url, html in rows:
        want = plain._facts(html, sections[i % len(sections)])
        assert (got[i].title, got[i].due_date, got[i].week_or_module, got[i].body_text) == (want["title"], want["due_date"], want["week_or_module"], want["body_text"]), html
        for k, f in enumerate(plain._files(html)):
            assert (links[i, k].href, links[i, k].label) == (f["href"], f["label"])
            below = "/".join(f["crumbs"][1:]) if len(f["crumbs"]) > 1 else (f["row_text"].split("Folder:", 1)[1].strip() if "Folder:" in f["row_text"] else None)
            assert links[i, k].folder_hint == ((below or None) if f["row_text"] else None)
            seen += 1
    assert seen == len(links)
    cards = {}
    for i, url, html in rows:
        for c in plain._cards(html, url):
            name = next((n for x in c["names"] if (n := plain._line(x)) and n.lower() not in page_facts.NO_COURSE_NAMES), None)
            if name and "/courses/" in c["url"]:
                key = (i, c["url"].split("/courses/")[0], c["url"].split("/courses/")[1].split("/")[0])
                cards.setdefault(key, []).append((name, c["term"]))
    want = {k: (max((n for n, _ in v), key=len), next((t for _, t in v if t), None)) for k, v in cards.items()}
    assert {(r.page_id, r.origin, r.course_id): (r.course_name, r.term) for r in page_facts.dashboard_courses(pages).collect()} == want and len(want) > 20


def test_course_pages(spark):
    html = """<div id='breadcrumbs'><li>Home</li><li>Biology</li></div><a href='/courses/7/modules'>M</a><a href='/courses/7/modules/2'>later</a><a href='/courses/8/files'>other</a><a href='/courses/7/grades'>Files</a>
      <a href='/courses/7/x'> PAGES </a><a href='https://b.example.com/courses/7/files'>away</a>"""
    rows = [(1, "https://a.example.com/courses/7/pages/intro", html), (2, "https://a.example.com/dashboard", html), (3, "https://a.example.com/courses/7", None), (4, None, html)]
    got = {r.page_id: r for r in page_facts.course_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert set(got) == {1, 3} and (got[1].origin, got[1].course_id, got[1].course_name, got[1].section) == ("https://a.example.com", "7", "Biology", "pages")
    at = "https://a.example.com/courses/7"
    assert got[1].nav == {"modules": f"{at}/modules", "files": f"{at}/grades", "pages": f"{at}/x", "home": at} and got[3].nav == {"home": at} and got[3].course_name is None and got[3].section == "home"
