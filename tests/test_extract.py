"""Extraction from record to chunks, and scans of several courses, on small tables."""

import io
import zipfile
from collections import deque

from pyspark.sql import functions as F

from quillmill.operators import crawl, extract, jobs


def _docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}Heading1{chr(34)}/></w:pPr>" if i == 0 else ""}<w:r><w:t>{p}</w:t></w:r></w:p>' for i, p in enumerate(paragraphs))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


GATE = "You need to enable JavaScript to run this app."
SCHEMA = "content_object_id string, content_type string, extension string, source_url string, title string, body_html string, body_text string, text string, content binary, fetched_type string, course_id string, clash int"
ROWS = [
    ("inline", "assignment", "", "", "T", "<p>Hello <b>you</b></p><ul><li>one</li><li> </li></ul>", "", None, None, None, "7", 1),
    ("empty html", "canvas_page", "", "u", "", "", "fall\n\nback", " ", None, None, "7", 1),
    ("only noise", "canvas_page", "", "u", "", "", None, "<nav>x</nav>", None, None, "7", 1),
    ("no url", "canvas_page", "", None, "T", "", "", "<p>x</p>", None, None, "7", 1),
    ("list", "file_artifact", "txt", "u", "", "", "", "- one\n\n2. two\n\nthree\nfour", None, None, "7", 1),
    ("gate", "file_artifact", "txt", "u", "", "", "", GATE, None, None, "7", 1),
    ("blank", "file_artifact", "txt", "u", "", "", "", " \n ", None, None, "7", 1),
    ("blank with title", "file_artifact", "txt", "u", "Name", "", "", None, None, None, "7", 1),
    ("word", "file_artifact", "docx", "u", "N", "", "", None, _docx("Head", "Body text"), None, "7", 1),
    ("no word", "file_artifact", "docx", "u", "N", "", "", None, b"PK", None, "7", 1),
    ("null word", "file_artifact", "docx", "u", "N", "", "", None, None, None, "7", 1),
    ("pdf", "file_artifact", "pdf", "u", "", "", "", None, b"", None, "7", 1),
    ("pdf as page", "file_artifact", "pdf", "u", "", "", "", "<p>login</p>", None, "Text/HTML; charset=x", "7", 1),
    ("pdf as gate", "file_artifact", "pdf", "u", "", "", "", GATE, None, "text/html", "7", 1),
    ("pdf without items", "file_artifact", "pdf", "u", "", "", "", None, None, None, "7", 1),
    ("web file", "file_artifact", "html", "u", "", "", "", "<h2>A</h2><pre>x\n y</pre>", None, None, "7", 1),
    ("zip", "file_artifact", "zip", "u", "", "", "", None, None, None, "7", 1),
    ("long", "file_artifact", "txt", "u", "", "", "", "word " * 40_000, None, None, "7", 1),
]
ITEMS = [("pdf", 1, 1, "second", 50.0, 100.0, 10.0), ("pdf", 1, 0, "First", 10.0, 101.0, 10.0), ("pdf", 1, 2, "line", 10.0, 88.0, 10.0), ("pdf", 1, 3, "new", 10.0, 50.0, 10.0), ("pdf", 2, 0, "page", 0.0, 100.0, 0.0), ("zip", 1, 0, "not a pdf", 0.0, 0.0, 0.0)]


def _items(spark):
    return spark.createDataFrame(ITEMS, "content_object_id string, page int, seq long, str string, x double, y double, height double")


def test_extract(spark):
    got = {r.content_object_id: r for r in extract.extract(spark.createDataFrame(ROWS, SCHEMA), _items(spark)).collect()}
    assert len(got) == len(ROWS)
    said = {k: (r.status, r.reason or r.extracted_text) for k, r in got.items() if k != "long"}
    assert said == {
        "inline": ("completed", "T\n\nHello you\n\n• one"), "empty html": ("completed", "fall\n\nback"), "only noise": ("failed", jobs.NO_TEXT), "no url": ("failed", extract.NO_URL), "list": ("completed", "• one\n\n1. two\n\nthree four"),
        "gate": ("failed", extract.GATE_PAGE), "blank": ("failed", jobs.NO_TEXT), "blank with title": ("completed", "Name"), "word": ("completed", "Head\n\nBody text"), "no word": ("failed", "The source could not be read. It is no Word document."),
        "null word": ("failed", "The source could not be read. It is no Word document."), "pdf": ("completed", "First second line\n\nnew\n\npage"), "pdf as page": ("failed", "Expected PDF source, but fetch returned HTML."), "pdf as gate": ("failed", extract.GATE_FILE),
        "pdf without items": ("failed", jobs.NO_TEXT), "web file": ("completed", "A\n\nx y"), "zip": ("unsupported", "Unsupported binary file type: .zip."),
    }
    r = got["inline"]
    assert (r.word_count, r.heading_count, r.headings, r.paragraph_count, r.chunk_count, r.processing_state, r.extraction_method, r.automation_ready, r.clash) == (5, 1, ["T"], 1, 1, "chunked", "canvas_html_dom_v1", True, 1)
    assert r.extracted_html == "<h1>T</h1><p>Hello you</p><ul><li>one</li></ul>"
    assert [(got[k].processing_state, got[k].extraction_status, got[k].normalization_status, got[k].chunk_count) for k in ("gate", "zip")] == [("extraction_failed", "failed", "failed", 0), ("unsupported_for_extraction", "unsupported", "not_applicable", 0)]
    assert got["long"].word_count == 40_000 and got["long"].chunk_count > 80 and all(len(c.chunk_text) <= 2 * 2200 + 2 for c in got["long"].chunks)
    assert extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = extract.chunk_rows(extract.extract(spark.createDataFrame(ROWS, SCHEMA).where("content_object_id = 'word'"))).collect()
    assert [(c.content_object_id, c.course_id, c.source_document_id, c.heading_context, c.chunk_text, c.token_estimate, c.source_category) for c in rows] == [("word", "7", None, "Head", "Body text", 3, "docx")]


def test_drain(spark):
    records = spark.createDataFrame(ROWS, SCHEMA)
    queue = spark.createDataFrame([("a", "inline", "queued", 0), ("b", "inline", "queued", None), ("c", "gone", "queued", 0), ("d", "zip", "queued", 2), ("e", "blank", "queued", 0), ("f", "word", "completed", 1)], "job_id string, content_object_id string, status string, attempts int")
    done, rows = extract.drain(queue, records, _items(spark))
    got = {r.job_id: (r.status, r.attempts, r.reason) for r in done.collect()}
    assert got == {"a": ("completed", 1, ""), "b": ("completed", 1, ""), "c": ("unsupported", 1, jobs.LOST), "d": ("unsupported", 3, "Unsupported binary file type: .zip."), "e": ("failed", 1, jobs.NO_TEXT), "f": ("completed", 1, "")}
    assert sorted(r.content_object_id for r in rows.collect()) == ["blank", "inline", "zip"]


def test_blank_results_fail(spark):
    queue = spark.createDataFrame([(str(i), str(i), "processing") for i in range(4)], "job_id string, content_object_id string, status string")
    records = spark.createDataFrame([(str(i), True, "") for i in range(4)], "content_object_id string, supported boolean, unsupported_reason string")
    results = spark.createDataFrame([("0", "", None), ("1", "  \n ", None), ("2", "x", None), ("3", None, None)], "content_object_id string, extracted_text string, error string")
    assert [(r.status, r.reason) for r in jobs.finished(queue, records, results).orderBy("job_id").collect()] == [("failed", jobs.NO_TEXT)] * 2 + [("completed", ""), ("queued", "")]


def _plain_scan(start, links, failed, limit, inside):
    """A queue, one page at a time."""
    seen, queue = [], deque(dict.fromkeys(start))
    queued = set(queue)
    while queue and len(seen) < limit:
        at = queue.popleft()
        seen.append(at)
        for to, kind in links.get(at, []) if at not in failed else []:
            if to not in queued and (kind == "page" or inside(to)):
                queued.add(to)
                queue.append(to)
    return seen


def test_scan_courses(spark, monkeypatch):
    u = lambda c, i: f"https://s.example.com/courses/{c}/pages/{i}"
    edges = {u(c, i): [(u(c, (i * 3 + 1) % 40), "follow"), (u((c + i) % 4, i + 1), "page"), (u(1, i), "follow"), ("https://other.example.com/courses/1/x", "follow"), (None, "follow")] for c in range(4) for i in range(40)}
    links = spark.createDataFrame([(s, d, k, kind) for s, out in edges.items() for k, (d, kind) in enumerate(out)] + [(None, "x", 0, "follow")], "src string, dst string, ord int, kind string")
    failed = {u(c, 5) for c in range(4)}
    start = {str(c): [u(c, 0), u(c, 7)] for c in range(3)} | {"3": [u(3, 5)]}
    courses = spark.createDataFrame([(c, "https://s.example.com") for c in [*start, "0", "9"]], "course_id string, origin string")
    rows = spark.createDataFrame([(c, x, "home", i) for c, s in start.items() for i, x in enumerate(s)] + [("0", None, "home", 9)], "course_id string, url string, section string, seq int")
    bad = spark.createDataFrame([(x, "timeout") for x in failed], "url string, error string")
    edges = {s: [(d, k) for d, k in out if d] for s, out in edges.items()}
    for limit, few in ((30, 20_000), (30, 25), (1, 20_000)):
        monkeypatch.setattr(crawl, "FEW", few)
        out = crawl.scan_courses(courses, rows, links, bad, limit)
        got = out.orderBy("course_id", "pos").collect()
        for c, s in start.items():
            mine = [r for r in got if r.course_id == c]
            want = _plain_scan(s, edges, failed, limit, lambda to: to.startswith(f"https://s.example.com/courses/{c}/"))
            assert [r.url for r in mine] == want and [r.pos for r in mine] == list(range(1, len(want) + 1))
            assert {r.url for r in mine if r.error} == failed & set(want)
        if limit == 30 and few == 20_000:
            state = {r.course_id: r.status for r in crawl.outcomes(courses, out).collect()}
            assert state == {"0": "completed", "1": "completed", "2": "completed", "3": "error", "9": "error"}
    first = crawl.queued(spark.createDataFrame([("1", "https://s.example.com/courses/1", {"pages": "https://s.example.com/courses/1/wiki"}, "https://s.example.com/courses/1/files/2")], "course_id string, course_url string, nav map<string,string>, current_url string"))
    assert [(r.section, r.url.rsplit("/", 1)[1]) for r in first.orderBy("seq").collect()] == [("files", "files"), ("modules", "modules"), ("pages", "wiki"), ("assignments", "assignments"), ("syllabus", "syllabus"), ("home", "1"), ("files", "2")]
