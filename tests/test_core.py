"""Functions and operators on hand-made rows."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.functions import dates, text, urls
from quillmill.operators import chunking, crawl, dedupe, digests, extraction, inventory, pdf, planning, runs, sync
from quillmill.sources import docx, html, tables
from quillmill.streaming import state


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def _hash(s):
    h = 0
    for i in range(0, len(b := s.encode("utf-16-be")), 2):
        h = (h * 31 + b[i] * 256 + b[i + 1] + 2**31) % 2**32 - 2**31
    return f"h{abs(h)}"


@pytest.mark.parametrize("s", ["", "a", "héllo", "😀 emoji", "polygenelubricants", "x" * 300, "0|text"])
def test_stable_hash(spark, s):
    assert one(spark, text.stable_hash(F.lit(s))) == _hash(s)
    assert _hash("polygenelubricants") == "h2147483648"


def test_text_functions(spark):
    got = spark.range(1).select(
        text.collapse(F.lit("  a  b\n\tc﻿")).alias("a"), text.text_or(F.lit(""), F.lit(None).cast("string"), F.lit("x")).alias("b"), text.word_count(F.lit(" a b  c ")).alias("c"),
        text.is_script_gate(F.lit("You need to enable\nJavaScript to run this app.")).alias("d"), text.is_script_gate(F.concat(F.lit("you need to enable javascript to run this app "), F.repeat(F.lit("w "), 40))).alias("e"),
        text.paragraphs(F.lit("a \r\nb\r\n\r\n\r\nc\t\nd")).alias("f"), text.phrase(F.lit("Été: A-b  C1!")).alias("g"), text.title_segments(F.lit("Week 1 | Intro: abc / Calculus")).alias("h"), text.type_label(F.lit("file_artifact x-ray")).alias("i"),
        text.longer(F.lit("ab"), F.lit("cd")).alias("j"), text.longer(F.lit(""), F.lit("cd")).alias("k"), text.escape_html(F.lit("<a href='x'>&\"</a>")).alias("l"), text.distinct_texts(F.array(F.lit(" a"), F.lit("b"), F.lit("a "), F.lit(""))).alias("m"),
    ).first()
    assert list(got) == ["a b c", "x", 3, True, False, ["a b", "c d"], "t a b c1", ["Week 1", "Intro", "Calculus"], "File Artifact X-Ray", "ab", "cd", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;", ["a", "b"]]


def test_urls(spark):
    u = lambda s: urls.parts(F.lit(s))
    got = spark.range(1).select(
        urls.canonical(u("HTTPS://School.Example.com:443//courses/7/files/?b=2&utm_source=x&a=1#top")).alias("a"), urls.canonical(u("no url")).alias("b"), urls.file_id(u("https://s.example.com/courses/7/files/99/download")).alias("c"),
        urls.file_id(u("https://s.example.com/courses/7/files?preview=12")).alias("d"), urls.section(u("https://s.example.com/courses/7/assignments/syllabus"), F.lit("7")).alias("e"), urls.section(u("https://s.example.com/courses/7/"), F.lit("7")).alias("f"),
        urls.file_name(u("https://s.example.com/x/a%20b+c.PDF?y=1")).alias("g"), urls.file_name(u("https://s.example.com/files/99/download")).alias("h"), urls.file_name(u("https://s.example.com/z?filename=r%C3%A9.txt")).alias("i"),
        urls.extension(F.lit("a.b.PDF?x#y")).alias("j"), urls.safe_segment(F.lit(' a/b:c* . '), "").alias("k"), urls.safe_segment(F.lit("..."), "").alias("l"), urls.with_extension(F.lit("a"), F.lit("PDF")).alias("m"), urls.section_priority(F.lit("nope")).alias("n"),
        urls.page_mode(u("https://s.example.com/dashboard")).alias("o"), urls.is_ignored_route(u("https://s.example.com/courses/7/quizzes/1"), F.lit("https://s.example.com"), F.lit("7")).alias("p"), urls.category(F.lit("PPTX")).alias("q"),
    ).first()
    assert list(got) == ["https://school.example.com/courses/7/files?a=1&b=2", "", "99", "12", "assignments", "home", "a b+c.PDF", "", "ré.txt", "pdf", "a b c", "untitled", "a.pdf", 7, "dashboard", True, "slides"]


def test_windows(spark):
    now = F.lit("2024-01-17 15:00:00").cast("timestamp")  # a Wednesday
    w, r = dates.window(now), dates.window(now, "last_7_days")
    got = spark.range(1).select(*w, *r, dates.window_label(now), dates.parse(F.lit("2024-02-30")), dates.within(F.lit("2024-01-21 23:59:59.999").cast("timestamp"), w), dates.within(F.lit("2024-01-22").cast("timestamp"), w)).first()
    assert got[0] == dt.datetime(2024, 1, 15) and got[1] == dt.datetime(2024, 1, 21, 23, 59, 59, 999000) and got[2] == dt.datetime(2024, 1, 11) and got[3].day == 17
    assert list(got)[4:] == ["Current Week · Jan 15 - Jan 21", None, True, False]


_DOC = "seq long, course_id string, course_name string, source_section string, source_page_title string, source_page_url string, link_text string, file_name string, url string, canonical_url string, file_id string, is_hosted boolean, is_downloadable boolean, is_external boolean, folder_hint string, discovered_at string"


def _doc(seq, url, **kw):
    base = {"course_id": "7", "course_name": "Math", "source_section": "home", "source_page_title": "t", "source_page_url": "https://s.example.com/courses/7", "link_text": "", "file_name": "", "canonical_url": "", "file_id": None, "is_hosted": False, "is_downloadable": False, "is_external": True, "folder_hint": "", "discovered_at": f"d{seq}"} | kw
    return (seq, base["course_id"], base["course_name"], base["source_section"], base["source_page_title"], base["source_page_url"], base["link_text"], base["file_name"], url, base["canonical_url"], base["file_id"], base["is_hosted"], base["is_downloadable"], base["is_external"], base["folder_hint"], base["discovered_at"])


def test_document_dedupe_follows_aliases(spark):
    rows = [
        _doc(1, "https://s.example.com/a?utm_source=x", file_name="abc", source_section="pages"),
        _doc(2, "https://s.example.com/a", file_name="abcd", source_section="files", is_hosted=True, is_external=False),
        _doc(3, "https://s.example.com/files/5"), _doc(4, "https://s.example.com/other", file_id="5", link_text="alias"),  # one file id, two URLs
        _doc(5, "https://s.example.com/b"), _doc(6, "https://s.example.com/c", file_id="8"), _doc(7, "https://s.example.com/b", file_id="8"),  # bridges two groups that stay apart
        _doc(8, "not a url", file_name="Notes.PDF"), _doc(9, "not a url", file_name="notes.pdf"), _doc(10, "https://s.example.com/a", course_id="8"),
    ]
    got = {r.seq: r for r in dedupe.dedupe_documents(spark.createDataFrame(rows, _DOC)).collect()}
    assert {s: r.merged for s, r in got.items()} == {1: 1, 3: 1, 5: 1, 6: 0, 8: 1, 10: 0}
    a = got[1]
    assert (a.file_name, a.source_section, a.is_hosted, a.is_external, a.seen_in_sections, a.url) == ("abcd", "files", True, False, ["pages", "files"], "https://s.example.com/a")
    assert got[8].key == "name:https://s.example.com:7:notes.pdf" and got[3].link_text == "alias"
    fast = {r.seq for r in dedupe.primary_key_dedupe(spark.createDataFrame(rows[:2] + rows[7:], _DOC)).collect()}
    assert fast == {1, 8, 10}


def test_title_that_stands_for_missing_content_loses(spark):
    gate = "You need to enable JavaScript to run this app."
    df = spark.createDataFrame([(1, "k", gate), (2, "k", ""), (3, "j", "short"), (4, "j", gate)], "seq long, key string, t string")
    assert {r.key: r.t for r in df.groupBy("key").agg(dedupe.best_title("t")).collect()} == {"k": "", "j": "short"}


def _split(s, size):
    s, out = s.strip(), []
    while len(s) > size:
        cut = s.rfind(" ", 0, size + 1)
        cut = size if cut < size // 2 else cut
        out.append(s[:cut].strip())
        s = s[cut:].strip()
    return out + [s] if s else out


def _chunk(blocks, size, overlap):
    trail, units = [], []
    for kind, level, s in blocks:
        if not s.strip():
            continue
        if kind == "heading":
            trail = (trail + [""] * 6)[: level - 1] + [s]
        else:
            units += [(p, " > ".join(t for t in trail if t)) for p in _split(s, size)]
    out, now = [], []
    length = lambda us: sum(len(u[0]) for u in us) + 2 * max(0, len(us) - 1)
    for u in units:
        if now and length([*now, u]) > size:
            out.append(now)
            tail, n = [], 0
            for v in reversed(now):
                tail.insert(0, v)
                n += len(v[0]) + (2 if len(tail) > 1 else 0)
                if n >= overlap:
                    break
            now = [*tail, u]
        else:
            now.append(u)
    return ["\n\n".join(u[0] for u in c) for c in out + ([now] if now else [])], [next((u[1] for u in c if u[1]), "") for c in out + ([now] if now else [])]


def test_chunks(spark):
    rnd = random.Random(9)
    docs = []
    for i in range(40):
        blocks = []
        for _ in range(rnd.randint(0, 25)):
            if rnd.random() < 0.25:
                blocks.append(("heading", rnd.randint(1, 6), rnd.choice(["Intro", "Part", ""])))
            else:
                blocks.append(("paragraph", None, rnd.choice(["x" * rnd.randint(1, 1500), " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 300)))])))
        docs.append((f"d{i}", blocks))
    docs += [("empty", []), ("heads", [("heading", 1, "only")]), ("at", [("paragraph", None, "a" * 600 + " " + "b" * 700)])]
    df = spark.createDataFrame(docs, "id string, blocks array<struct<type:string,level:int,text:string>>")
    got = {}
    for r in chunking.chunks(df, "id", F.col("blocks"), F.lit("the fallback"), 100, 250).orderBy("chunk_index").collect():
        got.setdefault(r.content_object_id, []).append(r)
    for i, blocks in docs:
        texts, heads = _chunk(blocks, 600, 250)
        if not texts:
            texts, heads = ["the fallback"], [""]
        assert [r.chunk_text for r in got[i]] == texts and [r.heading_context for r in got[i]] == heads
        for k, r in enumerate(got[i]):
            assert r.chunk_id == f"chunk:{i}:{k:04d}:{_hash(f'{r.heading_context}|{r.chunk_text}')}" and r.token_estimate == max(1, -(-len(r.chunk_text) // 4))


def test_heading_trail(spark):
    rows = [(1, 0, 1, "a"), (1, 1, 3, "b"), (1, 2, 2, "c"), (1, 3, None, ""), (1, 4, 1, "d"), (2, 0, None, "")]
    got = chunking.heading_trail(spark.createDataFrame(rows, "d long, o long, level int, label string"), "d", "o", "level", "label").orderBy("d", "o").collect()
    assert [r.trail for r in got] == ["a", "a > b", "a > c", "a > c", "d", ""]


def test_pdf(spark):
    items = [(1, 1, 0, "b", 50.0, 100.0, 9.0), (1, 1, 1, "a", 10.0, 102.5, 12.0), (1, 1, 2, "next", 0.0, 97.4, 9.0), (1, 1, 3, "far", 0.0, 60.0, 9.0), (1, 2, 0, "d0", 0.0, 0.0, 0.0), (1, 2, 1, "d2", 1.0, 2.0, 0.0), (1, 2, 2, "d4", 2.0, 4.0, 0.0)]
    lines = pdf.lines(spark.createDataFrame(items, "doc_id long, page int, seq long, str string, x double, y double, height double"))
    got = [(r.page, r.line, r.text, r.height) for r in lines.orderBy("page", "line").collect()]
    assert got == [(1, 0, "a b", 12.0), (1, 1, "next", 9.0), (1, 2, "far", 9.0), (2, 0, "d0 d2", 10.0), (2, 1, "d4", 10.0)]
    assert [r.text for r in pdf.paragraphs(lines).orderBy("page", "paragraph").collect()] == ["a b next", "far", "d0 d2 d4"]


def test_extraction_state(spark):
    jobs = spark.createDataFrame([("j1", "a", "processing", 1), ("j2", "a", "queued", 2), ("j3", "", "queued", 3), ("j4", "b", "odd", 4)], "job_id string, content_object_id string, status string, seq long")
    queue = extraction.recover_queue(jobs)
    assert {(r.job_id, r.status) for r in queue.collect()} == {("j1", "queued"), ("j4", "queued")}
    records = spark.createDataFrame([("a", True, 1), ("c", True, 2), ("c", True, 3), ("d", False, 4), ("", True, 5), ("e", True, 6)], "content_object_id string, supported boolean, seq long")
    known = spark.createDataFrame([("e", "chunked", "extracted")], "content_object_id string, processing_state string, extraction_status string")
    outcome = lambda force: [r.outcome for r in extraction.enqueue(records, known, queue, force).orderBy("seq").collect()]
    assert outcome(False) == ["skipped", "enqueued", "skipped", "unsupported", "skipped", "skipped"]
    assert outcome(True)[-1] == "enqueued"
    new = extraction.upsert_records(known, spark.createDataFrame([("e", "failed"), ("f", "pending")], "content_object_id string, extraction_status string"))
    assert {tuple(r) for r in new.collect()} == {("e", "chunked", "failed"), ("f", None, "pending")}
    left, done = extraction.finish(queue.withColumn("last_error", F.lit("")), spark.createDataFrame([("j1", "completed", "", 9)], "job_id string, status string, last_error string, seq long"))
    assert [r.job_id for r in left.collect()] == ["j4"] and done.first().status == "completed"
    log = spark.createDataFrame([(f"j{i % 90}", i) for i in range(100)], "job_id string, seq long")
    assert [r.seq for r in extraction.history(log).collect()] == list(range(99, 19, -1))


def test_inventory_falls_back_to_documents(spark):
    courses = spark.createDataFrame([("7", "Math", "https://s.example.com/courses/7", 1)], "course_id string, course_name string, course_url string, seq long")
    docs = spark.createDataFrame([(str(i), "7", "Math", s, "Page", f"https://s.example.com/p{i % 2}", "f.pdf", "", "https://s.example.com/f", True, False, True, i) for i, s in enumerate(["pages", "assignments", "pages", "files"])],
        "id string, course_id string, course_name string, source_section string, source_page_title string, source_page_url string, file_name string, link_text string, url string, is_downloadable boolean, is_external boolean, is_hosted boolean, seq long")
    schema = "id string, content_type string, course_id string, course_name string, source_section string, source_page_title string, title string, source_page_url string, external_url string, body_html string, body_text string, excerpt string, content_hash string, due_date string, is_external boolean, seq long"
    gate = [("x", "canvas_page", "7", "Math", "files", "t", "t", "https://s.example.com/courses/7/files/3", "", "", "You need to enable JavaScript to run this app.", "", "", "", False, 1)]
    types = lambda items: sorted(r.content_type for r in inventory.build(courses, spark.createDataFrame(items, schema), docs).collect())
    assert types(gate) == ["assignment", "canvas_page", "course", "deliverable", *["file_artifact"] * 4]
    page = [("y", "assignment", "7", "Math", "assignments", "t", "t", "https://s.example.com/courses/7/assignments/3", "", "<p>x</p>", "", "", "", "", False, 2)]
    assert types(gate + page) == ["assignment", "course", "deliverable", *["file_artifact"] * 4]


def test_phrases_and_tokens(spark):
    rows = [(1, "7", "Math", "Linear Algebra | Week", "", ["Matrix rank"], "matrix  rank"), (2, "7", "Math", "linear algebra", "Unit: Vectors", [], ""), (3, "", "Solo", "12345", "", [], "")]
    df = spark.createDataFrame(rows, "seq long, course_id string, course_name string, title string, week_or_module string, headings array<string>, text_snippet string")
    got = [(r.course_key, r.phrase, r.score) for r in digests.ranked_phrases(df).orderBy("course_key", "rank").collect()]
    assert got == [("7", "Linear Algebra", 7), ("7", "Matrix rank", 5), ("7", "Unit", 2), ("7", "Vectors", 2)]
    tokens = digests.ranked_tokens(df, 10, digests.ranked_phrases(df)).where("course_key = '7'").collect()
    assert [r.token for r in tokens] == []
    assert [(r.token, r.score) for r in digests.ranked_tokens(df, 2).where("course_key = '7'").orderBy("rank").collect()] == [("algebra", 3), ("linear", 3)]


def test_tasks_and_gaps(spark):
    rows = [(1, "a", "7", "Math", "t1", "2024-01-15"), (2, "b", "", "", "t2", "2024-01-21 23:59:59.999"), (3, "c", "8", "Bio", "t3", "2024-01-22"), (4, "d", "7", "Math", "zz", ""), (5, "e", "7", "Math", "aa", None), (6, "f", "7", "Math", "t", "soon")]
    df = spark.createDataFrame(rows, "seq long, content_object_id string, course_id string, course_name string, title string, due_date string")
    due, gaps = digests.tasks(df, F.lit("2024-01-17 15:00:00").cast("timestamp"), courses=["7"])
    assert {r.seq for r in due.collect()} == {1, 2} and [r.title for r in gaps.collect()] == ["aa", "zz"]


def test_second_sync_only_skips(spark):
    rows = spark.createDataFrame([(str(i), "canvas_page", "direct_ingest", f"h{i}", "u", "u", "not_started", "not_started", 0, "", "") for i in range(5)],
        "object_id string, content_type string, content_path_type string, content_hash string, source_url string, source_page_url string, extraction_status string, enrichment_status string, chunk_count int, extracted_text string, extraction_method string")
    empty = spark.createDataFrame([], "object_id string, page_id string, content_hash string, last_status string")
    done = sync.actions(rows, empty, empty.select("object_id"))
    assert {r.action for r in done.collect()} == {"created"}
    again = sync.actions(rows, sync.next_state(empty, done), done.select("object_id"))
    assert {r.action for r in again.collect()} == {"skipped"}
    changed = sync.actions(rows.withColumn("content_hash", F.lit("new")), sync.next_state(empty, done), done.select("object_id"))
    assert {r.action for r in changed.collect()} == {"updated"}
    assert sync.final_status(done, empty).first().status == "completed"


def test_html_and_docx(spark):
    page = "<html><head><title>T | Site</title></head><body><nav>no</nav><h2>Head</h2><p>one <b>two<p>three</b></p><ul><li>a<li>b</ul><table><tr><th>x<td>y</table><pre>c\n d</pre><blockquote>q</blockquote><div>loose <a href='/k?x=1' rel=next>link</a></div><script>no()</script></body>"
    df = spark.createDataFrame([(1, "https://s.example.com/d/", page), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    blocks, links = html.page_rows(df)
    got = [(r.type, r.text) for r in blocks.orderBy("page_id", "ord").collect()]
    assert got == [("heading", "Head"), ("paragraph", "one two"), ("paragraph", "three"), ("list_item", "a"), ("list_item", "b"), ("paragraph", "x | y"), ("code", "c d"), ("quote", "q"), ("paragraph", "loose link")]
    assert [(r.url, r.label, r.rel) for r in links.collect()] == [("https://s.example.com/k?x=1", "link", "next")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    assert [(b["type"], b["level"], b["text"]) for b in docx.docx_blocks(data.getvalue())] == [("heading", 2, "Top"), ("paragraph", None, "a b")] and docx.docx_blocks(b"no zip") == []


def test_tables_streams_and_runs(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), root, "k")
    tables.upsert(spark.createDataFrame([(2, "c", 5)], "k long, v string, w int"), root, "k")
    assert {tuple(r) for r in tables.read(spark, root).collect()} == {(1, "a", None), (2, "c", 5)}
    src = str(tmp_path / "in")
    for part in ([(1, "x", 1), (1, "y", 3)], [(1, "z", 2), (2, "q", 1)]):
        spark.createDataFrame(part, "k long, v string, at long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k long, v string, at long").option("maxFilesPerTrigger", 1).parquet(src)
    state.keep_newest(stream, str(tmp_path / "s"), "k", "at", str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in tables.read(spark, str(tmp_path / "s")).collect()} == {(1, "y", 3), (2, "q", 1)}
    log = []
    end = runs.run({"automation_id": "a"}, "r1", lambda: spark.range(3), lambda df: df.where("id > 0"), lambda df: df.count(), log.append)
    assert end["status"] == "completed" and end["written"] == 2 and [e["status"] for e in log] == ["planning", "collecting", "generating", "writing", "completed"]
    assert runs.run({"automation_id": "a"}, "r2", lambda: 1 / 0, None, None, log.append)["status"] == "failed"
    assert runs.run({"automation_id": "a", "enabled": False}, "r3", None, None, None, log.append)["status"] == "blocked"


def test_crawl(spark):
    links = spark.createDataFrame([("a", "z", 0), ("z", "c", 0), ("c", "a", 0), ("a", "d", 1), ("x", "y", 0), ("z", None, 1), ("d", "b", 0), ("d", "c", 1)], "src string, dst string, ord int")
    got = crawl.scan(spark.createDataFrame([("a",)], "url string"), links)
    # in order of discovery: c is found from z, which was found before d
    assert [(r.url, r.hop, r.pos) for r in got.collect()] == [("a", 0, 1), ("z", 1, 2), ("d", 1, 3), ("c", 2, 4), ("b", 2, 5)]
    assert [r.url for r in crawl.scan(spark.createDataFrame([("a",)], "url string"), links, limit=2).collect()] == ["a", "z"]
    assert crawl.scan(spark.createDataFrame([], "url string"), links).count() == 0


def test_crawl_of_a_chain(spark):
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}", 0) for i in range(30)], "src string, dst string, ord int")
    got = crawl.scan(spark.createDataFrame([("p0",)], "url string"), links)
    assert [(r.url, r.hop) for r in got.collect()] == [(f"p{i}", i) for i in range(31)]


def test_planning_levels(spark):
    rows = spark.createDataFrame([("content", True, "extracted", 0, False, "extracted")], "plan_type string, holds_content boolean, extraction_status string, chunk_count int, automation_ready boolean, readiness string")
    assert planning.readiness_level(rows).first().readiness_level == "content_ready"
    assert planning.worst(planning.check("a", rows, F.lit(True), True).unionByName(planning.check("b", rows, F.lit(False), True))).first().status == "blocked"
