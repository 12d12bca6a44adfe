"""Rich blocks, scans, jobs and statuses on hand-made fixtures."""

from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import chunking, jobs, outputs, scan, status
from quillmill.sources import rich_blocks


def _runs(block):
    marks = ("bold", "italic", "strikethrough", "underline", "code")
    return [(r["text"], r["href"], "".join(m[0] for m in marks if r[m])) for r in block["runs"]]


def test_rich_blocks_nest_marks_and_links(spark):
    html = (
        "<h1>One <em>two</em></h1><h4>small</h4><p>a <b>b <i>c</i></b> <a href='/x'>d <code>e</code></a><br>f<u>g</u><s>h</s></p><ul><li>i <strong>j</strong></li><li> </li></ul><ol><li>k</li></ol>"
        "<pre>x\n  y</pre><hr><blockquote>q</blockquote><table><tr><th>A</th><td>B</td></tr></table><div><p>in</p><section><h2>deep</h2></section></div><div>bare <b>text</b></div><p><img alt=' pic '><img></p>loose"
    )
    df = spark.createDataFrame([(1, html, "no"), (2, "  ", "p1\n\n\n p2 "), (3, None, None), (4, "<p> </p>", "fall back"), (5, "<p>" + "word " * 1000 + "</p>", ""), (6, "<p>x</p>" * 1200, "")], "k int, html string, other string")
    got = {r.k: [b.asDict(True) for b in r.b] for r in df.select("k", rich_blocks.rich_blocks(F.col("html"), F.col("other")).alias("b")).collect()}
    assert [b["type"] for b in got[1]] == [
        "heading_1", "paragraph", "paragraph", "bulleted_list_item", "numbered_list_item", "code", "divider", "quote", "paragraph", "paragraph", "heading_2", "paragraph", "paragraph", "paragraph"
    ]
    one = got[1]
    assert _runs(one[0]) == [("One ", None, ""), ("two", None, "i")]
    assert _runs(one[2]) == [("a ", None, ""), ("b ", None, "b"), ("c", None, "bi"), ("d ", "/x", ""), ("e", "/x", "c"), ("\n", None, ""), ("f", None, ""), ("g", None, "u"), ("h", None, "s")]
    assert _runs(one[3]) == [("i ", None, ""), ("j", None, "b")] and _runs(one[5]) == [("x y", None, "c")] and one[6]["runs"] == []
    assert [_runs(b)[0][0] for b in one[8:]] == ["A | B", "in", "deep", "bare text", "[Image: pic]", "loose"]
    assert [_runs(b)[0][0] for b in got[2]] == ["p1", "p2"] and got[3] == [] and [_runs(b)[0][0] for b in got[4]] == ["fall back"]
    sizes = [len(t) for t, _, _ in _runs(got[5][0])]
    assert len(sizes) == 3 and max(sizes) <= 1900 and len(got[6]) == 1000


def test_stable_hash(spark):
    cases = {"": "h0", "a": "h97", "ab": "h3105", "polygenelubricants": "h2147483648", "é😀": None}
    h = 0
    for unit in (0xE9, 0xD83D, 0xDE00):
        h = ((h * 31 + unit + 2**31) % 2**32) - 2**31
    cases["é😀"] = f"h{abs(h)}"
    df = spark.createDataFrame(list(cases.items()), "t string, h string")
    assert df.where(text.stable_hash(F.col("t")) != F.col("h")).count() == 0
    assert spark.createDataFrame([(None,)], "t string").select(text.stable_hash(F.col("t")).alias("h")).first().h == "h0"


def test_white_space_is_one_class(spark):
    odd = "\t\n\x0b\x0c\r         　﻿"
    df = spark.createDataFrame([(c,) for c in odd + "a~!\u0085​\x1f0é"], "c string")
    spaces = {r.c for r in df.where(F.col("c").rlike(f"^{text.SPACE}$")).collect()}
    words = {r.c for r in df.where(F.col("c").rlike(f"^{text.WORD}$")).collect()}
    assert spaces == set(odd) and words == set("a~!\u0085​\x1f0é")


def _brute_chunks(blocks, size, overlap):
    """Plain packing, for comparison: every length is counted anew."""
    length = lambda c: sum(map(len, c)) + 2 * (len(c) - 1)
    out, now = [], []
    for u in blocks:
        if now and length([*now, u]) > size:
            out.append(now)
            k = 0
            while k < len(now) and (k == 0 or length(now[len(now) - k :]) < overlap):
                k += 1
            now = now[len(now) - k :] if overlap else []
        now = [*now, u]
    return [*out, now] if now else out


def test_chunks_against_plain_packing(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    c = df.select("doc_id", chunking.text_blocks(F.col("text")).alias("b"), chunking.chunk_array(chunking.text_blocks(F.col("text")), F.col("text"), 600, 100).alias("c")).collect()
    for r in c:
        units = [p for b in r.b for p in chunking._split(b["text"], 600)]
        assert all(len(u) <= 600 for u in units)
        assert [x["chunk_text"] for x in r.c] == ["\n\n".join(x) for x in _brute_chunks(units, 600, 100)]


def test_scan_state(spark):
    courses = spark.createDataFrame([("1", "One"), ("2", "Two"), ("3", "Three")], "course_id string, course_name string")
    blank = (None,) * len(scan.COUNTS)
    names = ", ".join(f"{c} long" for c in scan.COUNTS)
    log = [("1", 1, "scanning", None, *blank), ("1", 2, "completed", "done", 9, *blank[1:]), ("2", 1, "error", "broke", *blank), ("9", 5, None, "new", *blank)]
    rows = scan.progress(courses, spark.createDataFrame(log, f"course_id string, seq long, status string, message string, {names}"))
    got = {r.course_id: (r.course_name, r.status, r.message, r.pages_visited) for r in rows.collect()}
    assert got == {"1": ("One", "completed", "done", 9), "2": ("Two", "error", "broke", 0), "3": ("Three", "queued", "Queued", 0), "9": ("9", "queued", "new", 0)}
    assert scan.outcome(rows).first().status == "scanning"
    assert scan.outcome(rows.where("course_id = '2'")).first().status == "error" and scan.outcome(rows.where("course_id in ('1', '2')")).first().status == "completed"
    order = spark.createDataFrame([("3", 0), ("x", 1), ("1", 2), ("3", 4)], "course_id string, pos int")
    assert [r.course_id for r in scan.in_order(courses, order).collect()] == ["3", "1"]
    assert [r.course_id for r in scan.in_order(courses, order, keep_others=True).collect()] == ["3", "1", "2"]


def test_jobs_fail_alone(spark):
    queue = spark.createDataFrame([("j1", "a", "queued", 0, 3), ("j2", "b", "queued", None, 1), ("j3", "c", "processing", 1, 2), ("j4", "gone", "queued", 0, 4)], "job_id string, content_object_id string, status string, attempts int, seq int")
    assert [r.job_id for r in jobs.waiting(queue).collect()] == ["j2", "j1", "j4"] and jobs.waiting(queue, 1).first().job_id == "j2"
    on = jobs.started(queue)
    assert {(r.job_id, r.attempts) for r in on.collect()} == {("j1", 1), ("j2", 1), ("j3", 1), ("j4", 1)}
    records = spark.createDataFrame([("a", True, ""), ("b", True, ""), ("c", False, "no way")], "content_object_id string, supported boolean, unsupported_reason string")
    results = spark.createDataFrame([("a", None, "bad bytes"), ("b", "text", None)], "content_object_id string, extracted_text string, error string")
    got = {r.job_id: (r.status, r.reason) for r in jobs.finished(on, records, results).collect()}
    assert got == {"j1": ("failed", "bad bytes"), "j2": ("completed", ""), "j3": ("unsupported", "no way"), "j4": ("unsupported", jobs.LOST)}


def test_outputs(spark):
    df = spark.range(3)
    assert outputs.enhance(df) == (df, False) and outputs.enhance(df, lambda d: d.limit(1))[1] is False
    out, used = outputs.enhance(df, lambda d: d.where("id > 0"), enabled=True)
    assert used and out.count() == 2
    assert status.by_section(spark.createDataFrame([("c", "files", "b", 1), ("c", "files", "a", 2)], "course_id string, source_section string, title string, seq int"), F.lit(0)).orderBy("nth").first().title == "a"


def test_table_versions(spark, tmp_path):
    from quillmill.sources import tables

    root = str(tmp_path / "t")
    for k in range(4):
        tables.overwrite(spark.createDataFrame([(k,)], "k int"), root)
    fs, claim = tables._fs(spark, f"{root}/_claims/{5:012d}")
    fs.create(claim, False).close()  # another writer is about to write number 5
    tables.upsert(spark.createDataFrame([(9,)], "k int"), root, "k")
    assert sorted(r.k for r in tables.read(spark, root).collect()) == [3, 9] and tables.current(spark, root).split("/")[-1][0] == "v"
    assert tables.vacuum(spark, root) == 3 and tables.vacuum(spark, root) == 0
    assert sorted(r.k for r in tables.read(spark, root).collect()) == [3, 9]
