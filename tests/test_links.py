from pyspark.sql import functions as F

from quillmill.functions import render
from quillmill.operators import digests, links


def test_links(spark):
    o, rows = "https://s.example.com", [
        ("/courses/7/files/5?wrap=1", "Notes.pdf"), ("/courses/7/files/5/preview", "x"), ("/courses/7/quizzes/1", "Quiz"), ("/doc/a.docx", "A"), ("/courses/7/pages/intro", "Intro"),
    ]
    rows = [(1, i, o + u, t) for i, (u, t) in enumerate(rows)] + [(1, 5, "https://other.example.org/b.pdf", "B"), (1, 6, "https://www.x.com/me", "Follow us"), (1, 7, "https://other.example.org/read", "Read this"), (1, 8, None, "none")]
    df = spark.createDataFrame(rows, "page_id long, ord int, url string, label string").withColumn("page_url", F.lit(o + "/courses/7"))
    got = {r.ord: r for r in links.classify(df, F.lit(o), F.lit("7")).collect()}
    assert [got[i].kind for i in range(9)] == ["hosted", "hosted", "ignored", "document", "ignored", "external", "ignored", "ignored", None]
    assert got[0].target_url == o + "/courses/7/files/5/download?download_frd=1" and got[0].canonical_url == got[1].canonical_url == o + "/courses/7/files/5/download"
    assert got[0].file_name == "Notes.pdf" and got[5].mime == "application/pdf"
    assert [r.external_url for r in links.resources(df, F.lit(o), F.lit("7")).collect()] == ["https://other.example.org/read"]
    mode = lambda m: {r.ord for r in df.where(links.follows(F.col("url"), F.lit(o), F.lit("7"), F.lit(m))).collect()}
    assert mode("home") == {4} and mode("pages") == {4} and mode("assignments") == set() and mode("files") == set()


def test_rendering(spark):
    b = "array<struct<type:string,level:int,list_type:string,text:string>>"
    df = spark.createDataFrame([([("heading", 2, None, "A<b"), ("list_item", None, "numbered", "one"), ("paragraph", None, None, ""), ("quote", None, None, "q")],)], f"b {b}")
    got = df.select(render.blocks_text(F.col("b")).alias("t"), render.blocks_html(F.col("b")).alias("h"), render.bullet_list(F.array(F.lit("x&y")), "none").alias("l"), render.bullet_list(F.array().cast("array<string>"), "none").alias("n")).first()
    assert list(got) == ["A<b\n\n1. one\n\nq", "<h2>A&lt;b</h2><ol><li>one</li></ol><blockquote>q</blockquote>", "<ul><li>x&amp;y</li></ul>", "<p>none</p>"]
    lines = spark.range(1).select(render.provenance(F.lit("T"), F.lit(""), F.lit("home"), F.lit("now")).alias("p")).first().p
    blocks = spark.createDataFrame([("p", i, "paragraph", t) for i, t in enumerate([*lines, "body"])] + [("p", 9, "heading_2", "Head")], "page_id string, ord int, type string, text string")
    assert [tuple(r) for r in digests.page_context(blocks).collect()] == [("p", ["Head"], "body", "body")]
    rows = spark.createDataFrame([(1, "7", "Math", "page", "Linear Algebra", "matrix rank"), (2, "", "Art", "page", "Colour", "")], "seq long, course_id string, course_name string, content_type string, title string, text_snippet string")
    recap = {r.course_key: r for r in digests.recaps(rows).collect()}
    assert recap["7"].summary == "1 content items summarized for Math." and "<li>Linear Algebra (Page) - matrix rank</li>" in recap["7"].body_html
    assert digests.course_seed(rows).first().name == "Art"
