"""Page bodies, block trees and checks on small tables."""

from pyspark.sql import functions as F

from quillmill.operators import bodies, planning, trees


def test_bodies(spark):
    long = "".join(f"<p>line {i}</p>" for i in range(1200))
    rows = [
        ("file", "file_artifact", "up", "some text", "<h2>T</h2><p>a <b>b</b></p>", None, None), ("bare", "file_artifact", None, None, None, None, None), ("out", "external_resource", None, None, None, None, None),
        ("page", "canvas_page", None, "", None, None, "one\n\ntwo"), ("long", "canvas_page", None, "x", long, None, None), ("own", "canvas_page", None, None, None, long, None), ("null", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "https://s.example.com", "n.pdf") for r in rows], "content_object_id string, content_type string, upload string, extracted_text string, extracted_html string, body_html string, body_text string, source_url string, file_name string")
    got = {}
    for r in bodies.rows(df, F.lit("now")).orderBy("content_object_id", "pos").collect():
        got.setdefault(r.content_object_id, []).append(r)
    origin = ["Canvas URL: https://s.example.com", "Source section: unknown", "Synced at: now"]
    texts = {k: [(r.type, r.text) for r in v] for k, v in got.items()}
    assert all([t for _, t in v[:3]] == origin for v in texts.values()) and all([r.pos for r in v] == list(range(len(v))) and all(r.batch == r.pos // 100 for r in v) for v in got.values())
    assert texts["file"][3:] == [("pdf", "n.pdf"), ("paragraph", "Artifact attached from https://s.example.com."), ("heading_2", "Extracted Content"), ("paragraph", "Extraction: extracted · 0 words · 0 chunks"), ("heading_2", "T"), ("paragraph", "a b")]
    assert [r.bold for r in got["file"][-1].runs] == [False, True]
    assert texts["bare"][3:] == [("paragraph", "Artifact not attached yet. Source: https://s.example.com.")] and texts["out"][3:] == [("paragraph", "External resource: https://s.example.com")]
    assert texts["page"][3:] == [("paragraph", "one"), ("paragraph", "two")] and texts["null"][3:] == []
    assert len(texts["long"]) == len(texts["own"]) == 1003 and texts["long"][-1][1] == "line 997" and texts["own"][-1][1] == "line 999"
    assert bodies.rows(df.limit(0), F.lit("now")).count() == 0


def test_trees(spark):
    chain = [("deep", i, i - 1 if i else None, 0, "paragraph", f"t{i}") for i in range(70)]
    rows = [("p", 1, None, 2, "paragraph", "b"), ("p", 2, None, 1, "heading_1", " a "), ("p", 3, 2, 5, "quote", "a2"), ("p", 4, 2, 5, "divider", "no"), ("p", 5, 2, 4, "paragraph", "a1"), ("p", 6, 99, 9, "paragraph", "lost"), ("p", 7, 8, 1, "paragraph", "round"), ("p", 8, 7, 1, "paragraph", "round"), ("p", 9, 5, None, "paragraph", " ")]
    df = spark.createDataFrame(chain + rows, "page_id string, block_id long, parent_id long, ord int, type string, text string").repartition(3)
    ordered = trees.in_order(df)
    got = {(r.page_id, r.block_id): (r.pos, r.depth) for r in ordered.collect()}
    assert {k: v for k, v in got.items() if k[0] == "p"} == {("p", 2): (0, 0), ("p", 5): (1, 1), ("p", 9): (2, 2), ("p", 3): (3, 1), ("p", 4): (4, 1), ("p", 1): (5, 0), ("p", 6): (6, 0)}
    assert all(got["deep", i] == (i, i) for i in range(70))
    assert [r.text for r in trees.texts(ordered).where("page_id = 'p'").orderBy("pos").collect()] == ["a", "a1", "a2", "b", "lost"]
    assert trees.in_order(df.limit(0)).count() == 0


def test_checks_in_one_scan(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, t string")
    out = planning.checks(df, {"texts": (F.coalesce("t", F.lit("")) == "", True), "odd": (F.col("k") % 2 == 1, False), "fine": (F.col("k") > 9, True)})
    assert sorted(tuple(r) for r in out.collect()) == [("fine", 3, 0, "ok"), ("odd", 3, 2, "warning"), ("texts", 3, 2, "blocked")]
    assert sorted(tuple(r) for r in planning.checks(df.limit(0), {"texts": (F.col("t") == "", True)}).collect()) == [("texts", 0, 0, "ok")]


def test_stored_plans_and_mappings(spark):
    raw = spark.createDataFrame([(" p ", "class_specific", "?", ["", "w", None]), ("", None, "content_ready", None)], "plan_id string, workspace_mode string, readiness_level string, warnings array<string>")
    got = [tuple(r) for r in planning.stored_plans(raw).collect()]
    assert got == [("p", None, "class_specific", "metadata_only", ["w"], []), (None, None, "general", "content_ready", [], [])]
    maps = spark.createDataFrame([(1, " x ", None, "", "db")], "k int, destination_page_id string, workspace_mode string, updated_at string, courses string")
    assert tuple(planning.stored_mappings(maps).first()) == (1, "x", "general", None, "db", None, None, None, None)
