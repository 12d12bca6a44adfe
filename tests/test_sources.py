import json

from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import runs
from quillmill.sources import records_json


def test_json_pages(spark):
    props = {
        "Title": {"type": "title", "title": [{"plain_text": "Home"}, {"text": {"content": "work "}}]}, "Due Date": {"type": "date", "date": {"start": "2024-01-15"}}, "Due Date Available": {"type": "checkbox", "checkbox": True}, "Canvas Course ID": {"type": "rich_text", "rich_text": [{"plain_text": "7"}]},
        "Processing Status": {"type": "select", "select": {"name": "planned"}}, "Source URL": {"type": "url", "url": None}, "Word Count": {"type": "number", "number": 12},
    }
    df = spark.createDataFrame([("p", "u", json.dumps(props)), ("q", "u", "{}")], "page_id string, url string, properties string")
    a, b = records_json.task_rows(df).orderBy("page_id").collect()
    assert (a.title, a.due_date, a.has_due_date, a.course_id, a.processing_status, a.source_url, a.automation_ready) == ("Homework", "2024-01-15", True, "7", "planned", "", False)
    assert (b.title, b.due_date, b.has_due_date) == ("Task", "", False)
    assert [r.word_count for r in records_json.content_rows(df).orderBy("page_id").collect()] == [12.0, 0.0]
    got = spark.createDataFrame([('{"a": 1}',), ("oops",), ("",)], "j string").select(records_json.tolerant(F.col("j"), "a int").alias("t")).select("t.*").collect()
    assert [r.raw_text for r in got] == [None, "oops", None] and got[0].value.a == 1


def test_ids_and_availability(spark):
    u = "0123456789abcdef0123456789ABCDEF"
    got = spark.range(1).select(text.uuid(F.lit(f"https://n.example.com/Page-{u}?v=1")).alias("a"), text.uuid(F.lit("https://n.example.com/x/last/?v=1")).alias("b"), text.mask(F.lit("secret_abcdef123456")).alias("c")).first()
    assert list(got) == ["01234567-89ab-cdef-0123-456789abcdef", "last", "secret…3456"]
    d = spark.createDataFrame([(True, "both", "workspace"), (False, "tasks", "course"), (True, "content", "course")], "enabled boolean, input_sources string, target_scope string")
    state = lambda token, dest, mapped, content, tasks, n: [r.label for r in runs.availability(d, F.lit(token), F.lit(dest), F.lit(mapped), F.lit(content), F.lit(tasks), F.lit(n)).collect()]
    assert state(True, "p", "p", "c", "t", 1) == ["Ready", "Disabled", "Ready"]
    assert state(True, "p", "q", "c", "t", 1)[0] == "Sync needed" and state(False, "p", "", "c", "t", 1)[0] == "Token needed"
    assert state(True, "p", "", "c", "", 0) == ["Deliverables DB missing", "Disabled", "Course needed"]
