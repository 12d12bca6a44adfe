"""Manifests of all versions give the same tables."""

import pytest

from quillmill.operators import manifest
from quillmill.plans import queries

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())


def test_versions_agree(spark, tmp_path):
    nested = spark.createDataFrame([("file_artifact:0", [("c0", 0, "x"), ("c1", 1, "y")]), ("file_artifact:1", [])], "content_object_id string, chunks array<struct<chunk_id:string,chunk_index:int,chunk_text:string>>")
    one = {"courses": queries._courses(spark, SF), "documents": queries._files(spark, SF), "content_items": queries._items(spark, SF), "records": queries._states(spark, SF), "chunks": nested}
    two = manifest._with_rows(one)
    three = manifest.current(one, 1)
    got = []
    for version, tables in ((1, one), (2, two), (3, three)):
        manifest.write(tables, str(tmp_path / str(version)), "now", version)
        got.append({n: _rows(t) for n, t in manifest.read(spark, str(tmp_path / str(version))).items()})
    assert got[0] == got[1] == got[2] and set(got[0]) == {*one, "documents_by_course", "inventory"}
    assert len(got[0]["chunks"]) == 2 and len(got[0]["inventory"]) > 200
    with pytest.raises(ValueError):
        manifest.current(one, 4)


def test_lists_come_in_parts(spark):
    docs = spark.range(2500).selectExpr("id AS seq", "concat('d', id) AS id", "CASE WHEN id % 10 < 8 THEN 'big' WHEN id % 10 = 8 THEN 'small' END AS course_id")
    out = manifest.documents_by_course(docs, 100).orderBy("course_id", "part").collect()
    assert max(r.n for r in out) <= 100 and [i for r in out if r.course_id == "big" for i in r.ids] == [f"d{i}" for i in range(2500) if i % 10 < 8] and {r.course_id for r in out} == {"big", "small"}
