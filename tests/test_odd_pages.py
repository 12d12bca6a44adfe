"""Queries over pages whose URLs come again, and whose titles were cut in the middle of a character reference, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.operators import scan
from quillmill.plans import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    page = "<!DOCTYPE html><html><head><title>{0}</title></head><body><nav><ul><li><a href=\"/a\">x</a></li></ul></nav><h1>{0}</h1><article><p>{1}</p></article><footer>f</footer></body></html>"
    heads = ["a &amp; b", "cut &amp", "cut &am", "two &amp;&amp", "&quot;q&quot", "R&D"]
    rows = [(i, f"https://x.example.com/en/{i % 4}", page.format(heads[i % len(heads)], f"word{i} &amp; more")) for i in range(24)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(i, f"text {i}\n\nmore", "en", "src1", 12) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.mark.parametrize("name", ["page_scan_results", "page_block_rows", "page_facts", "extract_documents", "extraction_jobs"])
def test_against_sql(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("pages", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want)) and want


def test_a_result_stays_one_row(spark):
    rows = spark.createDataFrame([("u", True, "", "", "", "t"), ("v", True, "", "own", "n", "t")], "page_url string, ok boolean, error string, course_id string, course_name string, title string")
    context = spark.createDataFrame([("u", "2", "B"), ("u", "1", "A"), ("v", "3", "C")], "page_url string, course_id string, course_name string")
    good, _ = scan.page_results(rows, context)
    assert sorted((r.page_url, r.course_id, r.course_name) for r in good.select("page_url", "course_id", F.col("course_name")).collect()) == [("u", "1", "A"), ("v", "own", "n")]
