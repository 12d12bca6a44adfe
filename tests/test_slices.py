"""Batches are worked on in slices of a bounded size, with the results of whole batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillmill.functions import slices, text
from quillmill.sources import html, nodes


def test_slices_are_bounded():
    texts = pa.array(["ab"] * 10 + [None, "x" * 50, "", "y"] + ["cd"] * 30)
    seen = []
    out = list(slices.sliced(iter([(texts, pa.array(range(44))), (texts.slice(0, 0), pa.array([], pa.int64()))]), lambda t, i: seen.append(t) or i, 40))
    assert pa.concat_arrays(out).to_pylist() == list(range(44)) and len(out[-1]) == 0
    assert pa.concat_arrays(seen).to_pylist() == texts.to_pylist()
    assert max(len(t) for t in seen) <= 5 and [len(t) for t in seen if "x" * 50 in t.to_pylist()] == [1]


def test_hashes_in_slices(monkeypatch):
    """What one call to Python makes of texts stays small, however many rows a batch has."""
    most, plain = [], text._hashed
    monkeypatch.setattr(text, "_hashed", lambda t: most.append(t.nbytes) or plain(t))
    big = pa.array(["word " * 400] * 5000)
    got = pa.concat_arrays(slices.sliced(iter([(big,)]), text._hashed)).to_pylist()
    assert got == plain(big).to_pylist() and len(most) >= 9 and max(most) < 1_100_000


def test_pages_in_slices(spark):
    rows = [(i, "https://x.example.com/", f"<h1>t{i}</h1><p>{'word ' * 2000}</p><a href='/{i}'>l</a>" if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(1)
    assert df.select("page_id", html.title(F.col("html")).alias("t")).where("t <> concat('t', page_id) and page_id % 7 > 0").count() == 0
    blocks, links = html.page_rows(df)
    assert blocks.where("type = 'heading' and text = concat('t', page_id)").count() == links.where("href = concat('/', page_id)").count() == sum(i % 7 > 0 for i in range(400))
    assert nodes.node_rows(df).where("start = 0").count() == 400
