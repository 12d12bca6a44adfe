"""Documents under several names, against a plain fold in order."""

import random

import pytest

from quillmill.operators import dedupe
from quillmill.plans import content

SCHEMA = "course_id string, course_name string, source_section string, source_page_title string, source_page_url string, file_name string, link_text string, folder_hint string, url string, canonical_url string, file_id string, is_hosted boolean, is_downloadable boolean, is_external boolean, discovered_at string, seq long"


def _fold(keyed):
    """{key of the group: (first seq, rows)}: each row joins the group of its first known name."""
    target, groups = {}, {}
    for r in sorted(keyed, key=lambda r: r.seq):
        names = [r.key, *([f"file:{r.scope}:{r.file_id}"] if r.file_id else []), *([f"url:{r.scope}:{r.canonical_url}"] if r.canonical_url else [])]
        group = next((target[n] for n in names if n in target), r.key)
        target.update(dict.fromkeys(names, group))
        groups.setdefault(group, []).append(r.seq)
    return {k: (min(v), len(v)) for k, v in groups.items()}


def _check(docs):
    want = _fold(dedupe.document_identity(docs).select("seq", "scope", "key", "file_id", "canonical_url").collect())
    assert {r.key: (r.seq, r.merged + 1) for r in dedupe.dedupe_documents(docs).collect()} == want
    return want


def _rows(seed, n, urls, files):
    rnd = random.Random(seed)
    for i in range(n):
        url, fid = rnd.choice([f"https://x.example.com/d{rnd.randrange(urls)}", ""]), rnd.choice([None, None, *(str(rnd.randrange(files)) for _ in range(3))])
        yield rnd.choice(["1", "2"]), "Course", "files", "t", "https://x.example.com/", f"f{rnd.randrange(30)}", "", "", url, "", fid, False, True, False, "2024-01-01", 3 * i


@pytest.mark.parametrize(("urls", "files", "span"), [(40, 20, 100_000), (400, 3, 50)])
def test_groups_are_those_of_a_fold(spark, monkeypatch, urls, files, span):
    monkeypatch.setattr(dedupe, "SPAN", span)  # a file id of many rows is looked through in spans
    groups = _check(spark.createDataFrame(list(_rows(urls, 300, urls, files)), SCHEMA))
    assert len(groups) < 150 and max(n for _, n in groups.values()) > 5


def test_a_long_chain(spark):
    """Every URL comes with the file id of the URL before it: one group, by pointer doubling."""
    rows = []
    for i in range(60):
        rows.append(("1", "Course", "files", "t", "https://x.example.com/", "f", "", "", f"https://x.example.com/d{i}", "", f"{i}", False, True, False, "2024-01-01", 2 * i))
        rows.append(("1", "Course", "files", "t", "https://x.example.com/", "f", "", "", f"https://x.example.com/d{i}", "", f"{i + 1}", False, True, False, "2024-01-01", 2 * i + 1))
    assert list(_check(spark.createDataFrame(rows, SCHEMA)).values()) == [(0, 120)]
    assert dedupe.dedupe_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    groups = _check(content.aliased_documents(spark, "/root/testdata/sf0.01"))
    assert len(groups) < 600
