"""The pipeline's stages on odd tables, and its rows against a plain Python version."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from quillmill.llm import exact_dedup, jaccard
from quillmill.llm.queries import TOKENIZER

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(corpus_pipeline.STAGES)


def _set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _near(rows):
    """Rows with one of each component of linked texts, that with the smallest id."""
    sets, root = [_set(r.text) for r in rows], {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 4 * len(x & y) >= 3 * len(x | y):
                u, v = find(rows[a].doc_id), find(rows[b].doc_id)
                root[max(u, v)] = min(u, v)
    return [r for r in rows if find(r.doc_id) == r.doc_id]


def _mixed(rows):
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, free = {s: k % 3 + 1 for k, s in enumerate(order)}, {}, set(order)
    while free:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else share
        free = free - over if over else set()
    out = []
    for r in rows:
        rate = min(3.0, target[r.source] / size[r.source]) if size[r.source] else 0.0
        draw = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        out += [r] * (int(rate) + (draw < rate - int(rate)))
    return out


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = STAGE["toxicity"](spark, docs, SMALL)
    assert clean.columns == docs.columns and clean.count() > 0.8 * docs.count()
    last = {}
    for r in sorted(clean.collect(), key=lambda r: r.doc_id):
        last[r.text or ""] = r
    rows = _mixed(_near(sorted(last.values(), key=lambda r: r.doc_id)))
    with open(TOKENIZER, "rb") as f:
        lib = SentencePieceProcessor(model_proto=f.read())
    expect = collections.Counter((r.doc_id, r.source, tuple(lib.encode(r.text or ""))) for r in rows)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert collections.Counter((r.doc_id, r.source, tuple(r.token_ids)) for r in got) == expect
    assert all(r.lossless and r.n_tokens == len(r.token_ids) for r in got)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "one two", "b"), (4, "one two", "b"), (5, "one two", "b"), (None, "one two", "b"), (None, "no id", "c"), (6, "long " * 40_000, "c"), (7, "x" * 50_000, "c"), (7, "another text of id seven", "c"),
    *[(10 + k, "a b c d e f g h i j k l m n o p" + " q" * k, "d") for k in range(3)], (20, "日本語のテキスト" * 300, "e"), (21, "ta\x00b \t mix", "e"),
]


@pytest.mark.parametrize("name", list(STAGE))
def test_odd_rows(spark, name):
    """Nulls, empty and long texts, ties, repeats and columns whose names clash, and no rows at all."""
    clash = ("token_ids", "n_tokens", "lossless", "toxicity_p_toxic", "__toxicity", "__mix_size", "h", "row")
    df = spark.createDataFrame([(*r, *[k] * len(clash)) for k, r in enumerate(ODD)], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in clash))
    out = STAGE[name](spark, df, SMALL)
    rows = out.collect()
    if name == "SentencePiece":
        assert [c for c in df.columns if c != "text"] == out.columns[:-3] and len(rows) == len(ODD)
        assert sorted(r.h for r in rows) == list(range(len(ODD))) and all(r.h == r.token_ids == r.lossless for r in rows)
        assert all(r["lossless_"] for r in rows)
    else:
        assert out.columns == df.columns
        assert all(ODD[r.h] == (r.doc_id, r.text, r.source) and r.h == r.row == r.toxicity_p_toxic for r in rows)
        kept = sorted(r.h for r in rows)
        if name == "toxicity":
            assert kept == list(range(len(ODD)))
        elif name == "exact dedup":
            assert len(kept) == len({t or "" for _, t, _ in ODD}) and {0, 1, 3, 4, 5, 6} & set(kept) == {1, 5}  # the largest id of equal texts
        elif name == "n-gram Jaccard join":
            # one of each component: that with the smallest id; rows without words, or without an id, link with nothing
            assert [ODD[k][0] for k in kept] == [1, 2, 3, 4, 4, None, None, 6, 7, 7, 10, 20, 21]
        else:
            assert set(collections.Counter(kept).values()) <= {1, 2, 3} and {ODD[k] for k in kept} <= set(ODD)
    assert STAGE[name](spark, df.limit(0), SMALL).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        seen[name] = out
        if name != "SentencePiece":
            assert out.columns == docs.columns
            docs = out
    assert seen["exact dedup"].groupBy("text").count().where("count > 1").count() == 0
    left = seen["n-gram Jaccard join"]
    assert jaccard.join(left).where("doc_id <> component_id").count() == 0
    assert exact_dedup.mark(left).where("not kept").count() == 0
    assert seen["SentencePiece"].where(~F.col("lossless")).count() == 0
    assert seen["SentencePiece"].count() == seen["mixing sources"].count() > 0
