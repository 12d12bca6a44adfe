"""Encoding and counting against the library itself."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from quillmill.llm import sentencepiece_codec, spm, token_counts
from quillmill.llm.queries import TOKENIZER

TEXTS = ["", "a", " ", " a", "a ", "  a  b   ", "Hello world, the tokenization of Internationalization", "x\n\ty   z ★😀🤷‍♂️", "▁a▁▁b", "a" * 500, "the" * 300, " " * 40 + "x" + " " * 17, "ÀÉÎõü ñandú straße\x00x \x00", None]


@pytest.fixture(scope="module")
def bpe():
    with open(TOKENIZER, "rb") as f:
        data = f.read()
    return data, SentencePieceProcessor(model_proto=data)


@pytest.fixture(scope="module")
def unigram(bpe):
    """The same pieces as a unigram model."""
    m = pb.ModelProto()
    m.ParseFromString(bpe[0])
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = max(p.score, -40000.0)
    data = m.SerializeToString()
    return data, SentencePieceProcessor(model_proto=data)


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(1)
    parts = ["in", "ter", "na", "tion", "al", "iza", "the", "re", "un", "ing", "é", "x", "7", "-", ".", "Ü", "est", "he", "l"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(4000)]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_and_counts(kind, request, words):
    data, lib = request.getfixturevalue(kind)
    model = spm.parse(data)
    # double spaces score -40000 each in the unigram model, in the library's single precision too
    texts = [*(t for t in TEXTS if kind == "bpe" or t is None or "\n" not in t), *words, " ".join(words[:50])]
    offsets, ids = sentencepiece_codec.encode_texts(model, pa.array(texts, pa.string()))
    counts, _ = token_counts.count_texts(model, pa.array(texts, pa.string()))
    expect = [lib.encode(t or "") for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expect
    assert counts.tolist() == [len(e) for e in expect]
    assert sentencepiece_codec.decode_ids(model, offsets, ids) == [lib.decode(e) for e in expect]


def _long_words(kind):
    rnd = random.Random(3)
    draw = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    size = 192
    edges = [draw("etaoinshr", n) for n in (size - 2, size - 1, size, size + 1, 2 * size, 2 * size + 1, 1000)]
    more = [draw("ABab01+/xyzQ", 5000), draw("日本語中文人大小上下国会年月", 3000), draw("kq\u00e9\U0001f600z", 700), "the" * 900, draw("0123456789", 2000), "x" * 300 + "\x00" + "y" * 300]
    return [*edges, *more, *(["a" * 5000, "=" * 1000] if kind == "bpe" else [])]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_long_words(kind, request):
    data, lib = request.getfixturevalue(kind)
    model = spm.parse(data)
    words = _long_words(kind)
    texts = [*words, "some text " + " and ".join(words[:3]) + " end"]
    offsets, ids = sentencepiece_codec.encode_texts(model, pa.array(texts))
    counts, scores = token_counts.count_texts(model, pa.array(texts))
    expect = [lib.encode(t) for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expect
    assert counts.tolist() == [len(e) for e in expect]
    alone = [token_counts._count_alone(model, spm.SPACE + w) for w in words]
    assert np.allclose(scores[: len(words)], [s for _, s in alone]) and counts[: len(words)].tolist() == [n for n, _ in alone]
    long = [np.frombuffer((spm.SPACE + w).encode("utf-32-le"), np.uint32) for w in words if len(w) >= 192]
    agree = [t is not None for t in sentencepiece_codec._search_segments(model, long)]
    assert np.mean(agree) > 0.7
    if kind == "bpe":
        assert not all(agree)  # "aaa..." never agrees, and is merged by itself


def test_settled_pairs_agree_with_merging(bpe, words):
    model = spm.parse(bpe[0])
    for w in words[:300]:
        inner = np.array(model.encode_scalar(spm.SPACE + w))
        assert model.settled(inner[:-1], inner[1:]).all() if len(inner) > 1 else True


def test_frames(spark, bpe):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "", "x")], "doc_id long, text string, n_tokens string")
    coded = sentencepiece_codec.encode(df, TOKENIZER)
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.token_ids == bpe[1].encode(r.text or "") and r.n_tokens == len(r.token_ids) for r in rows)
    back = sentencepiece_codec.decode(coded, TOKENIZER).collect()
    assert all(r.decoded == bpe[1].decode(bpe[1].encode(r.text or "")) for r in back)
    counted = token_counts.count(df, TOKENIZER).collect()
    assert all(r.n_tokens == len(bpe[1].encode(r.text or "")) for r in counted)
    trip = sentencepiece_codec.round_trip(df, TOKENIZER)
    assert trip.where(~F.col("same")).count() == sum(bpe[1].decode(bpe[1].encode(t or "")) != (t or "") for t in TEXTS)
    for f in (sentencepiece_codec.encode, token_counts.count, sentencepiece_codec.round_trip):
        assert f(df.limit(0), TOKENIZER).count() == 0
    long = spark.createDataFrame([(1, "word and " * 200_000)], "doc_id long, text string")
    assert token_counts.count(long, TOKENIZER).first().n_tokens == sentencepiece_codec.round_trip(long, TOKENIZER).first().n_tokens
