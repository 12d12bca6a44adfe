"""Token files, vector codes and hard negatives against brute force, on odd rows and on whole tables."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import hard_negatives, perfect_hash, queries, token_files, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(queries.BYTE_TOKENIZER)


# -- 11

#: Characters at which stretches begin or may not begin.
ODD = "ab zA's're.,!?\n\t\r é×÷ßĀ中🙂\xa0\u3000\u200b\u0301\x00\x1c\x85019²½_-"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from([*ODD, "<|endoftext|>"]), st.characters(exclude_categories=["Cs"])), max_size=60).map("".join), max_size=12))
def test_stretches_encode_as_whole_texts(encoder, texts):
    ids, n = encoder.encode(pa.array(texts, pa.string()), 2)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_encoder_forgets(encoder, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    texts = [f"word{i} and more{i}" for i in range(50)]
    for _ in range(2):
        ids, _ = encoder.encode(pa.array(texts), 2)
        assert ids.tolist() == sum((encoder.tokenizer.encode(t).ids + [2] for t in texts), [])


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 4096):
        h, g = rnd.integers(0, 2**64, (2, n), np.uint64)
        f = perfect_hash.build(h, g)
        assert sorted(perfect_hash.slots(f, h, g).tolist()) == list(range(n)) and len(f) <= 12 + 4 * 64 + n
    other = rnd.integers(0, 2**64, (2, 1000), np.uint64)
    at = perfect_hash.slots(f, *other)
    assert at.min() >= -1 and at.max() < 4096
    same = np.array([7, 7], np.uint64)
    with pytest.raises(ValueError):
        perfect_hash.build(same, same)


def _expect(encoder, rows, end):
    """(id, start, n, crc) of all documents; those that repeat an id may come in any order."""
    return [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [end]]]


@pytest.mark.parametrize("end", [2, 50256])
def test_token_files_of_odd_rows(spark, encoder, tmp_path, end):
    rows = [(None, "null id"), (5, None), (5, "a"), (5, "a"), (5, "b b"), (7, ""), (9, "<|endoftext|> x"), (-3, "é"), (2**40, "long " * 50_000), *[(100, "same")] * 60, *[(None, "null id")] * 7]
    rows += [(200 + i, f"text {i} " * (i % 5)) for i in range(50)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, ids string")
    path = str(tmp_path / "t")
    token_files.write(df, path, queries.BYTE_TOKENIZER, end, shard_bytes=120, bucket=8)
    shards = spark.read.parquet(f"{path}/shards").orderBy("shard").collect()
    assert len(shards) > 10 and [r.start for r in shards] == [sum(x.ids for x in shards[:k]) for k in range(len(shards))]
    asked = df.select("doc_id").unionByName(spark.createDataFrame([(12345,), (None,)], "doc_id long"))
    got = token_files.lookup(asked, path, read=50).orderBy("start").collect()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    key = lambda r: repr(r)
    assert sorted([(r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got], key=key) == sorted(_expect(encoder, rows, end), key=key)
    some = token_files.lookup(spark.createDataFrame([(7,), (7,), (31337,), (100,)], "doc_id long"), path)
    assert sorted((r.doc_id, r.n_tokens) for r in some.collect()) == [(7, 1), *[(100, 2)] * 60]
    token_files.write(df.limit(0), str(tmp_path / "empty"), queries.BYTE_TOKENIZER)
    assert token_files.lookup(asked, str(tmp_path / "empty")).count() == 0


def test_op11_on_a_whole_table(spark, encoder):
    t = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).sort_by("doc_id").to_pylist()
    want = _expect(encoder, [(r["doc_id"], r["text"]) for r in t], 2)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op11_token_files(spark, SF).orderBy("doc_id").collect()]
    assert got == [(i, sum(x[1] for x in want[:k]), n, c) for k, (i, n, c) in enumerate(want)]


# -- 12


def _lloyd(x, parts, entries, rounds):
    """Plain Lloyd: books (parts x entries x width), codes, errors. x: whole numbers, in order of id."""
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if k < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(axis=0) // len(own)
    return books, code, d.min(axis=2).sum(axis=1)


@pytest.mark.parametrize("kind", ["random", "few values", "clusters"])
def test_codes_are_those_of_plain_lloyd(spark, kind):
    rnd = np.random.default_rng(3)
    n = 700
    x = {"random": rnd.standard_normal((n, 16)), "few values": rnd.integers(-2, 2, (n, 16)) / 4, "clusters": rnd.standard_normal((9, 16))[rnd.integers(0, 9, n)] + 0.05 * rnd.standard_normal((n, 16))}[kind]
    df = spark.createDataFrame([(1000 - i, v.tolist(), int(i % 3) if i % 5 else None) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(5)
    rows, books = vector_codes.encode(df, parts=4, entries=8, rounds=5)
    q = np.floor(x * 4096).astype(np.int64)[::-1]
    want_books, code, error = _lloyd(q, 4, 8, 5)
    assert np.array_equal(books, want_books)
    got = rows.orderBy("vec_id").collect()
    assert [r.error for r in got] == error.tolist() and [list(r.code) for r in got] == code.tolist()


def test_yinyang_scans_less():
    """Bounds save most distances once the entries hardly move, and change nothing."""
    rnd = np.random.default_rng(2)
    x = rnd.integers(-2000, 2000, (4000, 8))
    book = x[:16].copy()
    group = vector_codes._groups(book, 4)
    own, up, low, _ = vector_codes.assign_part(x, book, group, None, None, None, np.zeros(16))
    moved = book + rnd.integers(-3, 4, book.shape)
    drift = np.sqrt(((moved - book) ** 2).sum(axis=1).astype(float))
    after, _, _, taken = vector_codes.assign_part(x, moved, group, own, up, low, drift)
    assert np.array_equal(after, ((x[:, None] - moved[None]) ** 2).sum(axis=2).argmin(axis=1)) and taken < 0.2 * len(x) * 16


def test_codes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5] * 9, 1), (None, [0.25] * 9, None), (2, None, 1), (3, [nan] * 9, 1), (4, [None] + [0.0] * 8, 2), (5, [inf] * 9, 2), (6, [-0.1] * 9, None), (6, [-0.1] * 9, None), (7, [0.0] * 9, 1)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    got = {(r.vec_id, r.code): (r.error, r.label_error) for r in vector_codes.digest(df).collect()}
    assert {k for k, _ in got} == {1, None, 6, 7} and vector_codes.digest(df).count() == 5 and set(got.values()) == {(0, 0)}
    assert vector_codes.digest(df.limit(0)).count() == 0 and vector_codes.digest(df.where("vec_id = 2")).count() == 0
    with pytest.raises(ValueError):
        vector_codes.digest(df.unionByName(spark.createDataFrame([(9, [1.0], 1, "", 0)], df.schema)))
    with pytest.raises(Exception, match="is not below"):
        vector_codes.digest(spark.createDataFrame([(9, [1e30], 1, "", 0)], df.schema)).collect()


# -- 13


def _mine(rows, anchors, positives=5, negatives=3, low=50, high=95):
    out = []
    for a, la, x in rows:
        if not anchors(a):
            continue
        scored = sorted((-int(np.dot(x, y)), b, lb) for b, lb, y in rows if b != a and len(x) == len(y))
        for s, p, _ in [t for t in scored if t[2] == la][:positives]:
            hit = [(b, -t) for t, b, lb in scored if lb != la and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k + 1, b, -s, t) for k, (b, t) in enumerate(hit)]
    return sorted(out)


@pytest.mark.parametrize(("block", "a_block", "chunk"), [(2048, 512, 32), (16, 4, 5)])
def test_negatives_are_those_of_brute_force(spark, block, a_block, chunk):
    rnd = np.random.default_rng(8)
    n = 260
    x = np.round(rnd.standard_normal((n, 12)) + 1.2, 1)
    x[40:60] = x[0]  # ties
    label = np.where(rnd.random(n) < 0.4, 0, rnd.integers(0, 60, n))  # one hot label, many small ones
    rows = [(i, int(label[i]), x[i].tolist()) for i in range(n)] + [(500 + i, 3, [0.5, 1.0]) for i in range(5)] + [(600, 3, []), (601, 3, [])]
    odd = [(None, 1, [1.0] * 12), (700, None, [1.0] * 12), (701, 1, None), (702, 1, [float("nan")] * 12), (703, 1, [None] * 12), (704, 1, [float("inf")] * 12), (7, int(label[7]) + 1, [9.0] * 12), (8, int(label[8]), x[8].tolist())]
    df = spark.createDataFrame([(i, lb, v, 1, "x") for i, lb, v in rows + odd], "vec_id long, label int, embedding array<double>, rank int, a string").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.expr("vec_id % 5 = 0"), F.col("label"), block=block, a_block=a_block, chunk=chunk).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = _mine([(i, lb, np.floor(256 * np.array(v)).astype(np.int64)) for i, lb, v in rows], lambda i: i % 5 == 0)
    assert got == want and len(want) > 100
    assert hard_negatives.mine(df.limit(0), F.lit(True), F.col("label")).count() == 0


def test_tiles_are_not_shuffled(spark):
    """What is shuffled grows with the rows, not with anchors x rows: here a million scores would be 8 MB."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def written() -> int:
        bus.waitUntilEmpty()
        each = store.executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    x = np.random.default_rng(3).standard_normal((2000, 64))
    df = spark.createDataFrame([(i, i % 10, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    before = written()
    assert hard_negatives.mine(df, F.expr("vec_id % 4 = 0"), F.col("label")).count() > 1000
    assert written() - before < 4_000_000


def test_products_are_exact():
    big = np.full((2, 3), float(1 << 27))
    assert hard_negatives.product(big, big).tolist() == [[3 << 54] * 2] * 2


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_hard_negatives"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert key(got) == key(want)


# -- 8, writing and equal rows


def test_shards_are_written_whole(spark, tmp_path):
    from quillmill.llm import sharding

    rows = [(i, f"text {i} " * (i % 9), 7 * i, f"s{i % 2}", i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, Shard string, slot int")
    sharding.write(df, str(tmp_path / "s"), 4)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert set(got.columns) == {*df.columns, "shard_"} and sorted(tuple(r) for r in got.select(*df.columns).collect()) == sorted(rows)
    assert got.select("shard_").distinct().count() == 4
    both = sharding.assign(df, 4, carry=("size", "Shard"))
    assert {(r.doc_id, r.size_, r.Shard_) for r in both.collect()} == {(r[0], r[2], r[3]) for r in rows}


def test_equal_rows_are_divided(spark):
    """A third of all rows are one and the same, others have no id and equal texts: no range holds them all."""
    from quillmill.llm import sharding

    df = spark.createDataFrame([(i, f"text number {i}") for i in range(2000)] + [(5, "the same row")] * 1500 + [(None, "no id")] * 1000, "doc_id long, text string").repartition(6)
    out = sharding.assign(df, 6)
    per = {r.shard: (r.b, r.n, r.top) for r in out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert len(per) == 6 and max(b for b, _, _ in per.values()) - min(b for b, _, _ in per.values()) <= 3 * 25 and all(n == top + 1 for _, n, top in per.values())
    keyed = df.select(F.xxhash64("text").alias("key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("ord"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), (F.octet_length("text") + 8).cast("long").alias("size")).persist()
    total = keyed.agg(F.sum("size")).first()[0]
    bounds = sharding._sampled_bounds(keyed, total, 64)
    assert keyed.withColumn("rng", sharding._range_of(bounds)).groupBy("rng").count().agg(F.max("count")).first()[0] < 400
