"""The corpus operators against brute force, on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import ann, bloom, components, exact_dedup, jaccard, line_dedup, mixing, queries, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, text_sha256 string, size int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 7) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    out = [(None, "null id", "a"), (1, None, None), (2, "", "a"), (3, "   \n\t ", "b"), (4, "one two", "b"), (5, "One TWO", "b"), (6, "x", "a")]
    for i in range(150):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        out.append((10 + i, (" " if i % 7 else "\n").join(words), rnd.choice(["a", "a", "a", "b", "c", None])))
    out.append(out[20])  # a repeated row
    out.append((500, "long " * 30_000, "c"))
    return out


def test_bloom_never_misses(spark, rows):
    df = _docs(spark, rows)
    count = collections.Counter(t for _, t, _ in rows if t is not None)
    for keys in (None, 1, 100_000):  # of one page and of many
        seen = {r.text for r in bloom.flag(df, F.col("text"), bloom.of_repeated(df, F.col("text"), keys), "again").where("again").collect()}
        assert {t for t, n in count.items() if n > 1} <= seen and len(seen) < len(count) / 2
    some = df.where("doc_id % 3 = 0")
    passed = {r.doc_id for r in bloom.flag(df, F.col("doc_id"), bloom.of_keys(some, F.col("doc_id")), "in").where("in").collect()}
    assert {i for i, _, _ in rows if i is not None and i % 3 == 0} <= passed and len(passed) < 0.5 * len(rows)
    assert bloom.flag(df, F.col("doc_id"), bloom.of_keys(some.limit(0), F.col("doc_id")), "in").where("in").count() == 0


def test_bloom_packs_what_a_task_hits():
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    h = rnd.integers(-(2**63), 2**63 - 1, (2, 500))
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["h", "g"])
    out = pa.Table.from_batches(list(bloom._pack(iter([batch(h), batch(h[:, :7])]), 20)))
    assert out["page"].to_pylist() == sorted(set((h[0] % 20).tolist())) and sum(len(x) for x in out["once"].to_pylist()) <= 2 * 2 * 500
    assert 2 * 2 * 7 <= sum(len(x) for x in out["twice"].to_pylist()) < 2 * 2 * 60


def test_exact_dedup(spark, rows):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    got = exact_dedup.mark(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    kept = exact_dedup.drop(_docs(spark, rows)).collect()
    assert sorted((r.text or "") for r in kept) == sorted(groups)
    assert exact_dedup.mark(_docs(spark, [])).count() == 0 and exact_dedup.drop(_docs(spark, [])).count() == 0


def test_mixing(spark, rows):
    got = mixing.report(_docs(spark, rows)).collect()
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [1, 2, 3][k % 3] for k, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    while free:  # share, cap, share the excess again
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
    by_id = {i: (t, s) for i, t, s in rows}
    for r in got:
        t, s = by_id[r.doc_id]
        assert r.size == len(WORD.findall(t or "")) and r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
    mixed = mixing.mix(_docs(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "text_sha256", "size"]
    assert mixed.agg(F.coalesce(F.sum(mixing.word_count(F.col("text"))), F.lit(0))).first()[0] == sum(r.taken for r in got)
    assert mixing.report(_docs(spark, [])).count() == 0


def test_mixing_reaches_targets(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    for r in mixing.report(df).join(df, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.05)


def test_sharding(spark, rows):
    for n in (1, 5, 24):
        got = sharding.assign(_docs(spark, rows), n).collect()
        assert len(got) == len(rows)
        size = collections.Counter()
        slots = collections.defaultdict(list)
        for r in got:
            size[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        share, largest = sum(size.values()) / n, max(r.size for r in got)
        assert all(0 <= k < n and abs(v - share) <= largest for k, v in size.items())
    import zlib

    for r in got:
        texts = [t or "" for i, t, _ in rows if i == r.doc_id]
        assert r.text_crc32 in {zlib.crc32(t.encode()) for t in texts} and r.size in {len(t.encode()) + 8 for t in texts}
    assert sharding.assign(_docs(spark, []), 3).count() == 0


def test_sharding_divides_a_large_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    size = [r.b for r in sharding.assign(df, 6).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 6 and max(size) - min(size) <= 2 * 17


def _drop_lines(rows):
    keys = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    lowest = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                keys[key(line)].add(lowest(i))
    return lambda i, t: [line for line in (t or "").split("\n") if not (len(keys.get(key(line), ())) >= 3 and max(keys[key(line)]) != lowest(i))]


def test_line_dedup(spark):
    rnd = random.Random(3)
    lines = [f"line number {i} with some more of it" for i in range(30)] + ["short", "", "  Line NUMBER 1 with some more of it \t", "é" * 20, "é" * 19]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 12)))) for i in range(80)] + [(None, "line number 1 with some more of it"), (90, None), (91, "\n".join(["line number 2 with some more of it"] * 3))]
    docs += [docs[5], (92, "line number 3 with some more of it\n" * 30_000 + "end"), (92, "another text of id 92\nline number 4 with some more of it"), (93, "line number 3 with some more of it " * 20_000)]
    kept = _drop_lines(docs)
    expect = collections.Counter((i, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept(i, t)), hashlib.sha256("\n".join(kept(i, t)).encode()).hexdigest()) for i, t in docs)
    clash = "doc_id long, text string, row string, keep int, n_lines string, h1 string"
    df = spark.createDataFrame([(*d, "x", 1, "y", "z") for d in docs], clash)
    for most in (line_dedup.BROADCAST, 0):  # bitmaps go to the texts, or texts to the bitmaps
        assert collections.Counter(tuple(r) for r in line_dedup.digest(df, broadcast=most).collect()) == expect
    bits = line_dedup.keep_bitmaps(df).collect()
    assert collections.Counter((r.doc, r.n_dropped) for r in bits) == collections.Counter((-(2**63) if i is None else i, n) for i, _, n, _ in {*expect} if n)
    for r in bits:
        b = line_dedup._bits(r.keep)
        assert len(b) - b.sum() == r.n_dropped > 0
    assert line_dedup.digest(df.limit(0)).count() == 0


def test_line_streams_hand_over_runs():
    """A key spread over several partitions, and one too long to hold, are passed on whole."""
    import pyarrow as pa

    rows = sorted([(k, 0, -d, d, p) for k in range(5) for d in range(k + 1) for p in range(2)])
    table = [np.array([r[c] for r in rows]) for c in range(5)]
    table[2] = -table[2]
    names = list(line_dedup._KEY)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + 7].astype(np.int64)) for c in table], names=names) for a in range(0, len(rows), 7)]
    out = pa.Table.from_batches(list(line_dedup._first_occurrences(iter(batches), 3)))
    settled = out.filter(out["settled"])
    ends = out.filter(pa.compute.invert(out["settled"]))
    assert set(ends["h1"].to_pylist()) == {0, 4} and set(settled["h1"].to_pylist()) == {2, 3}
    assert settled.num_rows == 2 * 2 + 3 * 2 and ends.num_rows == 2 + 10


def _sets(rows):
    low = {c: c + 32 for c in range(65, 91)}
    out = []
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(low))
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def _brute(sets):
    ids = [i for i, _ in sets]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(sets[a][0]), find(sets[b][0])
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids if i is not None}


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_join(spark, rows, block):
    """With blocks of four, groups go through the tiles of large groups."""
    got = jaccard.join(_docs(spark, rows), block=block).collect()
    sets = _sets(rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((i, len(s)) for i, s in sets)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == _brute(sets)


def test_jaccard_of_repeated_ids(spark):
    a, b, c = ("a b c d e f g h i j k l", "n o p q r s t u v w x y", "lone words that no other text has at all")
    rows = [(3, a, ""), (7, a, ""), (7, b, ""), (5, b, ""), (7, c, ""), (9, c + " but", ""), (4, c, ""), (8, None, ""), (8, a + " m", ""), (1, "x", "")]
    got = jaccard.join(_docs(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((i, len(s)) for i, s in _sets(rows))
    expect = _brute(_sets(rows))
    assert expect[9] == expect[8] == expect[7] == 3 and all(r.component_id == expect[r.doc_id] for r in got)


def test_jaccard_keeps_one_of_each_component(spark, rows):
    kept = jaccard.drop_linked(_docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "text_sha256", "size"]
    roots = set(_brute(_sets(rows)).values())
    assert {r.doc_id for r in kept.collect()} == roots | {None}
    assert jaccard.join(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components(spark, monkeypatch, few):
    """With few = 0, hubs are told apart, as in large tables."""
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "HUBS", 20)
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(45)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        root[max(u, v)] = min(u, v)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity_on_held_out_labels(spark):
    rnd = random.Random(2)
    words, bad = [f"word{chr(97 + i % 26)}{i}" for i in range(500)], ["vilething", "nastyone", "awfulness", "grimword"]
    docs, labels = [], []
    for i in range(1200):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 200))]
        toxic = i % 6 == 0
        for _ in range(rnd.randint(2, 8) if toxic else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(bad) + rnd.choice(["", "s", ",", "!!"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), docs[3]]
    labels += [(None, 1), (9999, 1), (4, None)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, grade int")
    model = toxicity.fit(d, lab.where("doc_id is null or doc_id < 800 or doc_id > 5000"), split_flag=True)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = toxicity.predict(d, model).collect()
    assert len(got) == len(docs)
    held = [r for r in got if 800 <= r.doc_id < 1200]
    assert np.mean([(r.p_toxic >= 0.5) == (r.doc_id % 6 == 0) for r in held]) > 0.98
    assert all(0 <= r.severity <= 2 for r in got) and all(r.p_toxic < 0.5 for r in got if r.doc_id >= 5000)
    for r in got[:40] + got[-3:]:  # plain scoring, token by token
        linear = 0.0
        for f, w in zip(model.features.tolist(), model.weights.tolist()):
            tokens = {t for t in WORD.findall((dict(docs)[r.doc_id] or "").lower()) if f in toxicity._features([t])[1].tolist()}
            linear += w * np.log2(1 + len(tokens))
        reach = 1 / (1 + np.exp(-(linear - model.thresholds)))
        assert abs(r.severity - reach.sum()) < 1e-9 and abs(r.p_toxic - reach[0]) < 1e-9
    long = spark.createDataFrame([(1, ("vilething " * 3 + "word ") * 50_000, "x", "y")], "doc_id long, text string, severity string, __toxic_text string")
    told = toxicity.predict(long, model).first()
    assert told.p_toxic > 0 and told["__toxic_text"] == "y"
    again = toxicity.fit(d, lab.where("doc_id is null or doc_id < 800 or doc_id > 5000"), split_flag=True)
    assert np.array_equal(model.weights, again.weights)
    none = toxicity.fit(d, lab.limit(0))
    assert {r.severity for r in toxicity.predict(d, none).collect()} == {0.0}
    assert toxicity.predict(d.limit(0), model).count() == 0


def test_ordinal_fit_is_a_maximum(spark):
    """No step from the fitted parameters raises the penalised likelihood, reckoned row by row."""
    rnd = np.random.default_rng(3)
    n, k = 60, 4
    x = rnd.integers(0, 3, (n, k)).astype(float)
    grade = np.clip((x[:, 0] + x[:, 1] + rnd.normal(0, 0.8, n)).round().astype(int), 0, 2)
    row, feature = np.nonzero(x)
    model = toxicity._fit(n, row, feature, x[row, feature], grade, np.arange(k, dtype=np.uint64), rounds=4000)

    def loss(w, t):
        total = 0.15 * sum(v * v for v in w)
        for i in range(n):
            reach = [1.0, *[1 / (1 + np.exp(-(sum(w * x[i]) - c))) for c in t], 0.0]
            total -= np.log(reach[grade[i]] - reach[grade[i] + 1])
        return total

    best = loss(model.weights, model.thresholds)
    assert model.thresholds[0] < model.thresholds[1]
    for _ in range(60):
        dw, dt = rnd.normal(0, 0.05, k), rnd.normal(0, 0.05, 2)
        assert loss(model.weights + dw, model.thresholds + dt) > best - 1e-3


def test_ann(spark):
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((900, 16)).astype(np.float32)
    x[::3] = x[0]  # a third of all rows share a vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (2080, [], 1), (None, x[1].tolist(), 1), (2100, [1.0, 2.0], 1), (2120, [2.0, 2.0], 1), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.search(df, F.pmod("vec_id", F.lit(20)) == 0, block=200, chunk=20, least=100).collect()
    near = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        near[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    found = total = 0
    for q in range(0, 900, 20):
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        mine = near.pop(q)
        assert len(mine) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in mine)
        found, total = found + len({i for i, _ in mine} & set(best.tolist())), total + 20
    assert found / total >= 0.9
    assert near == {2100: [(2120, 6.0)], 2120: [(2100, 6.0)]}
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.25, 0.5, 1.0])
def test_ann_of_varied_lengths(spark, spread):
    rnd = np.random.default_rng(6)
    x = rnd.standard_normal((3000, 64))
    x *= (np.exp(spread * rnd.standard_normal(3000)) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = collections.defaultdict(set)
    for r in ann.search(df, F.pmod("vec_id", F.lit(20)) == 0).collect():
        near[r.query_id].add(r.vec_id)
    found = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        found += len(near[q] & set(np.argsort(-s)[:20].tolist()))
    assert found / (20 * 150) >= 0.95


def test_ann_on_whole_tables(spark):
    """Recall of the query on real tables, against all inner products."""
    import pyarrow.dataset as ds

    for sf, least in (("sf0.01", 1.0), ("sf0.1", 0.93)):
        t = ds.dataset(f"/root/testdata/{sf}/embeddings.parquet").to_table(columns=["vec_id", "embedding"])
        ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)
        near = collections.defaultdict(dict)
        for r in queries.op10_nearest_neighbours(spark, f"/root/testdata/{sf}").collect():
            near[r.query_id][r.rank] = (r.vec_id, r.score)
        found, asked = 0, np.flatnonzero(ids % 20 == 0)
        for q in asked:
            s = x @ x[q]
            s[q] = -np.inf
            mine = near[ids[q]]
            assert sorted(mine) == list(range(1, 21))
            found += len({i for i, _ in mine.values()} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        assert found / (20 * len(asked)) >= least
