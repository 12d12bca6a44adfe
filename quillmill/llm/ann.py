"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt into blocks of bounded size by a hash of their id. In its block every vector gets, per tree, a
string of sign bits of random projections; each tree is the sorted array of these strings. A query finds
the longest prefixes it shares in all trees, then ascends in all of them at once, bit by bit, until
the ranges under its prefixes hold enough visits. An entry that is visited in many trees lies at a small angle: the share
of trees gives the chance that one bit agrees, and so the angle; its cosine times the entry's length estimates the
inner product. The entries of the highest estimates are scored exactly, and with them the longest of all if lengths differ, as
estimates of wide angles are coarse. The best of all blocks are merged. The query set meets every block, in chunks: each
(block, chunk) is a group of its own.

Equal vectors of a block are one entry of its trees that lists its smallest ids, as many as can be among the
nearest, so a vector that a third of all rows share fills no range and costs one entry a block.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; rows
with a null id neither; only vectors of one length compare; rows that repeat id and vector count once, and rows
that repeat an id are never neighbours of each other; ties go to the smaller id; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows a block holds about; queries a chunk holds about.
BLOCK, CHUNK = 8192, 8192
#: Trees, and how many visits to a block's entries a query makes in all of them, as a multiple of their number.
TREES, VISITS = 128, 8
#: What a query scores of a block: this share of its entries, and this number at least; and this share of the entries, the
#: longest, for those that are longer than the shortest by more than EVEN.
SHARE, LEAST, LONGEST, EVEN = 0.15, 800, 0.05, 0.02
_BITS = 32


def _hashes(vectors: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """trees x rows: 32 sign bits each."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * _BITS)).astype(np.float32)
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    out = np.empty((trees, len(vectors)), np.uint32)
    for t in range(trees):
        bits = unit @ planes[:, t * _BITS : (t + 1) * _BITS] > 0
        out[t] = np.packbits(bits, axis=1).view(">u4")[:, 0]
    return out


def _ranges(forest: np.ndarray, queries: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """trees x queries: where the sorted strings lie that share the query's first `depth` bits."""
    low = ((np.uint64(1) << (_BITS - depth).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    first, last = queries & ~low, queries | low
    return np.array([np.searchsorted(t, q, "left") for t, q in zip(forest, first)]), np.array([np.searchsorted(t, q, "right") for t, q in zip(forest, last)])


def _depths(forest: np.ndarray, queries: np.ndarray, want: int) -> np.ndarray:
    """Per query the longest prefix under which the trees together hold `want` visits. Shorter prefixes hold more, so the
    ascent is found by halving."""
    lo, hi = np.zeros(queries.shape[1], np.int64), np.full(queries.shape[1], _BITS)
    while (lo < hi).any():
        at = (lo + hi + 1) // 2
        a, b = _ranges(forest, queries, at)
        enough = (b - a).sum(axis=0) >= want
        lo, hi = np.where(enough, at, lo), np.where(enough, hi, at - 1)
    return lo


def search_block(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, k: int, trees: int = TREES, visits: float = VISITS, share: float = SHARE, least: int = LEAST, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best of a block for each query, its own id left out."""
    order = np.lexsort((ids,))
    ids, vectors = ids[order], vectors[order].astype(np.float64) + 0.0
    _, first, entry = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    entry = entry.ravel()
    by_entry = np.argsort(entry, kind="stable")  # ids of an entry stay in order
    starts = np.searchsorted(entry[by_entry], np.arange(len(first) + 1))
    entries, n = vectors[first], len(first)
    want = min(n, max(least, int(share * n), 2 * (k + 1)))
    q_vectors = q_vectors.astype(np.float64) + 0.0
    scale = np.abs(entries).max()
    length = np.linalg.norm(entries / scale, axis=1)
    longest = np.argsort(-length, kind="stable")[: int(LONGEST * n)]
    longest = longest[length[longest] > length.min() * (1 + EVEN)]
    strings = _hashes(entries, trees, seed)
    sort = np.argsort(strings, axis=1, kind="stable")
    queries = _hashes(q_vectors, trees, seed)
    forest = np.take_along_axis(strings, sort, axis=1)
    depth = _depths(forest, queries, int(visits * n))
    lo, hi = _ranges(forest, queries, depth)
    share_of = np.arange(trees + 1) / trees
    cosine = {d: np.cos(np.pi * (1 - np.maximum(share_of, 0.5 / trees) ** (1 / max(d, 1)))) for d in np.unique(depth).tolist()}
    out_q, out_id, out_s = [], [], []
    for i, (d, a, b) in enumerate(zip(depth.tolist(), lo.T.tolist(), hi.T.tolist())):
        found = np.arange(n)
        if want < n:
            seen = np.bincount(np.concatenate([tree[x:y] for tree, x, y in zip(sort, a, b)]), minlength=n)
            found = np.argpartition(-cosine[d][seen] * length, want - 1)[:want]
            found = np.union1d(found, longest) if len(longest) else found
        score = entries[found] @ q_vectors[i]
        if len(found) > k + 1:  # all entries that may hold one of the best k ids, ties included
            keep = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            found, score = found[keep], score[keep]
        member = np.concatenate([by_entry[starts[e] : min(starts[e + 1], starts[e] + k + 1)] for e in found])
        score = np.repeat(score, np.minimum(starts[found + 1] - starts[found], k + 1))
        other = ids[member] != q_ids[i]
        member, score = member[other], score[other]
        best = np.lexsort((ids[member], -score))[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_id.append(ids[member[best]])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK, **options) -> DataFrame:
    """(query_id, rank, <id>, score): for each row that is a query its k nearest others found, by inner product in
    double precision."""
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(valid(v), F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dims"), F.coalesce(is_query, F.lit(False)).alias("q"))
    count = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    blocks, chunks = -(-max(1, count.n) // block), -(-max(1, count.q) // chunk)
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("id", "v", "dims", deal(blocks).alias("block"), every(chunks).alias("chunk"))
    asked = rows.where("q").select("id", "v", "dims", every(blocks).alias("block"), deal(chunks).alias("chunk"))

    def run(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if d.empty or q.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        found = search_block(d.id.to_numpy(), np.stack(d.v.to_numpy()), q.id.to_numpy(), np.stack(q.v.to_numpy()), k, **options)
        return pd.DataFrame(dict(zip(("q", "id", "score"), found)))

    key = ["dims", "block", "chunk"]
    near = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "q long, id long, score double")
    near = near.groupBy("q", "id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", nth).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
