"""Hard negatives of anchors, by block products of the score matrix anchors x rows.

Every component x becomes floor(scale * x), and scores are inner products of these whole numbers. The matrix is computed as
SUMMA does it (van de Geijn and Watts, 1997): anchors are dealt into block rows, all rows into block columns, and the tile
of a block row and a block column stays where it is: its task adds up the products of one panel of dimensions after the other, in
stripes of a bounded size. Tiles are never shuffled; a tile keeps only the best of each anchor:

1. The positives, from tiles within a label: each anchor's best rows of its label. Labels that fill blocks of their own have
   them; smaller labels share blocks by hash.
2. The negatives, from all tiles: for each anchor and positive the best rows of other labels whose score lies in the
   window that the positive's score sets.

The best of all tiles are merged. No tile is larger than about A_BLOCK x BLOCK, whatever a label's or the table's size; an anchor block
travels to every block column, and the other way round, in the smallest whole numbers that hold the components. Work is in proportion to
anchors x rows, as an exact answer over all rows demands; what is shuffled is, per row, its vector for every A_BLOCK anchors, and per anchor
its vector and its best for every BLOCK rows.

Defined cases: rows with a null id, a null label, or a vector that is null or holds null or non-finite components take no part; of rows that
repeat an id the one with the smallest label, then vector, does; only vectors of one length compare, empty ones with
score 0; a positive with a negative score has an empty window; an anchor without positives, and a positive without
negatives in its window, give no rows; ties go to the smaller id; numbers too large for exact 64-bit scores are an error; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import broadcast_if_small, stored
from quillmill.llm.vector_codes import finite

#: Rows of a block column, anchors of a block row, dimensions of a panel.
BLOCK, A_BLOCK, CHUNK = 32768, 8192, 64
#: Rows below which a block is not divided for the sake of more tasks; components of a block; scores of a stripe.
LEAST, VALUES, STRIPE = 2048, 1 << 22, 1 << 21
_KEY = ["dims", "a", "b"]


def _matrix(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and components, in order of id."""
    ids = side.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    v = side.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids[order], side.column("label").to_numpy()[order], v[order]


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x times y transposed, whole numbers. In doubles where all sums are exact, in 64-bit integers else."""
    most = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, x.shape[1])
    return (x @ y.T).astype(np.int64) if most < 2.0**53 else x.astype(np.int64) @ y.astype(np.int64).T


def _stripes(a: np.ndarray, x: np.ndarray, y: np.ndarray, chunk: int) -> Iterator[tuple[int, np.ndarray]]:
    """The tile of x and y, a few anchors at a time: (anchor, its scores). The panels' products are added up in place."""
    step = max(1, STRIPE // max(1, len(y)))
    for at in range(0, len(a), step):
        score = product(x[at : at + step, :chunk], y[:, :chunk])
        for k in range(chunk, x.shape[1], chunk):
            score += product(x[at : at + step, k : k + chunk], y[:, k : k + chunk])
        yield from enumerate(score, at)


def _best(score: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of those, the best first."""
    if len(among) > 4 * k:
        bar = np.partition(score[among], len(among) - k)[len(among) - k]
        among = among[score[among] >= bar]
    return among[np.lexsort((ids[among], -score[among]))[:k]]


def _table(out: list[np.ndarray], names: list[str]) -> pa.Table:
    return pa.table(list(np.concatenate([np.empty((len(names), 0), np.int64), *out], axis=1)), names=names)


def _positives(left: pa.Table, right: pa.Table, k: int, chunk: int) -> pa.Table:
    out = []
    if left.num_rows and right.num_rows:
        (a, la, x), (b, lb, y) = _matrix(left), _matrix(right)
        for i, score in _stripes(a, x, y, chunk):
            best = _best(score, b, np.flatnonzero((lb == la[i]) & (b != a[i])), k)
            out.append(np.array([np.full(len(best), a[i]), b[best], score[best]]))
    return _table(out, ["anchor", "id", "score"])


def _negatives(left: pa.Table, right: pa.Table, k: int, low: int, high: int, chunk: int) -> pa.Table:
    out = []
    if left.num_rows and right.num_rows:
        (a, la, x), (b, lb, y) = _matrix(left), _matrix(right)
        order = np.argsort(left.column("id").to_numpy(), kind="stable")
        windows = left.column("windows").combine_chunks().take(pa.array(order))
        pairs = windows.flatten()
        ends, ids, scores = np.cumsum(windows.value_lengths().to_numpy()).tolist(), pairs.field("id").to_pylist(), pairs.field("score").to_pylist()
        for i, score in _stripes(a, x, y, chunk):
            begin = ends[i - 1] if i else 0
            own = [(p, s, -(-s * low // 100), s * high // 100) for p, s in zip(ids[begin : ends[i]], scores[begin : ends[i]])]
            among = np.flatnonzero((lb != la[i]) & (score >= min(w[2] for w in own)) & (score <= max(w[3] for w in own)))
            for p, s, least, most in own:
                best = _best(score, b, among[(score[among] >= least) & (score[among] <= most)], k)
                out.append(np.array([np.full(len(best), a[i]), np.full(len(best), p), np.full(len(best), s), b[best], score[best]]))
    return _table(out, ["anchor", "positive", "positive_score", "id", "score"])


def _tiles(left: DataFrame, right: DataFrame, best: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The best of each tile of two sides that carry (dims, a, b)."""
    left, right = (x.toDF(*x.columns) for x in (left, right))  # of one table: columns of their own
    return left.groupBy(*_KEY).cogroup(right.groupBy(*_KEY)).applyInArrow(best, schema)


def _deal(n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id"), n)


def _every(n: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda x: x.cast("string")))


def _within_labels(rows: DataFrame, block: int, a_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the tiles of anchors and rows of the same label (or of small labels that share a block)."""
    n = F.col("n")
    counts = stored(rows.groupBy("dims", F.col("label").alias("l")).agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("n_a")))
    small = counts.where(n < block).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_a")).first()
    packs = max(1, -(-small.n // block))
    big = broadcast_if_small(stored(counts.where(n >= block).withColumnRenamed("dims", "d")))
    home = F.when(n.isNull(), F.concat(F.lit("pack "), F.pmod(F.xxhash64("label"), F.lit(packs)).cast("string"))).otherwise(F.concat(F.lit("label "), F.col("label").cast("string")))
    up = lambda x, size, else_: F.coalesce(F.ceil(x / size), F.lit(max(1, else_)).cast("long"))
    at = rows.join(big, (F.col("label") == F.col("l")) & (F.col("dims") == F.col("d")), "left").select(
        "id", "label", "v", "dims", "anchor", home.alias("home"), up(n, block, 1).alias("columns"), F.greatest(up(F.col("n_a"), a_block, -(-small.n_a // (packs * a_block))), F.lit(1).cast("long")).alias("block_rows")
    )
    name = lambda x: F.concat_ws(" ", "home", x.cast("string"))
    left = at.where("anchor").select("id", "label", "v", "dims", name(_deal(F.col("block_rows"), 1)).alias("a"), "home", _every(F.col("columns")).alias("column"))
    right = at.select("id", "label", "v", "dims", name(_deal(F.col("columns"), 2)).alias("b"), "home", _every(F.col("block_rows")).alias("row"))
    return left.select("id", "label", "v", "dims", "a", name(F.col("column")).alias("b")), right.select("id", "label", "v", "dims", name(F.col("row")).alias("a"), "b")


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, a_block: int = A_BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its `positives` best
    rows of its label the `negatives` best rows of other labels whose score is `low` to `high` per cent of the positive's. `label`: an
    expression over the columns of `vectors`."""
    v = F.col(vector_col)
    q = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    one = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))).select("id", F.struct("label", q.alias("v"), "anchor").alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    rows = stored(one.select("id", "row.label", "row.v", "row.anchor", F.size("row.v").alias("dims")))
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("n_a"), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0)).alias("most"), F.coalesce(F.max("dims"), F.lit(0)).alias("dims")).first()
    if size.most**2 * max(1, size.dims) * max(1, high) >= 1 << 63:
        raise ValueError("scores of such large components do not fit 64 bits")
    small = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if size.most < 1 << bits)
    rows = rows.withColumn("v", F.col("v").cast(f"array<{small}>"))
    fits = max(1, VALUES // max(1, size.dims))
    block = min(block, fits, max(LEAST, -(-size.n // rows.sparkSession.sparkContext.defaultParallelism)))
    a_block = min(a_block, fits)
    near = _tiles(*_within_labels(rows, block, a_block), lambda a, b: _positives(a, b, positives, chunk), "anchor long, id long, score long")
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    windows = stored(near.withColumn("nth", nth).where(F.col("nth") <= positives).groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("windows")))
    block_rows, columns = (F.lit(max(1, -(-a // b))).cast("long") for a, b in ((size.n_a, a_block), (size.n, block)))
    anchors = rows.where("anchor").join(windows.withColumnRenamed("anchor", "of"), F.col("id") == F.col("of"))
    left = anchors.select("id", "label", "v", "dims", "windows", _deal(block_rows, 1).cast("string").alias("a"), _every(columns).alias("b"))
    right = rows.select("id", "label", "v", "dims", _every(block_rows).alias("a"), _deal(columns, 2).cast("string").alias("b"))
    far = _tiles(left, right, lambda a, b: _negatives(a, b, negatives, low, high, chunk), "anchor long, positive long, positive_score long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id"))
    return far.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, a.label <> b.label AS other, b.id AS b, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE NOT other QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.p AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.ps AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND s.other AND 50 * p.ps <= 100 * s.score AND 100 * s.score <= 95 * p.ps QUALIFY rank <= 3
"""
