"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by (hash of the text, id, a number of their own), so equal texts lie side by side and any number of equal
rows can be divided. A size-weighted sample
of these keys, of a size that does not grow with the data, gives quantile boundaries; they deal the
records into ranges, ranges that turn out overfull are divided at boundaries from a denser sample of
their own, and each range is sorted by itself. Byte counts of the ranges before it give every record its
exact place in the whole order, and so its shard: the shards' bytes differ by about one record.

The boundaries only decide which task sorts what. The result depends on the records alone.

Defined cases: a null text has no bytes; a null id sorts before all ids; equal rows take neighbouring
slots, in any order; an empty table gives an empty result; a group of equal texts larger than a shard spans several, and so
do equal rows; one very long text is one record, whose shard is that much larger; columns that are carried along keep their
names, with a "_" where the result has such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import cut, fresh, shuffle_partitions

#: Keys in the sample, about; at most so many ranges.
SAMPLE, RANGES = 8192, 1024
#: Bytes that each record takes besides its text.
OVERHEAD = 8


_KEY = ("key", "ord", "salt")
_RESULT = ("size", "text_crc32", "shard", "slot")


def _sampled_bounds(rows: DataFrame, total: int, ranges: int, sample: int = SAMPLE) -> list[tuple[int, int, int]]:
    """Up to ranges - 1 keys (hash, id, number) that part `rows`, `total` bytes in all, into even ranges."""
    chance = F.col("size") * F.lit(sample / total)
    u = (F.xxhash64(*_KEY, F.lit("sample")).cast("double") / F.lit(2.0**64)) + 0.5
    drawn = rows.where(u < chance).select(*_KEY, F.greatest(chance, F.lit(1.0)).alias("w"))
    order = Window.orderBy(*_KEY)
    at = F.floor(F.sum("w").over(order) * ranges / F.greatest(F.sum("w").over(Window.partitionBy()), F.lit(1.0)))
    first = drawn.select(*_KEY, at.alias("at")).groupBy("at").agg(F.min(F.struct(*_KEY)).alias("k")).where("at > 0")
    return sorted(tuple(r.k) for r in first.collect())


def _range_of(bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted bounds are at most the row's (key, ord, salt): a binary search."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    entries = (", ".join(f"'{n}', {v}L" for n, v in zip(_KEY, b)) for b in bounds)
    keys = F.expr(f"array({', '.join(f'named_struct({e})' for e in entries)})")  # as text: a call for each number would take seconds
    row = F.struct(*[F.col(n) for n in _KEY])

    def step(lo: Column, jump: Column) -> Column:
        to = lo + jump
        return F.when((to <= len(bounds)) & (F.get(keys, to - 1) <= row), to).otherwise(lo)

    return F.aggregate(F.array(*[F.lit(1 << s) for s in reversed(range(steps))]), F.lit(0), step)


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... in each
    shard), with the columns named in `carry`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long").alias("ord"), F.xxhash64(text).alias("key"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"), *[F.col(c).alias(f"carry_{c}") for c in carry],
    ))
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first().bytes
    ranges = min(RANGES // 2, max(4 * shards, 2 * shuffle_partitions(docs.sparkSession)))
    bounds = _sampled_bounds(rows, max(whole, 1), ranges)
    fair = max(1, whole // ranges)
    over = [r.rng for r in _totals(rows.withColumn("rng", _range_of(bounds))).where(F.col("bytes") > 2 * fair).collect()]
    if over:
        inner = rows.withColumn("rng", _range_of(bounds)).where(F.col("rng").isin(over))
        bounds = sorted({*bounds, *_sampled_bounds(inner, max(inner.agg(F.sum("size")).first()[0], 1), RANGES // 2)})
    dealt = rows.withColumn("rng", _range_of(bounds))
    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    starts = _totals(dealt).select(
        "rng", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0")
    )  # at most RANGES rows
    inside = Window.partitionBy("rng").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(Window.partitionBy("rng").orderBy(*_KEY)))
    placed = placed.join(F.broadcast(starts), "rng")
    middle = 2 * (F.col("bytes0") + F.col("upto")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2.0 * max(whole, 1)))).cast("int")
    placed = cut(placed.select("id", "size", "crc", *[f"carry_{c}" for c in carry], shard.alias("shard"), (F.col("n0") + F.col("nth") - 1).alias("place")))
    heads = placed.groupBy("shard").agg(F.min("place").alias("head"))  # a row per shard
    return placed.join(F.broadcast(heads), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("head")).alias("slot"), *[F.col(f"carry_{c}").alias(_free(c, id_col)) for c in carry]
    )


def _free(name: str, id_col: str) -> str:
    while name.lower() in (*_RESULT, id_col.lower()):
        name += "_"
    return name


def write(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Writes the records, whole and ordered by slot, into one folder per shard. The folders are named by a column `shard`, which gets
    another name if the records have such a column."""
    row, shard, slot = (fresh(docs, n) for n in ("__row", "shard", "slot"))
    out = assign(docs.withColumn(row, F.struct(*docs.columns)), shards, carry=(row,), **options)
    out = out.select(F.col("shard").alias("__s"), F.col("slot").alias("__n"), F.col(row).alias("__r")).select(F.col("__s").alias(shard), F.col("__n").alias(slot), "__r.*")
    out.repartition(shards, shard).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
