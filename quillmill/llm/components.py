"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round is two aggregations and two joins over the edges; the edge table never grows, every round is
written to the checkpoint folder, and the number of rounds is logarithmic in the longest chain.

A hub with many edges would be one task of such a join. As long as all edges are few, the minima are no more, and are
broadcast. Beyond that, the hubs above 1/50,000 of all rows are fewer than 50,000: their minima are broadcast,
their edges stay where they are, and the others' edges are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import stored

#: Rows whose minima are broadcast without a look at hubs (16 bytes each); hubs that are broadcast at most.
FEW, HUBS = 200_000, 50_000


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r.n, r.x


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """(u, v, m) from `n` rows (u, v) at most: m is the smallest v of the row's u."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    if n <= FEW:
        return rows.join(F.broadcast(least.select("u", "m")), "u")
    least, bar = stored(least), n // HUBS
    hubs = least.where(F.col("k") > bar).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    out = rows.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    near = out.where("hub is null").select("u", "v").join(least.where(F.col("k") <= bar).select("u", "m"), "u")
    return near.unionByName(out.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (u, v): component is the smallest id that can be reached.
    Ids that are no component's smallest come once; the smallest ones are left out."""
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = _with_least(stored(large), 2 * before[0])
        small = low.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        e = stored(small.where("u <> v").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
