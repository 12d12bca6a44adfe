"""Blocks that hold blocks: a table of children put in document order, and read as text.

A block's place is its path, the positions of all that hold it and its own. Paths are built by pointer doubling: every block knows the
path from some block above it, and each round puts that block's own path before it, so a tree of depth d needs about log2(d) rounds of
one join each, and no page is ever walked in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import text
from quillmill.session import stored

# fixed values: the types of blocks whose text counts
TEXT_TYPES = ("paragraph", "heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item", "quote")


def in_order(blocks: DataFrame) -> DataFrame:
    """`blocks` (page_id, block_id, parent_id, ord, ...) with pos, its place in its page, depth-first, and depth. parent_id is null for a
    page's own blocks; children go by ord, then block_id.

    Defined cases: a block whose parent is not in its page stands at the top; blocks that hold each other in a circle are left out, with all
    below them; block ids are unique within a page; an empty table gives no rows."""
    own = blocks.select(F.col("page_id").alias("p"), F.col("block_id").alias("b"), F.col("parent_id").alias("up"), F.array(F.struct(F.coalesce("ord", F.lit(0)).cast("long").alias("o"), F.col("block_id").cast("string").alias("b"))).alias("path"))
    there = own.select(F.col("p").alias("tp"), F.col("b").alias("tb"))
    own = own.join(there, (F.col("p") == F.col("tp")) & (F.col("up") == F.col("tb")), "left").withColumn("up", F.col("tb")).drop("tp", "tb")
    at, n = stored(own), blocks.count()
    for _ in range(max(1, n).bit_length() + 1):
        if not at.where("up is not null").limit(1).count():
            break
        above = at.select(F.col("p").alias("ap"), F.col("b").alias("ab"), F.col("up").alias("aup"), F.col("path").alias("apath"))
        step = at.join(above, (F.col("p") == F.col("ap")) & (F.col("up") == F.col("ab")), "left")
        at = stored(step.select("p", "b", F.col("aup").alias("up"), F.when(F.col("ab").isNotNull(), F.concat("apath", "path")).otherwise(F.col("path")).alias("path")))
    pos = (F.row_number().over(Window.partitionBy("page_id").orderBy("__path")) - 1).cast("int")
    placed = blocks.join(at.where("up is null").select(F.col("p").alias("page_id"), F.col("b").alias("block_id"), F.col("path").alias("__path")), ["page_id", "block_id"])
    return placed.withColumns({"pos": pos, "depth": (F.size("__path") - 1).cast("int")}).drop("__path")


def texts(ordered: DataFrame) -> DataFrame:
    """(page_id, pos, type, text) of the blocks that have a text of a kind that counts."""
    return ordered.where(F.col("type").isin(*TEXT_TYPES)).select("page_id", "pos", "type", text("text").alias("text")).where("text <> ''")
