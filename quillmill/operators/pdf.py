"""Positioned text items of PDF pages put together to lines and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import collapse

# fixed values: how far items of a line may differ in height; a break is a gap above this many line heights
NEAR, GAP, LEAST_HEIGHT = 2.5, 1.6, 10.0
_LINE = "struct<y:double,h:double,items:array<struct<x:double,seq:bigint,str:string>>>"


def _lines(items: Column) -> Column:
    """Items in order: an item joins the open line if it is near that line's first item."""
    start = F.array().cast(f"array<{_LINE}>")

    def step(acc: Column, i: Column) -> Column:
        item, last = F.struct(i["x"].alias("x"), i["seq"].alias("seq"), i["str"].alias("str")), F.try_element_at(acc, F.lit(-1))
        height = F.coalesce(i["height"], F.lit(0.0))
        joined = F.struct(last["y"].alias("y"), F.greatest(last["h"], height).alias("h"), F.concat(last["items"], F.array(item)).alias("items"))
        new = F.struct(i["y"].alias("y"), height.alias("h"), F.array(item).alias("items"))
        return F.when((F.size(acc) > 0) & (F.abs(i["y"] - last["y"]) <= NEAR), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(items, start, step)


def lines(items: DataFrame) -> DataFrame:
    """items: (doc_id, page, seq, str, x, y, height). (doc_id, page, line, y, height, text), items of a line from left to
    right."""
    kept = items.where(collapse(F.col("str")) != "")
    per = kept.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "str", "x", "y", "height"))).alias("items"))
    rows = per.select("doc_id", "page", F.posexplode(_lines(F.col("items"))).alias("line", "l"))
    words = F.transform(F.array_sort("l.items"), lambda i: collapse(i["str"]))
    return rows.select("doc_id", "page", "line", F.col("l.y").alias("y"), F.when(F.col("l.h") > 0, F.col("l.h")).otherwise(LEAST_HEIGHT).alias("height"), collapse(F.array_join(words, " ")).alias("text"))


def paragraphs(lines_: DataFrame) -> DataFrame:
    """(doc_id, page, paragraph, text): a gap above 1.6 line heights starts a paragraph."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    tall = F.greatest(F.lag("height").over(w), F.col("height"), F.lit(LEAST_HEIGHT))
    broken = F.coalesce((F.abs(F.lag("y").over(w) - F.col("y")) > tall * GAP).cast("int"), F.lit(0))
    islands = lines_.withColumn("__b", broken).withColumn("paragraph", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "page", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text"))
