"""Mixing sources to target weights, with DataFrame operations only.

Words are summed per source; a repetition rate (target / words) follows for each source, and every
document is taken floor(rate) times plus once more with the rate's fraction as probability. That
one draw is a hash of seed and id, so reruns and retried tasks agree.

Targets: source i of weight w(i) gets level * w(i), at most `most` times its own words, where the level
is such that all targets sum to all words. That is where "share by weight, cap, share the excess
again" ends; it is found in one step by sorting sources by cap / weight.

Defined cases: null text has no words; the null source is a source of its own, last in order; sources
without words get target 0; equal rows draw alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import WORD, broadcast_if_small, cut, fresh

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size). One row per source is all that the
    windows below see; it is summed on the map side first. They run in one task, which sorts and spills: sources are meant
    to be collections or crawls, up to some 10^7, rather than single pages."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    # the first source that its own level does not cap has the highest such level
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    per = per.withColumn("level", F.max(fits).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), target / F.col("source_size"))).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def draw(id_: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with added columns, and their names by role: size (by default the text's words), source_size, target, copies."""
    names = {x: fresh(docs, f"__mix_{x}") for x in ("size", "source_size", "target", "copies", "source", "rate")}
    sized = docs.withColumn(names["size"], word_count(F.col(text_col)) if size is None else size)
    per = cut(targets(sized.select(F.col(source_col).cast("string").alias("source"), F.col(names["size"]).alias("size")), weights, most))
    per = per.select(*[F.col(x).alias(names[x]) for x in ("source", "source_size", "target", "rate")])
    out = sized.join(broadcast_if_small(per), F.col(source_col).cast("string").eqNullSafe(F.col(names["source"])))
    rate = F.col(names["rate"])
    copies = F.floor(rate) + F.when(draw(F.col(id_col), seed) < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn(names["copies"], copies.cast("int")), names


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of `docs`, each as often as it is taken, columns unchanged."""
    out, names = plan(docs, **options)
    return out.where(F.col(names["copies"]) > 0).withColumn(names["copies"], F.explode(F.array_repeat(F.lit(1), F.col(names["copies"])))).select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted). Texts are read once."""
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("words")))
    out, names = plan(rows, id_col="id", size=F.col("words"), **options)
    return out.select(
        F.col("id").alias(id_col), F.col(names["size"]).alias("size"), F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"),
        (F.col(names["size"]) * F.col(names["copies"])).cast("long").alias("taken"),
    )


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0 * CAST(source_size AS DOUBLE) AS cap FROM per),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per)
     - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed),
found AS (SELECT max(lv) AS level FROM levels WHERE lv <= cap / w),
rated AS (
  SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target,
    CASE WHEN source_size > 0 THEN least(3.0, least(cap, coalesce(level * w, cap)) / source_size) ELSE 0.0 END AS rate
  FROM levels, found)
SELECT s.doc_id, s.size, r.source_size, r.target,
  CAST(s.size * (floor(r.rate) + CASE WHEN CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0
     < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""
