"""Exact dedup by two-pass Bloom filtering.

Pass 1 notes, in a filter sized by the number of rows, which text hashes may occur twice. Pass 2 splits the
rows: those whose hash surely occurs once pass straight through, only the others shuffle by hash and are
grouped exactly by SHA-256 of the text. A group that holds a third of all rows is summed on the map
side; the join that hands its verdict back is a plain one, which Spark splits when it is skewed.

Defined cases: a null text counts as the empty text; equal rows (same id, same text) share a verdict
in mark(), while drop() keeps one row of them (where other columns differ, that with the largest hash of
these); rows with a null id lose against any id; an empty table gives an empty result; other columns are
ignored by mark() and kept by drop(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import bloom
from quillmill.llm.common import cut, fresh


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id (the largest id of equal texts), group_size, kept,
    text_sha256."""
    rows = cut(docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha")))
    rows_ = bloom.flag(rows, F.col("sha"), bloom.of_repeated(rows, F.col("sha")), "maybe")
    single = rows_.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    again = rows_.where("maybe").select("id", "sha")
    # cut() keeps the join's two sides plain exchanges, which Spark can split where a group is large
    groups = cut(again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
    multi = again.join(groups, "sha").select("id", "keep_id", "group_size", "sha")
    return single.unionByName(multi).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one row of equal texts each, that with the largest id. Texts of rows
    that surely have no equal are never shuffled."""
    sha, maybe, whole = (fresh(docs, f"__dedup_{x}") for x in ("sha", "maybe", "row"))
    hashed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    seen = bloom.of_repeated(hashed.select(sha), F.col(sha), docs.count())
    rows = bloom.flag(hashed, F.col(sha), seen, maybe)
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col(id_col).isNotNull(), F.col(id_col), F.xxhash64(*plain))
    best = rows.where(F.col(maybe)).groupBy(sha).agg(F.max_by(F.struct(*[docs[c] for c in docs.columns]), order).alias(whole))
    return rows.where(~F.col(maybe)).select(*docs.columns).unionByName(best.select(f"{whole}.*"))
