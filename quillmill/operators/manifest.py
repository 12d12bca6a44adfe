"""A manifest: what a scan and the extraction came to, as one folder of tables with a version.

Older versions are brought forward on reading, one step per version, by the same operators that made the newer tables. Lists of a
course's documents come in parts of bounded length (the documents of a span of seq), so no course is ever one array.

    version 1   courses, documents, content_items; chunks nested by content (content_object_id, chunks)
    version 2   chunks as rows, documents_by_course in parts
    version 3   the inventory, with the state of extraction
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import extraction, inventory

VERSION = 3
#: Numbers of seq that a part of a list spans; at most so many documents.
PART = 1000
Tables = dict[str, DataFrame]


def documents_by_course(documents: DataFrame, part: int = PART) -> DataFrame:
    """(course_id, part, n, ids): ids in order of seq; parts in order give the whole list. documents: (id, course_id, seq), seq once
    each. Documents without a course are left out."""
    spans = documents.where("course_id is not null").groupBy("course_id", F.floor(F.col("seq") / part).cast("long").alias("part"))
    return spans.agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("ids"))


def _with_rows(t: Tables) -> Tables:
    """Version 1 to 2."""
    out = t | {"documents_by_course": documents_by_course(t["documents"])}
    if "chunks" in t:
        out["chunks"] = t["chunks"].select("content_object_id", F.explode("chunks").alias("c")).select("content_object_id", "c.*")
    return out


def _with_inventory(t: Tables) -> Tables:
    """Version 2 to 3. The state of extraction is taken from `records`, where the manifest has it."""
    rows = inventory.build(t["courses"], t["content_items"], t["documents"])
    return t | {"inventory": extraction.merge_state(rows, t["records"], t.get("chunks")) if "records" in t else rows}


_STEPS = {1: _with_rows, 2: _with_inventory}


def current(tables: Tables, version: int) -> Tables:
    """Tables of any version as those of the newest. A version that is not known is an error."""
    if version != VERSION and version not in _STEPS:
        raise ValueError(f"no manifest has version {version}")
    while version < VERSION:
        tables, version = _STEPS[version](tables), version + 1
    return tables


def write(tables: Tables, root: str, generated_at: str, version: int = VERSION) -> None:
    """Writes the tables below `root`, which is not there yet, and the version last: a folder without it is no manifest."""
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, generated_at, sorted(tables))], "version int, generated_at string, tables array<string>").coalesce(1).write.parquet(f"{root}/meta")


def read(spark: SparkSession, root: str) -> Tables:
    """The manifest's tables in the form of the newest version."""
    meta = spark.read.parquet(f"{root}/meta").first()
    return current({n: spark.read.parquet(f"{root}/{n}") for n in meta.tables}, meta.version)
