"""Tables in a folder of Parquet versions: upserts write a new version and then move the pointer, so readers
never see half a write and a failed job leaves the old version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the current version: the newest pointer wins."""
    fs, p = _fs(spark, f"{root}/_current")
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return f"{root}/{names[-1].split('-', 1)[1]}" if names else None


def read(spark: SparkSession, root: str) -> DataFrame | None:
    at = current(spark, root)
    return spark.read.parquet(at) if at else None


def overwrite(df: DataFrame, root: str) -> None:
    """Writes a version, then its pointer under the next free number: two writers never share one, and the later pointer wins."""
    spark, name = df.sparkSession, f"v{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    fs, p = _fs(spark, f"{root}/_current")
    number = 1 + max((int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 1
    while True:
        _, claim = _fs(spark, f"{root}/_claims/{number:012d}")
        try:
            fs.create(claim, False).close()  # fails if another writer has the number
            break
        except Exception as e:
            if "already exists" not in str(e) and "FileAlreadyExists" not in str(e):
                raise
            number += 1
    _, pointer = _fs(spark, f"{root}/_current/{number:012d}-{name}")
    fs.create(pointer, False).close()


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Removes all versions but the newest `keep`; how many. Readers of an older one must have ended."""
    fs, p = _fs(spark, f"{root}/_current")
    old = sorted(s.getPath().getName() for s in fs.listStatus(p))[: -max(1, keep)] if fs.exists(p) else []
    for pointer in old:
        number, name = pointer.split("-", 1)
        for path, whole in ((f"_current/{pointer}", False), (name, True), (f"_claims/{number}", False)):
            fs.delete(_fs(spark, f"{root}/{path}")[1], whole)
    return len(old)


def upsert(rows: DataFrame, root: str, key: str) -> None:
    """Rows replace those of equal key; columns that one side lacks are null there."""
    old = read(rows.sparkSession, root)
    if old is not None:
        rows = old.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
    overwrite(rows, root)


def missing_columns(table: DataFrame, wanted: dict[str, str]) -> dict[str, str]:
    return {c: kind for c, kind in wanted.items() if c not in table.columns}


def add_columns(table: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only adds; nothing is retyped or dropped."""
    return table.withColumns({c: F.lit(None).cast(kind) for c, kind in missing_columns(table, wanted).items()}) if missing_columns(table, wanted) else table
