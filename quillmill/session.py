"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the session's Python workers, wherever they run: once per
    application, a zip of the package is handed to Spark."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="quillmill-")) / "quillmill.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir for tables between steps. Only in local mode, where all tasks run on this
    machine, one is made if none is set."""
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillmill-"))
    return f"{context.getCheckpointDir()}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in a work folder: computed once, and not again when an executor is lost."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
