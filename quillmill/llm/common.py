"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The C library's way to give freed memory back, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, a folder of this application in it; only in local mode, where all tasks
    run on this machine, a folder is made if none is set."""
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillmill-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder, so that it is computed once and a lost executor does not bring its
    lineage back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut(), as a Parquet table: its size is known to the planner, while a checkpoint's estimate is that of the plan it
    came from, which multiplies in loops of joins."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As stored(), with the table's folder, for whoever drops it with discard()."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more from the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a table that broadcast_if_small() may broadcast; at 100 bytes a row this is 10 MB.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most `rows` rows (counted), else as it is, for
    Spark to join by shuffle with its skew handling. Give it a frame that is cut() already."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of text that are worked on at a time.
CHUNK = 4_000_000


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of text, a longer text by itself. What one slice took is given
    back before the next, as a worker's freed memory counts against its executor."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + size, "right")))
        yield batch.slice(at, end - at)
        at = end
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)
