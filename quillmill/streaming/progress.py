"""The progress of a scan as a stream: patches come in any order, each course's state is kept, and a table can be read at any time.

A course's state is, column by column, the last value that was not null and its number, so a patch that comes late changes nothing that a
later one has set. Each micro-batch appends the rows of the courses it has touched, in a folder of its own number: a batch that runs
again after a failure writes the same folder. Nothing else is rewritten. A course with most of the patches is one group, whose rows pass
through in slices; its state is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmill.operators import scan

_KINDS = {"status": "string", "message": "string", **dict.fromkeys(scan.COUNTS, "long")}
_STATE = ", ".join(f"{c} {t}, {c}_seq long" for c, t in _KINDS.items())
_ROW = "course_id string, " + ", ".join(f"{c} {t}" for c, t in _KINDS.items())


def _step(key: tuple, slices: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = list(state.get) if state.exists else [None] * (2 * len(_KINDS))
    for rows in slices:
        for k, c in enumerate(_KINDS):
            own = rows[rows[c].notna()]
            if len(own):
                last = own.loc[own["seq"].idxmax()]
                if held[2 * k + 1] is None or last["seq"] >= held[2 * k + 1]:
                    held[2 * k : 2 * k + 2] = [last[c] if _KINDS[c] == "string" else int(last[c]), int(last["seq"])]
    state.update(tuple(held))
    out = pd.DataFrame({"course_id": [key[0]], **{c: pd.Series([held[2 * k]], dtype="object" if t == "string" else "Int64") for k, (c, t) in enumerate(_KINDS.items())}})
    yield out


def keep(patches: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the progress of `patches`, a stream (course_id, seq, status, message, counts; null: leave as is), in tables below `root`. With `once`
    the query ends when all there is has been read, and goes on from there when it is started again with the same checkpoint.
    Patches without a course are left out."""
    rows = patches.where("course_id is not null and seq is not null").select("course_id", "seq", *[F.col(c).cast(t).alias(c) for c, t in _KINDS.items()])
    states = rows.groupBy("course_id").applyInPandasWithState(_step, _ROW, _STATE, "update", GroupStateTimeout.NoTimeout)
    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/batch={number}"))
    return (writer.trigger(availableNow=True) if once else writer).start()


def snapshot(spark: SparkSession, root: str, courses: DataFrame) -> DataFrame:
    """What scan.progress() gives for `courses` and all patches read so far: of each course the row of the last batch that touched it."""
    return scan.progress(courses, spark.read.schema(f"{_ROW}, batch long").parquet(root).withColumnRenamed("batch", "seq"))
