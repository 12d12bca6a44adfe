"""Streaming forms of what the batch operators do over whole tables: the newest record per key is kept in a
versioned table, and counts per window are closed by a watermark (the latter an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators.runs import newest
from quillmill.sources import tables


def keep_newest(stream: DataFrame, root: str, key: str, order: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch's newest record per key replaces an older one in the table at `root`. A batch that is run again after a
    failure leaves the same table. With `once` the query ends when all there is has been read."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = newest(batch, key, order)
        old = tables.read(batch.sparkSession, root)
        if old is not None:
            fresh = newest(old.unionByName(fresh, allowMissingColumns=True), key, order)
        tables.overwrite(fresh, root)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def window_counts(stream: DataFrame, time: str, by: str, length: str = "7 days", late: str = "1 day") -> DataFrame:
    """Counts per window and key; what comes later than `late` is left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("window"), by).agg(F.count("*").alias("n"))
