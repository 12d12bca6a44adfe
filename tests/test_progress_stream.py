"""The progress stream against the batch form, with late patches and after a restart."""

import random

from quillmill.operators import scan
from quillmill.streaming import progress

SCHEMA = "course_id string, seq long, status string, message string, pages_visited long, document_count long, duplicate_count long, downloadable_count long, external_count long, ignored_count long"


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(9)
    maybe = lambda v: v if rnd.random() < 0.4 else None
    rows = [(rnd.choice(["a", "a", "a", "b", "c", f"n{i % 9}", None]), i, maybe(rnd.choice(["scanning", "error", "completed"])), maybe(f"m{i}"), *[maybe(rnd.randrange(99)) for _ in range(6)]) for i in range(300)]
    rnd.shuffle(rows)  # patches come late
    courses = spark.createDataFrame([("a", "Course A"), ("never", "Course N")], "course_id string, course_name string")
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "rows", "checkpoint"))
    for k in range(3):
        spark.createDataFrame(rows[: 100 * (k + 1)][100 * k :], SCHEMA).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        progress.keep(stream, root, checkpoint).awaitTermination()  # a new query each time, from the same checkpoint
        want = scan.progress(courses, spark.createDataFrame([r for r in rows[: 100 * (k + 1)] if r[0]], SCHEMA))
        got = progress.snapshot(spark, root, courses)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
