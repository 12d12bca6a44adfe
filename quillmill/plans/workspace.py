"""More of the catalogue: what is written to a workspace, the state of scans and jobs, and functions over URLs and dates. Each
query stands beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import dates, render, text, urls
from quillmill.operators import extraction, inventory, jobs, links, outputs, scan, sink, status

SQL: dict[str, str] = {}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(of: Column, *values: str | None) -> Column:
    """One of the values, in turn by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(of, F.lit(len(values))) + 1).cast("int"))


def _case(of: str, *values: str | None) -> str:
    return f"CASE {of} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


AT = "2024-02-01T00:00:00Z"


# ---- columns of a workspace


@query(f"""SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'Course ' || n_nationkey ELSE n_name END AS "Course Name", CAST(n_nationkey AS VARCHAR) AS "Canvas Course ID", CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE r_name END AS "Term",
  'https://school.example.com/courses/' || n_nationkey AS "Canvas URL", 'general' AS "Import Scope / Mode", {_case('n_nationkey', 'created', None)} AS "Sync Status", '{AT}' AS "Last Synced", '' AS "Course Hub Page ID" FROM nation JOIN region ON n_regionkey = r_regionkey""")
def sink_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("course_id"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("course_name"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(None)).otherwise(F.col("r_name")).alias("term"),
        F.concat(F.lit(" https://school.example.com/courses/"), "n_nationkey").alias("course_url"), F.col("n_nationkey").alias("k"),
    )
    return sink.courses(rows, F.lit("general"), _pick(F.col("k"), "created", ""), F.lit(AT), F.lit(None).cast("string"))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file rows, with the state of their labels."""
    d, s = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    files = d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("course_id"), F.col("source").alias("course_name"), F.lit("files").alias("source_section"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("Files").alias("source_page_title"), F.lit("").alias("source_page_url"),
        F.concat(F.lit("file"), "doc_id", F.lit("."), _pick(F.col("doc_id"), "pdf", "docx", "txt", "zip")).alias("file_name"), F.lit("").alias("link_text"), F.concat(F.lit("https://files.example.com/f/"), "doc_id").alias("url"), F.lit(True).alias("is_downloadable"), F.lit(False).alias("is_external"),
        (F.col("doc_id") % 2 == 0).alias("is_hosted"), F.col("doc_id").alias("seq"),
    )
    ok = F.col("quality") == 1
    state = s.select(
        F.concat(F.lit("file_artifact:"), "doc_id").alias("content_object_id"), F.when(ok, "extracted").otherwise("extraction_failed").alias("processing_state"), F.when(ok, "extracted").otherwise("failed").alias("extraction_status"), F.when(ok, "some text").otherwise(" ").alias("extracted_text"),
        F.col("toxic").alias("chunk_count"), F.lit(2).alias("word_count"), F.when(ok, "").otherwise("unreadable").alias("failure_reason"),
    )
    return extraction.merge_state(inventory.with_extraction_defaults(inventory.file_rows(files)), state)


_ARTIFACTS = """art AS (
  SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS known, l.quality = 1 AS ok, coalesce(l.toxic, 0) AS chunks, d.doc_id % 4 < 3 AS supported, CASE d.doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' ELSE 'zip' END AS ext,
    CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'Files' END AS page FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
named AS (SELECT *, CASE WHEN page = '' THEN 'file' || doc_id || '.' || ext ELSE page END AS title, 'https://files.example.com/f/' || doc_id AS url FROM art)"""


@query(f"""WITH {_ARTIFACTS} SELECT title AS "Title", 'file_artifact:' || doc_id AS "Content Object ID", source AS "Canvas Course ID", source AS "Course Name", 'file_artifact' AS "Content Type", 'files' AS "Source Section", title AS "Source Page Title", url AS "Source URL", url AS "Canvas URL",
  '' AS "Week/Module", NULL AS "Date Discovered", {_case('doc_id', 'notion_created', 'artifact_attached')} AS "Processing Status", CASE WHEN ok THEN 'extracted' WHEN known THEN 'failed' WHEN supported THEN 'not_started' ELSE 'unsupported' END AS "Extraction Status",
  CASE WHEN chunks > 0 THEN CASE WHEN ok THEN 'automation_ready' ELSE 'chunked' END WHEN ok THEN 'extracted' WHEN known THEN 'blocked' WHEN supported THEN 'discovered' ELSE 'unsupported_for_extraction' END AS "Readiness", CASE WHEN supported THEN ext ELSE 'unsupported' END AS "Source Category",
  '' AS "Extraction Method", coalesce(ok, FALSE) AS "Extracted Text Present", CASE WHEN known THEN 2 ELSE 0 END AS "Word Count", 0 AS "Char Count", CAST(chunks AS INTEGER) AS "Chunk Count",
  CASE WHEN NOT supported THEN 'Unsupported binary file type: .zip.' WHEN NOT ok THEN 'unreadable' ELSE '' END AS "Unsupported Reason", '{AT}' AS "Last Synced", coalesce(ok, FALSE) OR chunks > 0 OR doc_id % 2 = 1 AS "Automation Ready",
  '' AS "Local Download Path", 'file' || doc_id || '.' || ext AS "File Name", FALSE AS "Is Canvas Hosted", FALSE AS "Is Downloadable", FALSE AS "Is External" FROM named""")
def sink_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.content(_artifacts(spark, sf_dir), _pick(F.col("seq"), "notion_created", "artifact_attached"), F.lit(AT))


@query(f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Canvas deliverable' ELSE 'Order ' || o_orderkey END AS "Title", 'deliverable:' || o_orderkey AS "Content Object ID", CAST(o_custkey AS VARCHAR) AS "Canvas Course ID", o_orderpriority AS "Course Name", 'https://school.example.com/a/' || o_orderkey AS "Source URL",
  CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "Due Date", o_orderkey % 5 > 0 AS "Due Date Available", o_orderstatus AS "Processing Status", '{AT}' AS "Last Synced", o_orderkey % 5 > 0 AS "Automation Ready" FROM orders""")
def sink_deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Order "), k)).alias("source_page_title"), F.concat(F.lit("deliverable:"), k).alias("content_object_id"), F.col("o_custkey").cast("string").alias("course_id"), F.col("o_orderpriority").alias("course_name"), F.lit("").alias("source_url"),
        F.concat(F.lit("https://school.example.com/a/"), k).alias("source_page_url"), F.when(k % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("due_date"), "o_orderstatus",
    )
    return sink.deliverables(rows, F.col("o_orderstatus"), F.lit(AT))


def _output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as outputs of the runs of their sources."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    none = F.array().cast("array<string>")
    return d.select(
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit(" Digest "), i)).alias("title"), outputs.output_id(F.concat(F.lit(" run-"), "source"), F.when(i % 3 == 0, "").otherwise(i.cast("string"))).alias("output_id"), F.lit("weekly").alias("automation_id"),
        _pick(i, "recap", "digest", "no such type").alias("artifact_type"), F.lit(None).cast("string").alias("run_id"), F.concat(F.lit("run-"), "source").alias("run_run_id"), _pick(i, "course", None).alias("target_scope"), F.lit("workspace").alias("run_target_scope"),
        F.when(i % 2 == 0, F.array(F.lit("7"), F.lit(" 7 "), i.cast("string"), F.lit(""))).otherwise(none).alias("related_course_ids"), F.when(i % 5 > 0, F.col("source")).alias("course_id"), F.when(i % 7 > 0, F.array("source", "lang")).alias("course_names"), F.lit(None).cast("string").alias("window_start"),
        F.lit("2024-01-08").alias("run_window_start"), F.lit("2024-01-14").alias("window_end"), F.lit("2024-01-15").alias("run_window_end"), F.when(i % 2 == 0, F.col("n_chars").cast("int")).alias("source_count"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("created_at"), "doc_id",
    )


_OUT = f"""outs AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Digest ' || doc_id END AS own, 'run-' || source || ':' || CASE WHEN doc_id % 3 = 0 THEN 'output' ELSE CAST(doc_id AS VARCHAR) END AS output_id, {_case('doc_id', 'recap', 'digest', 'no such type')} AS kind FROM documents)"""


@query(f"""WITH {_OUT} SELECT CASE WHEN own = '' THEN output_id ELSE ' ' || own END AS "Title", output_id AS "Output ID", 'weekly' AS "Automation ID", kind AS "Artifact Type", 'run-' || source AS "Run ID", CASE WHEN doc_id % 2 = 0 THEN 'course' ELSE 'workspace' END AS "Target Scope",
  CASE WHEN doc_id % 2 = 0 THEN '7,  7 , ' || doc_id || ', ' WHEN doc_id % 5 > 0 THEN source ELSE '' END AS "Canvas Course IDs", CASE WHEN doc_id % 7 > 0 THEN source || ', ' || lang ELSE '' END AS "Course Names", '2024-01-08' AS "Window Start", '2024-01-14' AS "Window End",
  CAST(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS INTEGER) AS "Source Count", '' AS "Summary", '{AT}' AS "Created At", '{AT}' AS "Updated At" FROM outs""")
def sink_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.outputs(_output_rows(spark, sf_dir), F.lit(AT))


@query(f"""WITH {_OUT} SELECT doc_id, output_id, 'run-' || source AS run_id, 'weekly' AS automation_id, CASE WHEN doc_id % 5 > 0 THEN source END AS course_id, CASE WHEN doc_id % 2 <> 0 THEN '' WHEN doc_id = 7 THEN '7' ELSE '7|' || doc_id END AS related, CASE WHEN doc_id % 7 > 0 THEN source || '|' || lang ELSE '' END AS names,
  CASE WHEN own = '' THEN 'Automation Output' ELSE own END AS title, '' AS summary, CASE WHEN kind = 'no such type' THEN 'overview' ELSE kind END AS artifact_type, CASE WHEN doc_id % 2 = 0 THEN 'course' ELSE 'workspace' END AS target_scope, '2024-01-08' AS window_start, '2024-01-15' AS window_end,
  CAST(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS INTEGER) AS source_count, '{AT}' AS created_at, '{AT}' AS updated_at FROM outs""")
def output_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outputs.envelopes(_output_rows(spark, sf_dir), F.lit(AT), "doc_id")
    return out.withColumn("related", F.array_join("related_course_ids", "|")).withColumn("names", F.array_join("course_names", "|")).drop("related_course_ids", "course_names")


@query(f"""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'slug' || n_nationkey ELSE 'id' || n_nationkey END AS automation_id, CASE WHEN n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 THEN 'slug' || n_nationkey ELSE 'id' || n_nationkey END AS slug,
  CASE WHEN n_nationkey % 5 > 0 THEN n_name WHEN n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 THEN 'slug' || n_nationkey ELSE 'id' || n_nationkey END AS name, '' AS description, coalesce({_case('n_nationkey', None, 'false', 'true')}, 'true') = 'true' AS enabled,
  {_case('n_nationkey', 'study_seed', 'overview')} AS output_type, {_case('n_nationkey', 'course', 'workspace', 'workspace')} AS target_scope, {_case('n_nationkey', 'both', 'content')} AS input_sources, {_case('n_nationkey', 'custom', 'weekly')} AS window_type, {_case('n_nationkey', 'weekly', 'manual')} AS cadence FROM nation""")
def automation_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as definitions, some of them with unknown values."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    raw = n.select(
        k.alias("k"), F.when(k % 3 > 0, F.concat(F.lit(" id"), k)).alias("automation_id"), F.when((k % 2 == 0) | (k % 3 == 0), F.concat(F.lit("slug"), k)).alias("slug"), F.when(k % 5 > 0, F.col("n_name")).otherwise(" ").alias("name"), F.lit(None).cast("string").alias("description"),
        _pick(k, None, "false", "true").cast("boolean").alias("enabled"), _pick(k, "study_seed", "?").alias("output_type"), _pick(k, "course", "workspace", None).alias("target_scope"), _pick(k, "both", "").alias("input_sources"), _pick(k, "custom", "x").alias("window_type"), _pick(k, "weekly", "daily").alias("cadence"),
    )
    return raw.select("k", F.coalesce("automation_id", "slug").alias("id")).select("k", F.trim("id").alias("automation_id")).join(outputs.definitions(raw), "automation_id").select("k", *outputs.definitions(raw).columns)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS automation_id, n_name AS name, 'overview' AS output_type FROM nation WHERE n_nationkey = 7")
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("automation_id"), F.col("n_name").alias("name"), F.lit("overview").alias("output_type"))
    return outputs.find(n, "7")


def _run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as automations, the hours of their events as runs, events as outputs."""
    e = table(spark, sf_dir, "events").select("*", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMddHH")).alias("run_id"))
    run = e.groupBy("run_id", F.col("user_id").cast("string").alias("automation_id")).agg(
        F.max_by("event_type", "event_id").alias("kind"), F.max("event_id").alias("updated_at"), F.count_if(F.col("event_type") == "click").alias("tasks"), F.count_if(F.col("event_type") == "view").alias("content"),
    )
    runs = run.select(
        "*", F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "view", "completed").otherwise(F.col("kind")).alias("status"), F.concat(F.lit("Automation "), "automation_id").alias("name"), F.lit("Jan 1 - Jan 7").alias("window"), F.when(F.col("kind") == "error", "It broke.").otherwise("").alias("error"),
    )
    return outputs.summaries(runs, e.select("run_id", F.col("event_id").alias("output_id"), F.lit("t").alias("title"), (F.col("event_type") != "error").alias("written")))


_RUNS = """runs AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d%H') AS run_id, CAST(user_id AS VARCHAR) AS automation_id, arg_max(event_type, event_id) AS kind, max(event_id) AS updated_at, count(*) FILTER (WHERE event_type = 'click') AS tasks, count(*) FILTER (WHERE event_type = 'view') AS content,
    count(*) AS output_count, count(*) FILTER (WHERE event_type <> 'error') AS written_count FROM events GROUP BY 1, 2),
summaries AS (
  SELECT automation_id, run_id, CASE kind WHEN 'error' THEN 'failed' WHEN 'view' THEN 'completed' ELSE 'idle' END AS status, output_count, written_count, tasks, content, tasks + content AS total, updated_at,
    CASE WHEN kind = 'error' THEN 'It broke.' ELSE 'Automation ' || automation_id || ' wrote ' || written_count || CASE WHEN written_count = 1 THEN ' output for ' ELSE ' outputs for ' END || 'Jan 1 - Jan 7.' END AS headline FROM runs)"""


@query(f"WITH {_RUNS} SELECT * FROM summaries")
def result_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_summaries(spark, sf_dir)


@query(f"WITH {_RUNS} SELECT *, CAST(CASE automation_id WHEN '3' THEN 1 WHEN '1' THEN 2 ELSE 3 END AS INTEGER) AS place FROM summaries QUALIFY row_number() OVER (PARTITION BY automation_id ORDER BY updated_at DESC, run_id DESC) = 1")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.latest(_run_summaries(spark, sf_dir), ("3", "1"))


@query("""SELECT doc_id, '{"outputId":"o' || doc_id || '","runId":null,"warnings":["' || lang || '"],"sourceCount":' || n_chars || '}' AS metadata, CASE WHEN doc_id % 2 = 0 THEN 'overview' ELSE 'digest' END AS artifact_type, CASE WHEN doc_id % 3 = 0 THEN '{}' ELSE lang END AS content,
  'Digest · ' || CASE WHEN doc_id % 2 = 0 THEN 'Jan 8 - Jan 14' ELSE source END AS title, CASE WHEN doc_id % 2 = 0 THEN 'Unknown date' ELSE 'Jan 8' END AS day FROM documents""")
def output_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    body = outputs.metadata(outputId=F.concat(F.lit("o"), i), runId=F.lit(None).cast("string"), warnings=F.array("lang"), sourceCount=F.col("n_chars"))
    art = outputs.artifact(i.cast("string"), _pick(i, "?", "digest"), F.when(i % 3 > 0, F.col("lang")), F.lit(False))
    start, end = F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-14").cast("timestamp")
    return d.select("doc_id", body.alias("metadata"), art.alias("a"), outputs.title(F.lit("Digest"), start, end, F.when(i % 2 == 1, F.col("source"))).alias("title"), outputs.short_date(F.when(i % 2 == 1, start)).alias("day")).select("doc_id", "metadata", "a.artifact_type", "a.content", "title", "day")


@query("SELECT o_orderkey AS id, 'tasks' AS kind FROM orders UNION ALL SELECT doc_id, 'content' FROM documents")
def mixed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("tasks").alias("kind"))
    return tasks.unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("content").alias("kind")))


# ---- scans


@query("""WITH raw AS (SELECT p_partkey AS seq, substr(p_brand, 7) AS id, p_type AS t, p_size FROM part),
firsts AS (
  SELECT id, arg_min(name, struct_pack(l := -length(name), s := seq)) AS course_name, arg_min(t, seq) FILTER (WHERE seq % 2 = 0) AS term FROM (SELECT *, CASE WHEN seq % 4 = 0 THEN 'Course ' || id ELSE t END AS name FROM raw) GROUP BY id),
nav AS (SELECT id, section, arg_max(t, seq) AS url FROM (SELECT id, t, seq, CASE WHEN seq % 3 = 0 THEN 'files' ELSE 'pages' END AS section FROM raw) GROUP BY id, section)
SELECT f.id AS course_id, course_name, term, 'home' AS section, (SELECT url FROM nav n WHERE n.id = f.id AND n.section = 'files') AS files, (SELECT url FROM nav n WHERE n.id = f.id AND n.section = 'pages') AS pages FROM firsts f""")
def scan_courses_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as findings of courses (brands): ids told from URLs, names and links merged."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    brand = F.substring("p_brand", 7, 100)
    raw = p.select(
        k.alias("seq"), F.when(k % 2 == 0, brand).otherwise("").alias("course_id"), F.concat(F.lit("https://school.example.com/courses/"), brand).alias("course_url"), F.when(k % 4 == 0, "").otherwise(F.col("p_type")).alias("course_name"), F.when(k % 2 == 0, F.col("p_type")).otherwise("").alias("term"),
        F.lit(None).cast("string").alias("section"), F.create_map(F.when(k % 3 == 0, "files").otherwise("pages"), F.col("p_type")).alias("nav"),
    )
    return scan.merged(scan.prepared(raw)).select("course_id", "course_name", "term", "section", F.col("nav")["files"].alias("files"), F.col("nav")["pages"].alias("pages"))


@query("SELECT n_name AS course_name, CAST(row_number() OVER (ORDER BY n_name DESC) AS INTEGER) AS pos FROM nation WHERE n_regionkey > 0")
def ordered_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    names = n.where("n_regionkey > 0").agg(F.reverse(F.array_sort(F.collect_list("n_name"))).alias("names"))
    order = names.select(F.posexplode(F.concat("names", F.array(F.lit("no such course")))).alias("pos", "course_id"))
    return scan.in_order(n.select(F.col("n_name").alias("course_id")), order).select(F.col("course_id").alias("course_name"), (F.col("pos") + 1).alias("pos"))


def patches_of(events: DataFrame) -> DataFrame:
    """Events as patches to the progress of users."""
    t = F.col("event_type")
    return events.select(
        F.col("user_id").cast("string").alias("course_id"), F.col("event_id").alias("seq"), F.when(t == "error", "error").when(t == "purchase", "completed").when(t == "view", "scanning").alias("status"), F.when(t == "error", "failed to load").alias("message"), F.when(t == "view", F.col("event_id")).alias("pages_visited"),
        *[F.lit(None).cast("long").alias(c) for c in scan.COUNTS[1:-1]], F.when(t == "click", F.lit(1)).alias("ignored_count"),
    )


def users_of(events: DataFrame) -> DataFrame:
    """Users of even number, as courses that have a starting row."""
    return events.where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("course_id"), F.concat(F.lit("User "), "user_id").alias("course_name")).distinct()


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return scan.progress(users_of(e), patches_of(e.where(F.col("user_id") % 7 > 0)))


PROGRESS = """patches AS (SELECT CAST(user_id AS VARCHAR) AS course_id, event_id, event_type AS t FROM events WHERE user_id % 7 > 0),
last AS (SELECT course_id, arg_max(CASE t WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' ELSE 'scanning' END, event_id) FILTER (WHERE t IN ('error', 'purchase', 'view')) AS status, bool_or(t = 'error') AS bad, max(event_id) FILTER (WHERE t = 'view') AS pages, bool_or(t = 'click') AS clicked FROM patches GROUP BY course_id),
progress AS (
  SELECT coalesce(c.course_id, l.course_id) AS course_id, CASE WHEN c.course_id IS NULL THEN l.course_id ELSE 'User ' || c.course_id END AS course_name, coalesce(l.status, 'queued') AS status, CASE WHEN l.bad THEN 'failed to load' ELSE 'Queued' END AS message, CAST(coalesce(l.pages, 0) AS BIGINT) AS pages_visited,
    CAST(0 AS BIGINT) AS document_count, CAST(0 AS BIGINT) AS duplicate_count, CAST(0 AS BIGINT) AS downloadable_count, CAST(0 AS BIGINT) AS external_count, CAST(CASE WHEN l.clicked THEN 1 ELSE 0 END AS BIGINT) AS ignored_count
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS course_id FROM events WHERE user_id % 2 = 0) c FULL JOIN last l ON c.course_id = l.course_id)"""


@query(f"WITH {PROGRESS} SELECT * FROM progress")
def scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir)


@query(f"""WITH {PROGRESS}, sums AS (SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'error') AS failed, count(*) FILTER (WHERE status IN ('queued', 'scanning')) AS waiting, CAST(sum(pages_visited) AS BIGINT) AS pages_visited, CAST(0 AS BIGINT) AS document_count,
  CAST(0 AS BIGINT) AS duplicate_count, CAST(0 AS BIGINT) AS downloadable_count, CAST(0 AS BIGINT) AS external_count, CAST(sum(ignored_count) AS BIGINT) AS ignored_count FROM progress)
SELECT *, completed + failed AS courses_scanned, CASE WHEN completed = 0 AND failed > 0 THEN 'error' WHEN waiting > 0 THEN 'scanning' ELSE 'completed' END AS status FROM sums""")
def scan_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.outcome(_progress(spark, sf_dir))


@query("""SELECT url AS page_url, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'c' || page_id % 5 END AS course_id, NULL AS error FROM pages WHERE page_id % 4 > 0
UNION ALL SELECT url, NULL, CASE WHEN page_id % 8 = 0 THEN 'timeout' ELSE 'Unknown page scan failure.' END FROM pages WHERE page_id % 4 = 0""")
def page_scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    rows = p.select("page_id", F.col("url").alias("page_url"), (k % 4 > 0).alias("ok"), F.when(k % 8 == 0, "timeout").otherwise("").alias("error"), F.lit("").alias("course_id"), F.lit("").alias("course_name"), F.lit("t").alias("title"))
    context = p.where("page_id % 3 > 0").select("page_id", F.col("url").alias("page_url"), F.concat(F.lit("c"), k % 5).alias("course_id"), F.lit("Course").alias("course_name"))
    good, bad = scan.page_results(rows, context, ("page_id", "page_url"))  # URLs come again
    return good.select("page_url", "course_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("page_url", F.lit(None).cast("string").alias("course_id"), "error"))


# ---- jobs, manifests, statuses


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has a job; a fifth of these are being processed already."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.where("doc_id % 3 = 0").select(F.concat(F.lit("job-"), i).alias("job_id"), F.concat(F.lit("file_artifact:"), i).alias("content_object_id"), F.when(i % 5 == 0, "processing").otherwise("queued").alias("status"), (i % 2).cast("int").alias("attempts"), i.alias("seq"))


@query("""SELECT 'job-' || doc_id AS job_id, CAST(doc_id % 2 + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS attempts,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 4 = 3 THEN 'unsupported' WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'queued' ELSE 'completed' END AS status,
  CASE WHEN doc_id % 7 = 0 THEN 'Source record no longer participates in extraction.' WHEN doc_id % 4 = 3 THEN 'Unsupported binary file type: .zip.' WHEN doc_id % 11 = 0 THEN 'cannot read' ELSE '' END AS reason FROM documents WHERE doc_id % 3 = 0""")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    art = _artifacts(spark, sf_dir).where("seq % 7 > 0")
    records = art.select("content_object_id", F.col("supported_extraction").alias("supported"), "unsupported_reason")
    i = F.col("doc_id")
    results = table(spark, sf_dir, "documents").where("doc_id % 13 > 0 or doc_id % 11 = 0").select(F.concat(F.lit("file_artifact:"), i).alias("content_object_id"), F.when(i % 11 > 0, F.col("text")).alias("extracted_text"), F.when(i % 11 == 0, "cannot read").alias("error"))
    return jobs.finished(jobs.started(_jobs(spark, sf_dir)), records, results).select("job_id", "attempts", "status", "reason")


@query("SELECT 'job-' || doc_id AS job_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 > 0 ORDER BY doc_id LIMIT 1")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.waiting(_jobs(spark, sf_dir), 1).select("job_id")


@query("SELECT 'job-' || doc_id AS job_id FROM documents WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM labels)")
def jobs_of_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.of_object(_jobs(spark, sf_dir), table(spark, sf_dir, "labels").select(F.concat(F.lit("file_artifact:"), "doc_id").alias("content_object_id"))).select("job_id")


@query("SELECT 'file_artifact:' || doc_id AS content_object_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def artifacts_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return jobs.artifacts_of(got, _artifacts(spark, sf_dir)).select("content_object_id")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS document_id, coalesce(l.quality = 1, FALSE) AS exported, coalesce(l.toxic = 0, TRUE) AS ready, CASE WHEN l.quality = 1 THEN 'page' END AS page_id, CASE WHEN l.quality = 1 THEN 'notion_created' ELSE 'not_started' END AS last_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def sync_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("quality") == 1
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"), ok.alias("exported"), (F.col("toxic") == 0).alias("ready"), F.when(ok, "page").otherwise("").alias("page_id"), F.when(ok, "notion_created").otherwise("").alias("last_status"))
    return jobs.sync_records(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")), known)


@query("""SELECT 'c' || conv_id || ':' || turn AS chunk_id, CAST(turn AS INTEGER) AS chunk_index, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS chunk_text, CAST(length(text) AS INTEGER) AS token_estimate, role AS heading_context, CAST(conv_id AS VARCHAR) AS content_object_id, NULL AS source_document_id, '' AS course_id,
  '' AS course_name, '' AS content_type, '' AS source_page_title, 'phase4-v1' AS extraction_version FROM conversations""")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    raw = c.select(F.concat(F.lit(" c"), "conv_id", F.lit(":"), "turn").alias("chunk_id"), F.col("turn").cast("string").alias("chunk_index"), F.concat(F.lit("  "), "text", F.lit("\n")).alias("chunk_text"), F.length("text").alias("token_estimate"), F.col("role").alias("heading_context"), F.col("conv_id").cast("string").alias("content_object_id"), F.lit(" ").alias("source_document_id"))
    return jobs.chunk_records(raw)


@query("""SELECT (SELECT count(*) FROM nation) AS courses, count(*) AS documents, count(*) AS content_records, CAST(0 AS BIGINT) AS direct_ingest_candidates, count(*) AS file_artifact_candidates, count(*) FILTER (WHERE doc_id % 4 < 3 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS extraction_pending_items FROM documents""")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.manifest_counts(table(spark, sf_dir, "nation"), table(spark, sf_dir, "documents"), _artifacts(spark, sf_dir))


@query("SELECT source AS course_id, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS ids FROM documents GROUP BY source")
def documents_of_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"))
    return status.documents_of_courses(d).withColumn("ids", F.md5(F.array_join("ids", ",")))


@query("""SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 7 END AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY source, doc_id % 4 ORDER BY lang, doc_id) AS INTEGER) AS nth FROM documents""")
def documents_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("course_id"), _pick(i, "files", "modules", "home", "elsewhere").alias("source_section"), F.col("lang").alias("title"), i.alias("seq"))
    return status.by_section(d, urls.section_priority(F.col("source_section"))).select("doc_id", "place", F.col("nth").cast("int").alias("nth"))


_STATES = [("blocked", "", "https://www.notion.so/Team-0123456789abcdef0123456789ABCDEF?v=1"), ("done", "", ""), ("done", "x", "https://elsewhere.example.com/0123456789abcdef0123456789abcdef"), ("syncing", "half done", "01234567-89ab-cdef-0123-456789abcdef"), ("done", "", "https://a.notion.site/page?p=fedcba9876543210fedcba9876543210#x"), ("done", "", "no id at all"), ("blocked", "stuck", " 0123456789abcdef0123456789abcdef ")]


@query("""WITH s AS (SELECT n_nationkey AS k, n_nationkey % 7 AS m FROM nation),
t AS (SELECT *, m NOT IN (1, 2, 5) AS valid, CASE WHEN m IN (1, 2, 5) THEN NULL WHEN m = 4 THEN 'fedcba98-7654-3210-fedc-ba9876543210' ELSE '01234567-89ab-cdef-0123-456789abcdef' END AS page_id, m IN (0, 6) AS blocked, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'content_ready' ELSE 'automation_ready_partial' END AS level FROM s)
SELECT k, page_id, valid AS is_valid, CASE WHEN blocked THEN 'blocked' WHEN m = 1 THEN 'destination_missing' WHEN NOT valid THEN 'blocked' ELSE coalesce(level, 'ready_for_planning') END AS state,
  CASE WHEN blocked THEN 'Blocked' WHEN m = 1 THEN 'Destination needed' WHEN NOT valid THEN 'Destination invalid' WHEN level IS NULL THEN 'Ready to plan' WHEN level = 'content_ready' THEN 'Content ready' ELSE 'Automation-ready partial' END AS label,
  CASE WHEN m = 1 THEN 'Paste destination Notion page URL or page ID, choose workspace mode, then plan academic workspace.' WHEN NOT valid THEN 'Destination must be a valid Notion page URL or raw page ID.' WHEN k % 4 = 0 THEN 'Run a Canvas scan first so planner has course and content data.'
    WHEN k % 5 = 0 AND level IS NOT NULL THEN 'Plan ready. Add Notion integration token, then validate and run live sync.' WHEN k % 5 = 0 THEN 'Add Notion integration token to validate destination and run live sync.' WHEN m = 3 THEN 'half done' WHEN m = 6 THEN 'stuck' WHEN k % 2 = 0 THEN 'Latest live Notion sync completed.'
    WHEN level IS NOT NULL THEN 'Academic workspace plan saved. Validate destination, then run live sync.' ELSE 'Validate destination and workspace assumptions, then plan academic workspace.' END AS message,
  NOT blocked AS success, CAST(k AS INTEGER) AS created_count, CAST(0 AS INTEGER) AS failed_count FROM t""")
def workspace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stored states, in turn with the entries above."""
    n, k = table(spark, sf_dir, "nation"), F.col("k")
    rows = n.select(F.col("n_nationkey").alias("k")).select("k", *[_pick(k, *[s[i] for s in _STATES]).alias(c) for i, c in enumerate(("job", "summary", "given"))], _pick(k, None, "content_ready", "automation_ready_partial").alias("level"))
    rows = rows.withColumn("to", status.destination(F.col("given")))
    none = F.lit(None).cast("string")
    at = status.overview(F.col("job"), none, F.col("given"), F.col("to.page_id"), F.col("to.is_valid"), F.col("level"))
    said = status.message(F.col("given"), F.col("to.is_valid"), F.col("to.page_id"), k % 4, F.lit(0), k % 5 > 0, F.col("level").isNotNull(), F.col("job"), F.col("summary"), none, k % 2 == 0)
    blocked = F.when(F.col("job") == "blocked", "blocked")
    result = status.result(k.cast("string"), {}, k.cast("int"), F.lit(0), F.lit(0), F.lit(None).cast("int"), F.lit(0), F.array(F.lit("w"), F.lit("w")), blocked)
    return rows.select("k", "to.page_id", "to.is_valid", at.alias("at"), F.coalesce(said, F.lit("")).alias("message"), result.alias("r")).select("k", "page_id", "is_valid", "at.state", "at.label", "message", "r.success", "r.created_count", "r.failed_count")


# ---- functions over URLs, dates and texts


def _lms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as pages of a learning platform, by turns of their number: a struct p of URL parts."""
    k = F.col("page_id")
    path = _pick(k, "", "/modules", "/pages/intro", "/assignments/7", "/assignments/syllabus", "/files/42", "/files?preview=43", "/users/1", "/modulesx", "/files/44/download?download_frd=1&wrap=1")
    url = F.concat(F.lit("https://School.instructure.com/courses/"), k % 25, path)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), (k % 25).cast("string").alias("course_id"), urls.parts(url).alias("p"))


_LMS = f"""lms AS (SELECT page_id, page_id % 25 AS c, page_id % 10 AS m, 'https://school.instructure.com' AS origin, {_case('page_id', '', '/modules', '/pages/intro', '/assignments/7', '/assignments/syllabus', '/files/42', '/files', '/users/1', '/modulesx', '/files/44/download')} AS rest FROM pages)"""


@query(f"""WITH {_LMS} SELECT page_id, CAST(c AS VARCHAR) AS course_id, {_case('m', 'home', 'modules', 'pages', 'assignments', 'assignments', 'files', 'files', None, None, 'files')} AS section, CASE m WHEN 5 THEN '42' WHEN 6 THEN '43' WHEN 9 THEN '44' END AS file_id,
  CASE WHEN m IN (5, 9) THEN origin || '/courses/' || c || '/files/' || CASE m WHEN 5 THEN '42' ELSE '44' END || '/download?download_frd=1' WHEN m = 6 THEN origin || '/files/43/download?download_frd=1' ELSE 'https://School.instructure.com/courses/' || c || rest END AS download_url,
  m = 7 AS ignored, origin || '/courses/' || c AS home, TRUE AS likely_host, TRUE AS in_course, m IN (5, 6, 9) AS preview, FALSE AS dashboard FROM lms""")
def lms_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, origin = F.col("p"), F.col("course_id"), F.lit("https://school.instructure.com")
    return _lms(spark, sf_dir).select(
        "page_id", urls.course_id(p).alias("course_id"), urls.section(p, c).alias("section"), urls.file_id(p).alias("file_id"), urls.download_url(p, F.col("url"), c, origin).alias("download_url"), urls.is_ignored_route(p, origin, c).alias("ignored"), urls.course_home(p, c).alias("home"),
        urls.is_likely_host(p["host"]).alias("likely_host"), urls.in_course(p, origin, c).alias("in_course"), urls.is_file_preview(p).alias("preview"), urls.is_dashboard(p).alias("dashboard"),
    )


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(substr(text, 1, 40), '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g'), ' .') AS name, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' ELSE '' END AS ext FROM documents)
SELECT doc_id, CASE WHEN name = '' THEN 'untitled' ELSE name END AS segment, CASE WHEN ext = '' THEN 'Report.PDF' WHEN ext = 'pdf' THEN 'Report.PDF' ELSE 'Report.PDF.' || ext END AS with_extension,
  CASE ext WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'txt' THEN 'text/plain' ELSE '' END AS mime,
  'Downloads/Course 7/Files/' || CASE WHEN ext = '' THEN 'notes' ELSE 'notes.' || ext END AS path, CASE WHEN ext = '' THEN 'txt' ELSE ext END AS artifact_extension, doc_id % 3 = 0 AS is_html FROM n""")
def file_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    ext, none = _pick(i, "pdf", "docx", "txt", ""), F.lit("")
    path = urls.download_path(none, F.lit("7"), F.lit("files"), none, F.lit("notes"), none, urls.parts(F.lit("https://x.example.com/")), ext)
    return d.select(
        "doc_id", urls.safe_segment(F.substring("text", 1, 40), "").alias("segment"), urls.with_extension(F.lit("Report.PDF"), ext).alias("with_extension"), urls.mime_of(ext).alias("mime"), path.alias("path"), jobs.extension_of(ext, F.lit("a.txt"), none, none).alias("artifact_extension"),
        scan.is_html(_pick(i, "Text/HTML; charset=utf-8", "application/pdf", "text/plain")).alias("is_html"),
    )


@query("""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'Unknown window' WHEN n_nationkey % 3 = 1 OR n_nationkey % 20 = 0 THEN 'Jan 8' ELSE 'Jan 8 - Jan ' || (8 + n_nationkey % 20) END AS range, 'Current Week · Jul 10 - Jul 16' AS week, 'secret…0' || CASE WHEN n_nationkey < 10 THEN '0' ELSE '' END || n_nationkey || CASE WHEN n_nationkey < 10 THEN 'z' ELSE 'z' END AS masked,
  '01234567-89ab-cdef-0123-4567890000' || CASE WHEN n_nationkey < 10 THEN '0' ELSE '' END || n_nationkey AS uuid, CASE WHEN n_nationkey % 2 = 0 THEN 'run:' || n_name ELSE 'run:output' END AS output_id, 'nation &lt;' || n_nationkey || '&gt; &amp; &quot;co&quot;' AS escaped FROM nation""")
def labels_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    two = F.lpad(k.cast("string"), 2, "0")
    day = F.lit("2024-01-08").cast("timestamp")
    end = F.when(k % 3 == 1, day + F.expr("INTERVAL 5 HOURS")).when(k % 3 == 2, F.date_add(day.cast("date"), (k % 20).cast("int")).cast("timestamp"))
    return n.select(
        k.alias("k"), dates.range_label(day, end).alias("range"), dates.window_label(F.lit("1995-07-12 00:00:00").cast("timestamp")).alias("week"), text.mask(F.concat(F.lit("secretkey-0"), two, F.lit("z"))).alias("masked"), text.uuid(F.concat(F.lit("https://n.example.com/Page-0123456789abcdef01234567890000"), two, F.lit("?v=1"))).alias("uuid"),
        outputs.output_id(F.lit(" run "), F.when(k % 2 == 0, F.col("n_name")).otherwise(" ")).alias("output_id"), text.escape_html(F.concat(F.lit("nation <"), k, F.lit('> & "co"'))).alias("escaped"),
    )


@query("""SELECT n_nationkey AS k, '<p>Week &lt;' || n_nationkey || '&gt;</p><h2>Course Recap</h2>' || CASE WHEN n_nationkey % 2 = 0 THEN '<ul><li>' || n_name || '</li><li>a &amp; b</li></ul>' ELSE '<p>No recap bullets.</p>' END || '<h2>Candidate Topics</h2><p>No candidate topics.</p><h2>Source References</h2>'
  || CASE WHEN n_nationkey % 3 = 0 THEN '<p>No source references for this output.</p>' ELSE '<ul><li><strong>' || n_name || '</strong> — course (<a href="https://x.example.com/' || n_nationkey || '">Source</a>)</li></ul>' END AS html,
  'Canvas URL: u' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '|Term: ' || n_name ELSE '' END || '|Workspace mode: general|Last synced: now' AS hub,
  CASE n_nationkey % 4 WHEN 0 THEN 'pdf: F.pdf|paragraph: Artifact attached from src.|heading: Extracted Content|paragraph: Extraction: extracted · 3 words · 2 chunks|extracted: ' WHEN 1 THEN 'paragraph: External resource: src' WHEN 2 THEN 'heading: Extracted Content|paragraph: Extraction: done · 3 words · 2 chunks|extracted: ' ELSE 'body: ' END AS parts FROM nation""")
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    none, name = F.array().cast("array<string>"), F.col("n_name")
    ref = F.struct(name.alias("title"), F.lit("course").alias("course_name"), F.lit("").alias("content_type"), F.lit("").alias("date"), F.concat(F.lit("https://x.example.com/"), k).alias("url"))
    refs = F.when(k % 3 > 0, F.array(ref)).otherwise(F.slice(F.array(ref), 2, 1))
    html = render.recap_html(F.concat(F.lit("Week <"), k, F.lit(">")), F.when(k % 2 == 0, F.array(name, F.lit("a & b"))).otherwise(none), none, refs)
    parts = sink.body_parts(_pick(k, "file_artifact", "external_resource", "canvas_page", "canvas_page"), F.when(k % 4 == 0, "up"), F.lit("F.pdf"), F.lit("src"), F.lit("page"), F.lit(""), _pick(k, None, None, "done", ""), F.when(k % 2 == 0, "some text"), F.lit(3), F.lit(2))
    hub = sink.hub_lines(F.concat(F.lit("u"), k), F.when(k % 2 == 0, name), F.lit("?"), F.lit("now"), F.lit(""))
    return n.select(k.alias("k"), html.alias("html"), F.array_join(hub, "|").alias("hub"), F.array_join(F.transform(parts, lambda p: F.concat_ws(": ", p["kind"], p["text"])), "|").alias("parts"))


@query(r"""WITH runs AS (SELECT page_id, html FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(regexp_extract(html, '<nav>.*</nav>'), '<li>')) AS BIGINT) AS nav_items FROM runs""")
def page_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many headings and list items of the navigation the rich blocks of each whole page hold."""
    from quillmill.sources import rich_blocks

    b = table(spark, sf_dir, "pages").select("page_id", rich_blocks.rich_blocks(F.col("html"), F.lit("")).alias("b"))
    of = lambda kind: F.size(F.filter("b", lambda x: x["type"] == kind)).cast("long")
    return b.select("page_id", of("heading_1").alias("headings"), of("bulleted_list_item").alias("nav_items"))
