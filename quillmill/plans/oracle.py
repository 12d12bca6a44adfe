"""The catalogue's queries as SQL."""

_TASKS = """tasks AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS content_object_id, o_orderkey AS seq, CAST(n_nationkey AS VARCHAR) AS course_id, n_name AS course_name, o_orderdate AS due
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
due AS (SELECT * FROM tasks WHERE due BETWEEN TIMESTAMP '1995-07-10 00:00:00' AND TIMESTAMP '1995-07-16 23:59:59.999')"""
_URGENT = "due <= TIMESTAMP '1995-07-14 00:00:00'"
_TITLE = r"substr(string_split(text, chr(10))[1], 1, 60)"
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _events(start: str, end: str) -> str:
    return f"SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end} 23:59:59.999' GROUP BY event_type"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' ')"


_FILES = """files AS (
  SELECT doc_id, 'file_artifact:' || doc_id AS content_object_id, source AS course_id, doc_id % 2 = 0 AS is_downloadable,
    CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' WHEN 3 THEN 'pptx' WHEN 4 THEN 'doc' ELSE 'zip' END AS ext, doc_id % 6 < 3 AS supported FROM documents)"""
_MERGED = f"""{_FILES},
states AS (
  SELECT 'file_artifact:' || doc_id AS content_object_id, quality = 1 AS ok, toxic FROM labels),
merged AS (
  SELECT f.content_object_id, f.supported,
    CASE WHEN s.ok THEN 'extracted' WHEN NOT s.ok THEN 'extraction_failed' WHEN f.supported THEN 'discovered' ELSE 'unsupported_for_extraction' END AS processing_state,
    CASE WHEN s.ok THEN 'extracted' WHEN NOT s.ok THEN 'failed' WHEN f.supported THEN 'not_started' ELSE 'unsupported' END AS extraction_status,
    CASE WHEN s.ok THEN 'normalized' ELSE 'not_started' END AS normalization_status, 'not_started' AS enrichment_status,
    CAST(coalesce(s.toxic, 0) AS INTEGER) AS chunk_count, coalesce(s.ok AND s.toxic > 0, FALSE) AS automation_ready,
    CASE WHEN NOT s.ok THEN 'unreadable' ELSE '' END AS failure_reason,
    CASE WHEN coalesce(s.toxic, 0) > 0 THEN CASE WHEN s.ok THEN 'automation_ready' ELSE 'chunked' END
      WHEN s.ok THEN 'extracted' WHEN NOT s.ok THEN 'blocked' WHEN f.supported THEN 'discovered' ELSE 'unsupported_for_extraction' END AS content_readiness_state
  FROM files f LEFT JOIN states s ON f.content_object_id = s.content_object_id)"""
_INVENTORY = f"""{_FILES},
items AS (
  SELECT *, row_number() OVER (PARTITION BY content_type, course_id, url ORDER BY page_id) AS nth FROM (
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'assignment' ELSE 'canvas_page' END AS content_type, CAST(page_id % 25 AS VARCHAR) AS course_id, url, page_id % 3 > 0 AND length(html) > 0 AS body FROM pages)),
inventory AS (
  SELECT 'course' AS content_type, 'unknown' AS content_path_type, 'not_applicable' AS extraction_status, FALSE AS supported_extraction FROM nation
  UNION ALL SELECT 'file_artifact', CASE WHEN is_downloadable THEN 'file_artifact' ELSE 'unknown' END, CASE WHEN supported THEN 'not_started' ELSE 'unsupported' END, supported FROM files
  UNION ALL SELECT content_type, CASE WHEN body THEN 'direct_ingest' ELSE 'unknown' END, 'not_started', TRUE FROM items WHERE nth = 1
  UNION ALL SELECT 'deliverable', CASE WHEN body THEN 'direct_ingest' ELSE 'unknown' END, 'not_applicable', FALSE FROM items WHERE nth = 1 AND content_type = 'assignment')"""
_QUEUE = """jobs AS (
  SELECT CAST(event_id AS VARCHAR) AS job_id, event_id, 'file_artifact:' || user_id AS content_object_id,
    CASE event_type WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued' ELSE 'other' END AS status FROM events),
queue AS (
  SELECT job_id, content_object_id, CASE WHEN status IN ('processing', 'other') THEN 'queued' ELSE status END AS status
  FROM jobs QUALIFY row_number() OVER (PARTITION BY content_object_id ORDER BY event_id) = 1)"""
_CANONICAL = r"""canon AS (
  SELECT page_id, url, regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '(?<!:)/{2,}', '/', 'g'), '(.)/$', '\1') AS base,
    split_part(split_part(url, '#', 1), '?', 2) AS query FROM pages),
kept AS (
  SELECT page_id, base, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content)='))) AS params FROM canon),
urls AS (
  SELECT page_id, base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM kept)""".replace("(?<!:)/{2,}", "([^:])/{2,}").replace("'/', 'g'), '(.)/$'", r"'\1/', 'g'), '(.)/$'")
_PLAN = f"""{_INVENTORY.replace('inventory AS (', 'inventory0 AS (')},
states AS (SELECT 'file_artifact:' || doc_id AS content_object_id, quality = 1 AS ok, toxic FROM labels),
base AS (
  SELECT 'file_artifact' AS content_type, CASE WHEN is_downloadable THEN 'file_artifact' ELSE 'unknown' END AS path, supported,
    CASE WHEN s.ok THEN 'extracted' WHEN NOT s.ok THEN 'failed' WHEN f.supported THEN 'not_started' ELSE 'unsupported' END AS status,
    coalesce(s.toxic, 0) AS chunks, coalesce(s.ok AND s.toxic > 0, FALSE) AS ready, s.ok AS ok, 'https://files.example.com/f/' || doc_id AS source_url
  FROM files f LEFT JOIN states s ON f.content_object_id = s.content_object_id
  UNION ALL SELECT content_type, CASE WHEN body THEN 'direct_ingest' ELSE 'unknown' END, TRUE, 'not_started', 0, FALSE, NULL, url FROM items WHERE nth = 1
  UNION ALL SELECT 'deliverable', CASE WHEN body THEN 'direct_ingest' ELSE 'unknown' END, FALSE, 'not_applicable', 0, FALSE, NULL, url FROM items WHERE nth = 1 AND content_type = 'assignment'),
plans AS (
  SELECT CASE WHEN content_type = 'deliverable' THEN 'deliverable' ELSE 'content' END AS plan_type, content_type, path, supported, status, chunks, ready, source_url, FALSE AS future,
    CASE WHEN ready THEN 'automation_ready' WHEN chunks > 0 THEN 'chunked' WHEN ok THEN 'extracted' WHEN status = 'unsupported' THEN 'unsupported_for_extraction'
      WHEN supported AND status = 'not_started' THEN 'extraction_pending' WHEN NOT ok THEN 'blocked' ELSE 'discovered' END AS readiness,
    CASE path WHEN 'direct_ingest' THEN 'page_body_blocks' WHEN 'file_artifact' THEN 'page_attachment_and_artifact_metadata' ELSE 'database_properties_only' END AS location,
    content_type IN ('deliverable', 'file_artifact') OR path = 'direct_ingest' AS eligible
  FROM base
  UNION ALL SELECT 'study_asset', 'study_asset_container', 'unknown', FALSE, 'not_applicable', 0, FALSE, 'u', TRUE, 'discovered', 'database_properties_only', TRUE FROM nation
  UNION ALL SELECT 'course_hub', 'course', 'unknown', FALSE, 'not_applicable', 0, FALSE, 'u', FALSE, 'discovered', 'database_properties_only', FALSE FROM nation)"""
_SYNC = """sent AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'file_artifact' ELSE 'canvas_page' END AS kind, doc_id % 7 = 0 AS has_text, doc_id % 2 = 0 AS known, doc_id % 5 = 0 AS there, doc_id % 10 <> 0 AS same,
    CASE WHEN doc_id % 4 = 0 THEN 'artifact_attached' WHEN doc_id % 3 = 0 THEN 'notion_enriched' ELSE 'notion_created' END AS last FROM documents),
acted AS (
  SELECT *, CASE WHEN known AND same AND (CASE WHEN kind = 'file_artifact' THEN last = 'artifact_attached' ELSE last = 'notion_created' END) THEN 'skipped' WHEN known OR there THEN 'updated' ELSE 'created' END AS action FROM sent),
done AS (
  SELECT *, CASE WHEN action = 'skipped' THEN last WHEN has_text THEN 'notion_enriched' WHEN kind = 'file_artifact' THEN 'artifact_pending' WHEN known THEN 'notion_updated' ELSE 'notion_created' END AS status FROM acted)"""

_LINKS = r"""WITH raw AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS origin, url, regexp_extract_all(html, '<a href="[^"]+">[^<]*</a>') AS a FROM pages),
one AS (SELECT page_id, origin, url, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS a FROM raw),
cut AS (SELECT *, regexp_extract(a, 'href="([^"]+)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label FROM one)"""

SQL = {
    "weekly_tasks_by_course": f"WITH {_TASKS} SELECT course_id, course_name, count(*) AS due_count, count(*) FILTER (WHERE {_URGENT}) AS urgent_count, min(due) AS first_due FROM due GROUP BY course_id, course_name",
    "urgent_tasks": f"WITH {_TASKS} SELECT content_object_id, course_id, due FROM due WHERE {_URGENT}",
    "refs_union_all_dups": f"WITH {_TASKS} SELECT content_object_id, seq, part FROM (SELECT content_object_id, seq, 0 AS part FROM due WHERE {_URGENT} UNION ALL SELECT content_object_id, seq, 1 FROM due) ORDER BY part, seq LIMIT 80",
    "metadata_gaps_top20": "SELECT doc_id, source || ':' || doc_id AS title FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY title LIMIT 20",
    "rolling_7d_events": _events("2024-01-14", "2024-01-20"),
    "custom_window_events": _events("2024-01-05", "2024-01-11"),
    "content_counts_by_course_type": "SELECT source AS course_key, source AS course_name, CAST(sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS items, lang AS content_type, count(*) AS n FROM documents GROUP BY source, lang",
    "content_overview": "SELECT 'workspace' AS grain, NULL AS course_key, count(*) AS items, count(DISTINCT source) AS courses FROM documents UNION ALL SELECT 'course', source, count(*), 1 FROM documents GROUP BY source",
    "content_bullets": f"""
SELECT course_key, n, CASE WHEN snip <> '' AND snip <> title THEN line || ' - ' || snip ELSE line END AS bullet FROM (
  SELECT source AS course_key, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS n, {_TITLE} AS title, {_TITLE} || ' (' || upper(lang[1]) || lang[2:] || ')' AS line, substr({collapsed('text')}, 1, 240) AS snip FROM documents)
WHERE n <= 8""",
    "content_overview_rollup": "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)",
    "inventory_union": f"WITH {_INVENTORY} SELECT content_type, content_path_type, extraction_status, supported_extraction, count(*) AS n FROM inventory GROUP BY ALL",
    "inventory_summary": f"""WITH {_INVENTORY} SELECT count(*) AS total_records, count(*) FILTER (WHERE content_type = 'course') AS courses, count(*) FILTER (WHERE content_path_type = 'direct_ingest') AS direct_ingest_candidates,
  count(*) FILTER (WHERE content_type = 'file_artifact') AS file_artifact_candidates, count(*) FILTER (WHERE supported_extraction AND extraction_status = 'not_started') AS extraction_pending_items,
  count(*) FILTER (WHERE extraction_status = 'extracted') AS extracted_items, count(*) FILTER (WHERE extraction_status = 'unsupported') AS unsupported_items, count(*) FILTER (WHERE content_type = 'deliverable') AS deliverables FROM inventory""",
    "extraction_left_merge": f"WITH {_MERGED} SELECT content_object_id, processing_state, extraction_status, normalization_status, enrichment_status, chunk_count, automation_ready, failure_reason, content_readiness_state FROM merged",
    "extraction_summary_counts": f"""WITH {_MERGED}, {_QUEUE.split(chr(10) + 'queue AS')[0].rstrip(',')} SELECT count(*) AS total, count(*) FILTER (WHERE extraction_status = 'extracted') AS extracted, count(*) FILTER (WHERE extraction_status = 'failed') AS failed,
  count(*) FILTER (WHERE extraction_status = 'unsupported') AS unsupported, count(*) FILTER (WHERE chunk_count > 0) AS chunked, CAST(0 AS BIGINT) AS enriched, count(*) FILTER (WHERE automation_ready) AS automation_ready,
  (SELECT count(*) FROM jobs WHERE status IN ('queued', 'processing')) AS pending FROM merged""",
    "queue_recovery": f"WITH {_QUEUE} SELECT * FROM queue",
    "enqueue_outcomes": f"""WITH {_FILES}, {_QUEUE} SELECT CASE WHEN NOT f.supported THEN 'unsupported' WHEN l.quality = 1 OR q.job_id IS NOT NULL THEN 'skipped' ELSE 'enqueued' END AS outcome, count(*) AS n
  FROM files f LEFT JOIN labels l ON l.doc_id = f.doc_id LEFT JOIN queue q ON q.content_object_id = f.content_object_id GROUP BY 1""",
    "history_top80": f"WITH {_QUEUE} SELECT job_id, status FROM jobs ORDER BY event_id DESC LIMIT 80",
    "extraction_descriptors": f"""WITH {_FILES} SELECT CAST(doc_id AS VARCHAR) AS id, supported, CASE WHEN supported THEN ext ELSE 'unsupported' END AS source_category,
  CASE ext WHEN 'pptx' THEN 'slides' WHEN 'doc' THEN 'legacy_word' WHEN 'zip' THEN 'unknown_binary' ELSE ext END AS artifact_kind,
  CASE ext WHEN 'pdf' THEN 'pdfjs_text_v1' WHEN 'docx' THEN 'mammoth_docx_v1' WHEN 'txt' THEN 'plain_text_v1' ELSE '' END AS method,
  CASE ext WHEN 'txt' THEN 'fetch_text' WHEN 'pdf' THEN 'fetch_binary' WHEN 'docx' THEN 'fetch_binary' ELSE 'none' END AS fetch_mode,
  CASE ext WHEN 'pptx' THEN 'Slide deck extraction is not supported yet.' WHEN 'doc' THEN 'Legacy .doc extraction is not supported in Phase 4.' WHEN 'zip' THEN 'Unsupported binary file type: .zip.' ELSE '' END AS reason FROM files""",
    "course_semi_filter": f"WITH {_TASKS} SELECT course_id, count(*) AS n FROM tasks WHERE course_name < 'NATION_13' GROUP BY course_id",
    "visited_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "latest_run_per_automation": "SELECT event_type, event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "run_log_top30": "SELECT event_id, user_id, ts FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) ORDER BY ts DESC, user_id LIMIT 30",
    "canonical_urls": f"WITH {_CANONICAL} SELECT page_id, canonical_url FROM urls",
    "url_dedupe": f"WITH {_CANONICAL} SELECT canonical_url, min(page_id) AS page_id, count(*) AS n FROM urls GROUP BY canonical_url",
    "url_parts_classify": r"""WITH split AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
named AS (SELECT *, CASE WHEN regexp_matches(seg, '^[0-9]+$') THEN '' ELSE seg END AS file_name FROM (SELECT *, regexp_extract(path, '([^/]*)/*$', 1) AS seg FROM split)),
ext AS (SELECT *, lower(regexp_extract(file_name, '\.([A-Za-z0-9]{1,8})$', 1)) AS extension FROM named)
SELECT page_id, host, path, file_name, extension, CASE WHEN extension IN ('html', 'htm', 'txt') THEN 'text' WHEN extension = 'pdf' THEN 'pdf' ELSE 'other' END AS category,
  extension IN ('pdf', 'doc', 'docx', 'html', 'htm', 'ppt', 'pptx', 'xls', 'xlsx', 'txt', 'zip') AS is_document, 'unsupported' AS page_mode FROM ext""",
    "text_metrics": rf"""WITH plain AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> '')) AS INTEGER) AS words, CAST(length(t) AS INTEGER) AS chars,
  CAST(len(list_filter(regexp_split_to_array(t, '\n{{2,}}'), lambda p: trim(p, ' ' || chr(10)) <> '')) AS INTEGER) AS paragraphs, CAST(greatest(1, ceil(length(t) / 4.0)) AS INTEGER) AS tokens FROM plain""",
    "stable_hash_docs": """SELECT doc_id, 'h' || CAST(abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda h, c: (((h * 31 + c) + 2147483648) & 4294967295) - 2147483648)) AS VARCHAR) AS hash FROM documents""",
    "js_gate_filter": f"""WITH shown AS (SELECT source, lower({collapsed("CASE WHEN doc_id % 2 = 0 THEN 'You need to  enable JavaScript to run this app. ' || text ELSE text END")}) AS t FROM documents)
SELECT source, count(*) AS n FROM shown WHERE contains(t, 'you need to enable javascript to run this app') AND len(string_split(t, ' ')) <= 40 GROUP BY source""",
    "doc_content_dedupe": """SELECT CAST(min(doc_id) AS VARCHAR) AS id, lang AS content_type, arg_min(source, struct_pack(l := -length(source), d := doc_id)) AS course_name, arg_max(source, doc_id) AS content_hash, count(*) - 1 AS merged FROM documents GROUP BY lang, text""",
    "merge_longest_wins": "SELECT p_brand AS course_id, arg_min(p_name, struct_pack(l := -length(p_name), d := p_partkey)) AS course_name, arg_min(p_type, p_partkey) AS term FROM part GROUP BY p_brand",
    "document_dedupe": f"""WITH {_CANONICAL.replace('FROM pages', "FROM (SELECT page_id, regexp_replace(url, '^https?', 'https') AS url FROM pages)")}
SELECT 'url:https://school.example.com:' || (page_id % 3) || ':' || canonical_url AS key, CASE page_id % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'files' ELSE 'other' END AS source_section,
  arg_min('f' || page_id, struct_pack(l := -length('f' || page_id), p := page_id)) AS file_name, bool_or(page_id % 2 = 0) AS is_hosted, count(*) - 1 AS merged, min(page_id) AS seq FROM urls GROUP BY page_id % 3, canonical_url""",
    "token_topk_by_course": f"""WITH words AS (
  SELECT source AS course_key, unnest(string_split({collapsed(f"regexp_replace(lower(t || ' ' || {collapsed('t')}), '[^a-z0-9' || substr('{WS}', 2), ' ', 'g')")}, ' ')) AS token FROM (SELECT source, {_TITLE} AS t FROM documents)),
counted AS (SELECT course_key, token, count(*) AS score FROM words WHERE length(token) >= 4 AND token NOT IN ('from', 'into', 'that', 'this', 'with', 'your', 'week', 'module', 'page', 'pages', 'assignment', 'assignments', 'content', 'course', 'class', 'canvas', 'file', 'files', 'source', 'section', 'synced', 'extract', 'extracted', 'overview', 'recap') GROUP BY ALL)
SELECT course_key, CAST(row_number() OVER (PARTITION BY course_key ORDER BY score DESC, token) AS INTEGER) AS rank, token, score FROM counted QUALIFY rank <= 10""",
    "token_topk_of_content": f"""WITH words AS (
  SELECT source AS course_key, unnest(string_split({collapsed(f"regexp_replace(lower(t || ' ' || s), '[^a-z0-9' || substr('{WS}', 2), ' ', 'g')")}, ' ')) AS token FROM (SELECT source, {_TITLE} AS t, substr({collapsed('text')}, 1, 240) AS s FROM documents)),
counted AS (SELECT course_key, token, count(*) AS score FROM words WHERE length(token) >= 4 AND token NOT IN ('from', 'into', 'that', 'this', 'with', 'your', 'week', 'module', 'page', 'pages', 'assignment', 'assignments', 'content', 'course', 'class', 'canvas', 'file', 'files', 'source', 'section', 'synced', 'extract', 'extracted', 'overview', 'recap') GROUP BY ALL)
SELECT course_key, CAST(row_number() OVER (PARTITION BY course_key ORDER BY score DESC, token) AS INTEGER) AS rank, token, score FROM counted QUALIFY rank <= 10""",
    "frontier_scan": "SELECT CAST(i AS VARCHAR) AS url, CAST(floor(log2(i + 1)) AS INTEGER) AS hop, CAST(i + 1 AS INTEGER) AS pos FROM (SELECT unnest(range(least(250, 2 * count(*) + 1))) AS i FROM documents)",
    "page_block_rows": rf"""WITH parts AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(html, '<h1[^>]*>', '<p>' || chr(1), 'g').regexp_replace('(?s)<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->', '', 'g'), '</?(?:p|div|article|h1|body|html|!DOCTYPE)[^>]*>'),
  lambda x: {collapsed("replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&amp;', '&')")}), lambda x: x NOT IN ('', chr(1))) AS p FROM pages)
SELECT page_id, CAST(unnest(generate_series(0, len(p) - 1)) AS INTEGER) AS ord, unnest(list_transform(p, lambda x: CASE WHEN x[1] = chr(1) THEN 'heading' ELSE 'paragraph' END)) AS type, CAST(unnest(list_transform(p, lambda x: CASE WHEN x[1] = chr(1) THEN 1 ELSE 0 END)) AS INTEGER) AS level, unnest(list_transform(p, lambda x: ltrim(replace(x, chr(1), '')))) AS text FROM parts""",
    "page_facts": rf"""WITH s AS (SELECT page_id, url, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_replace(html, '(?s)<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->', '', 'g') AS h FROM pages),
parts AS (SELECT page_id, url, {collapsed("replace(replace(regexp_replace(h1, '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&amp;', '&')")} AS title, list_filter(list_transform(regexp_split_to_array(h, '<(?:br|/?(?:p|div|article|h1|body|html|!DOCTYPE))[^>]*>'),
  lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&amp;', '&'), chr(160), ' '), '[ \t]{{2,}}', ' ', 'g'), ' ' || chr(10) || chr(9))), lambda x: x <> '') AS p FROM s)
SELECT page_id, url, CASE WHEN title = '' THEN 'Page' ELSE title END AS title, CAST(NULL AS VARCHAR) AS due_date, '' AS week_or_module, regexp_replace(array_to_string(p, chr(10)), '{WS}*\n{WS}*', chr(10), 'g') AS body_text, 'canvas_page' AS content_type FROM parts""",
    "page_links": _LINKS + " SELECT page_id, CAST(ord AS INTEGER) AS ord, href, CASE WHEN starts_with(href, '/') THEN origin || href ELSE href END AS url, label, '' AS rel FROM cut",
    "page_link_kinds": _LINKS + r""" SELECT page_id, CAST(0 AS BIGINT) AS hosted, count(*) FILTER (WHERE doc AND outside) AS external, count(*) FILTER (WHERE doc AND NOT outside) AS document, count(*) FILTER (WHERE NOT doc) AS ignored, CAST(0 AS BIGINT) AS no_url
FROM (SELECT page_id, regexp_matches(lower(href), '\.(pdf|docx?|html?|pptx?|xlsx?|txt|zip)$') AS doc, starts_with(href, 'http') AND NOT starts_with(href, origin) AS outside FROM cut) GROUP BY page_id""",
    "page_file_names": _LINKS + r""", named AS (SELECT *, regexp_extract(href, '([^/]*)/*$', 1) AS seg FROM cut)
SELECT page_id, CAST(ord AS INTEGER) AS ord, href, label, CASE WHEN regexp_matches(label, '\.[A-Za-z0-9]{1,8}$') THEN label WHEN seg = '' OR regexp_matches(seg, '^[0-9]+$') THEN label ELSE seg END AS file_name, NULL AS folder_hint FROM named""",
    "dashboard_courses": _LINKS + """ SELECT page_id, origin, CAST(page_id % 25 AS VARCHAR) AS course_id, arg_min(label, struct_pack(l := -length(label), o := ord)) AS course_name, origin || '/courses/' || page_id % 25 AS course_url, NULL AS term
FROM cut WHERE label <> '' AND lower(label) NOT IN ('grades', 'modules', 'files', 'pages', 'assignments', 'home', 'syllabus', 'announcements', 'more options') GROUP BY page_id, origin""",
    "phrase_topk_by_course": """WITH seg AS (
  SELECT p_brand AS course_key, p_partkey, unnest([p_name, p_type, p_name]) AS text, unnest([3, 3, 1]) AS w, unnest([0, 1, 2]) AS pos FROM part),
scored AS (SELECT course_key, lower(text) AS normalized, CAST(sum(w) AS BIGINT) AS score, arg_min(text, struct_pack(l := -length(text), p := p_partkey, q := pos)) AS phrase FROM seg WHERE length(text) >= 4 GROUP BY course_key, lower(text))
SELECT course_key, CAST(row_number() OVER (PARTITION BY course_key ORDER BY score DESC, phrase, normalized) AS INTEGER) AS rank, phrase, normalized, score FROM scored QUALIFY rank <= 6""",
    "heading_trail": """WITH c AS (SELECT conv_id, turn, text AS label, CASE WHEN role = 'user' THEN 2 WHEN role = 'system' THEN 1 WHEN turn % 3 = 0 THEN 3 END AS level FROM conversations),
p AS (SELECT *, max(CASE WHEN level = 1 THEN turn END) OVER w AS t1, max(CASE WHEN level = 2 THEN turn END) OVER w AS t2, max(CASE WHEN level = 3 THEN turn END) OVER w AS t3 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT p.conv_id, p.turn, concat_ws(' > ', nullif(a.label, ''), nullif(b.label, ''), nullif(d.label, '')) AS trail FROM p
LEFT JOIN c a ON a.conv_id = p.conv_id AND a.turn = p.t1
LEFT JOIN c b ON b.conv_id = p.conv_id AND b.turn = p.t2 AND p.t2 > coalesce(p.t1, -1)
LEFT JOIN c d ON d.conv_id = p.conv_id AND d.turn = p.t3 AND p.t3 > greatest(coalesce(p.t1, -1), coalesce(p.t2, -1))""",
    "page_link_counts": "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"[^\"]+\"')) AS BIGINT) AS n FROM pages WHERE len(regexp_extract_all(html, '<a href=\"[^\"]+\"')) > 0",
    "sync_actions": f"WITH {_SYNC} SELECT action, status, count(*) AS n FROM done GROUP BY ALL",
    "sync_second_run": f"""WITH {_SYNC} SELECT CASE WHEN (kind = 'file_artifact' AND status = 'artifact_attached') OR (kind <> 'file_artifact' AND status IN ('notion_created', 'notion_updated')) THEN 'skipped' ELSE 'updated' END AS action, count(*) AS n FROM done GROUP BY 1""",
    "definition_overlay": """SELECT automation_id, name, output_type, CAST(CASE automation_id WHEN 10 THEN 1 WHEN 20 THEN 2 ELSE 3 END AS INTEGER) AS position FROM (
  SELECT CAST(r_regionkey * 10 AS BIGINT) AS automation_id, r_name AS name, 'recap' AS output_type FROM region
  UNION ALL SELECT n_nationkey, n_name, 'overview' FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 10 FROM region))""",
    "plan_summary": f"""WITH {_PLAN} SELECT count(*) FILTER (WHERE plan_type = 'course_hub') AS course_hubs, count(*) FILTER (WHERE plan_type = 'content') AS content_entries, count(*) FILTER (WHERE plan_type = 'deliverable') AS deliverables,
  count(*) FILTER (WHERE plan_type = 'study_asset') AS study_asset_containers, count(*) FILTER (WHERE plan_type = 'content' AND path = 'direct_ingest') AS direct_ingest_candidates, count(*) FILTER (WHERE plan_type = 'content' AND path = 'file_artifact') AS file_artifact_candidates,
  count(*) FILTER (WHERE plan_type = 'content' AND supported AND status = 'not_started') AS extraction_pending_items, count(*) FILTER (WHERE plan_type <> 'course_hub' AND eligible) AS automation_eligible_records,
  count(*) FILTER (WHERE plan_type = 'content' AND (ready OR chunks > 0)) AS automation_ready_now FROM plans""",
    "contract_summary": f"""WITH {_PLAN}, rows AS (
  SELECT *, CASE WHEN future THEN 'future' WHEN ready OR chunks > 0 OR status = 'extracted' THEN 'text' WHEN path = 'direct_ingest' THEN 'text' WHEN supported THEN 'pending' ELSE 'none' END AS a FROM plans WHERE plan_type <> 'course_hub')
SELECT count(*) AS total_records, count(*) FILTER (WHERE a = 'text') AS records_with_text_path, count(*) FILTER (WHERE a = 'pending') AS extraction_pending_records, CAST(0 AS BIGINT) AS due_date_ready_records,
  count(*) FILTER (WHERE source_url <> '') AS source_traceable_records, count(*) FILTER (WHERE eligible) AS automation_eligible_records, CAST(0 AS BIGINT) AS automation_ready_now FROM rows""",
    "readiness_counts": f"WITH {_PLAN} SELECT plan_type, readiness, location, count(*) AS n FROM plans GROUP BY ALL",
    "readiness_level": f"WITH {_PLAN} SELECT CASE WHEN NOT bool_or(path <> 'unknown') THEN 'metadata_only' WHEN bool_or(ready) THEN 'automation_ready_partial' WHEN bool_or(status = 'extracted' OR chunks > 0) THEN 'content_ready' ELSE 'metadata_only' END AS readiness_level FROM plans WHERE plan_type = 'content'",
    "validation_checks": """SELECT 'texts_present' AS "check", count(*) AS rows, count(*) FILTER (WHERE coalesce(text, '') = '') AS bad, CASE WHEN count(*) FILTER (WHERE coalesce(text, '') = '') = 0 THEN 'ok' ELSE 'blocked' END AS status FROM documents
  UNION ALL SELECT 'sources_present', count(*), count(*) FILTER (WHERE coalesce(source, '') = ''), CASE WHEN count(*) FILTER (WHERE coalesce(source, '') = '') = 0 THEN 'ok' ELSE 'blocked' END FROM documents
  UNION ALL SELECT 'short_texts', count(*), count(*) FILTER (WHERE n_chars < 100), CASE WHEN count(*) FILTER (WHERE n_chars < 100) = 0 THEN 'ok' ELSE 'warning' END FROM documents
  UNION ALL SELECT 'tasks_dated', count(*), count(*) FILTER (WHERE o_orderdate IS NULL), CASE WHEN count(*) FILTER (WHERE o_orderdate IS NULL) = 0 THEN 'ok' ELSE 'blocked' END FROM orders
  UNION ALL SELECT 'secure_urls', count(*), count(*) FILTER (WHERE NOT starts_with(url, 'https:')), CASE WHEN count(*) FILTER (WHERE NOT starts_with(url, 'https:')) = 0 THEN 'ok' ELSE 'warning' END FROM pages""",
    "progress_totals": "SELECT CAST(sum(n) AS BIGINT) AS pages, CAST(sum(errors) AS BIGINT) AS errors, count(*) FILTER (WHERE errors > 0) AS with_errors, count(*) AS courses FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id)",
}
SQL["manifest_of_version_1"] = SQL["inventory_union"]
SQL["manifest_document_lists"] = "SELECT source AS course_id, CAST(doc_id // 1000 AS BIGINT) AS part, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS ids FROM documents GROUP BY ALL"
