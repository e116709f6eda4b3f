"""Checking SQL for the registered queries (DuckDB dialect, whole tables)."""

from linktrove import fixed_values as V
from linktrove.functions import html as H
from linktrove.operators import inference, summary
from linktrove.plans import views as D

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in phrases) + ")"


def replaced(column: str, rules: list[tuple[str, str]]) -> str:
    """Nested regexp_replace calls for a rule list ($1 -> \\1)."""
    for pattern, to in rules:
        for n in "12":
            to = to.replace("$" + n, "\\" + n)
        column = f"regexp_replace({column}, {q(pattern)}, {q(to)}, 'g')"
    return column


def strip(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


PLAIN = r"https?://(?:[a-zA-Z0-9\-_./?=&%~+:@!$,]+|\(\S+\))+"
TRACKERS = "[" + ", ".join(q(t) for t in V.TRACKER_PARAMS) + "]"

CAPTURES = f"""captures AS (
  SELECT page_id AS id, 1 + page_id % 2 AS project_id, {D.CONTENT} AS content, {D.DESCRIPTION} AS description,
    CASE WHEN page_id % 10 = 0 THEN ['{V.NOT_SCRAPEABLE}'] ELSE CAST([] AS VARCHAR[]) END AS labels,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS created_at
  FROM (SELECT *, {D.Q} AS q FROM pages))"""


def cleaned(source: str, out: str, keep: str) -> str:
    """CTEs that clean column ``u`` of ``source`` into ``url`` of ``out``."""
    return rf"""{out}_1 AS (
  SELECT {keep}, replace(trim(regexp_replace(u, '[\])]+$', ''), '<>'), '//x.com', '//twitter.com') AS u FROM {source}),
{out}_2 AS (
  SELECT {keep}, regexp_extract(u, '^[^?#]*') AS base, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query,
    regexp_extract(u, '#(.*)$', 1) AS fragment FROM {out}_1),
{out}_3 AS (
  SELECT *, list_transform(
      list_filter(string_split(query, '&'), lambda s: s <> '' AND NOT list_contains({TRACKERS}, lower(split_part(s, '=', 1)))),
      lambda s: CASE WHEN contains(s, '=') THEN s ELSE s || '=' END) AS params FROM {out}_2),
{out}_4 AS (
  SELECT *, list_transform(params, lambda s: split_part(s, '=', 1)) AS names FROM {out}_3),
{out}_5 AS (
  SELECT {keep}, base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_transform(list_sort(
      list_transform(params, lambda s, i: {{'k': list_position(names, split_part(s, '=', 1)), 'i': i, 's': s}})),
      lambda r: r.s), '&') ELSE '' END
    || CASE WHEN contains(fragment, 'page=') OR contains(fragment, 'section=') OR starts_with(fragment, 'h.')
      THEN '#' || fragment ELSE '' END AS u FROM {out}_4),
{out} AS (
  SELECT {keep}, CASE WHEN u LIKE '%/' AND length(u) - length(replace(u, '/', '')) > 2
    THEN regexp_replace(u, '/+$', '') ELSE u END AS url FROM {out}_5)"""


VIDEO_ID = r"""CASE WHEN contains(url, 'list=') AND NOT contains(url, 'v=') THEN NULL
  WHEN contains(url, 'youtu.be/') THEN regexp_extract(url, 'youtu\.be/([^?#]+)', 1)
  WHEN contains(url, 'youtube.com/watch?') THEN regexp_extract(url, '[?&]v=([^&#]+)', 1) END"""

TASK_URLS = f"""{CAPTURES},
found AS (
  SELECT id AS task_id, created_at, labels, list_concat(
    list_concat(regexp_extract_all(content, {q(PLAIN)}), regexp_extract_all(content, {q(V.MARKDOWN_URL)}, 1)),
    list_concat(regexp_extract_all(description, {q(PLAIN)}), regexp_extract_all(description, {q(V.MARKDOWN_URL)}, 1))) AS l
  FROM captures),
raw_urls AS (SELECT task_id, created_at, unnest(l) AS u, generate_subscripts(l, 1) AS o FROM found),
{cleaned("raw_urls", "clean_rows", "task_id, created_at, o")},
distinct_urls AS (
  SELECT task_id, created_at, url, min(o) AS o FROM clean_rows WHERE regexp_matches(url, '^(?i:https?)://[^/?#]+') GROUP BY ALL),
url_rows AS (
  SELECT task_id, created_at, url, row_number() OVER (PARTITION BY task_id ORDER BY o) - 1 AS pos FROM distinct_urls),
task_urls AS (
  SELECT *, {VIDEO_ID} AS video_id,
    CASE WHEN regexp_matches(url, '^https?://colab\\.research\\.google\\.com/') THEN 'notebook'
      WHEN contains(url, 'youtube.com/playlist?') THEN 'youtube_playlist'
      WHEN contains(url, 'youtu.be/') OR contains(url, 'youtube.com/watch?') THEN 'youtube'
      WHEN regexp_matches(url, '^https://twitter\\.com/[^/]+/status/[0-9]+') THEN 'twitter'
      WHEN contains(url, 'arxiv.org/pdf/') THEN 'pdf'
      WHEN regexp_matches(url, '^https://github\\.com/[^/]+/[^/]+') THEN 'github'
      ELSE 'webpage' END AS kind
  FROM url_rows)""".replace("\\\\", "\\")

LEDGER = f"""page_urls AS (SELECT page_id, url AS u FROM pages),
{cleaned("page_urls", "clean_pages", "page_id")},
ledger AS (
  SELECT url, max(page_id) AS task_id, TIMESTAMP '2023-12-01 00:00:00' AS processed_at, max(page_id) % 5 = 0 AS success
  FROM clean_pages GROUP BY url)"""

ATTEMPTS = f"""attempts AS (
  SELECT task_id, created_at, pos, url, kind AS type, video_id, {D.ATTEMPT_CONTENT} AS content, {D.ATTEMPT_ERROR} AS error,
    {D.ATTEMPT_S3} AS s3_url, {D.ATTEMPT_MARKDOWN} AS markdown_path FROM task_urls),
attempt_rows AS (
  SELECT *, coalesce(content, '') LIKE 'Summary of%' AS success FROM attempts)"""

BASE = f"{TASK_URLS},\n{LEDGER},\n{ATTEMPTS}"

# --- URLs -----------------------------------------------------------------------------
ORACLES["link_census"] = rf"""WITH {BASE}
SELECT kind, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, count(*) AS n_links, count(DISTINCT url) AS n_urls
FROM task_urls WHERE url NOT IN (SELECT url FROM ledger WHERE success) GROUP BY ALL"""

ORACLES["extract_urls"] = f"WITH {TASK_URLS} SELECT task_id, CAST(pos AS INT) AS pos, url FROM task_urls"

ORACLES["clean_url"] = f"WITH {LEDGER} SELECT page_id, url FROM clean_pages"

ORACLES["valid_url"] = """WITH shapes AS (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'ftp' || url WHEN 2 THEN replace(url, '://', ':')
    WHEN 3 THEN upper(url) ELSE 'https:///' || page_id END AS url FROM pages)
SELECT page_id, url, CAST(page_id % 5 IN (0, 3) AS INT) AS valid FROM shapes"""

ORACLES["url_kind"] = rf"""WITH {TASK_URLS}
SELECT task_id, CAST(pos AS INT) AS pos, kind, video_id,
  CASE WHEN kind = 'youtube_playlist' THEN regexp_extract(url, 'list=([^&]+)', 1) END AS playlist_id,
  CASE WHEN kind = 'twitter' THEN regexp_extract(url, 'status/([0-9]+)', 1) END AS tweet_id,
  CASE WHEN contains(url, 'list=') THEN 'playlist' WHEN contains(url, '/@') THEN 'channel' ELSE 'video' END AS collection
FROM task_urls"""

ORACLES["ordered_union"] = f"""WITH {CAPTURES},
sides AS (
  SELECT id AS task_id, side, list_concat(regexp_extract_all(t, {q(PLAIN)}), regexp_extract_all(t, {q(V.MARKDOWN_URL)}, 1)) AS l
  FROM (SELECT id, description AS t, 1 AS side FROM captures UNION ALL SELECT id, content, 2 FROM captures)),
raw_urls AS (SELECT task_id, side, unnest(l) AS u, generate_subscripts(l, 1) AS o FROM sides),
{cleaned("raw_urls", "c", "task_id, side, o")},
per_side AS (SELECT task_id, side, url, min(o) AS o FROM c GROUP BY ALL),
first_seen AS (SELECT task_id, url, min(side * 1000 + o) AS o FROM per_side GROUP BY ALL),
unions AS (SELECT task_id, string_agg(url, ' ' ORDER BY o) AS u FROM first_seen GROUP BY ALL),
sizes AS (SELECT task_id, sum(CASE side WHEN 1 THEN 2 ELSE 1 END) AS n FROM per_side GROUP BY ALL)
SELECT id AS task_id, coalesce(u, '') AS union_urls, CAST(coalesce(n, 0) AS INT) AS n_all
FROM captures LEFT JOIN unions ON id = unions.task_id LEFT JOIN sizes ON id = sizes.task_id"""

ORACLES["concat_task_lists"] = """SELECT 1 + page_id % 2 AS project_id, 2 * count(*) AS n_rows, count(*) AS n_with_content
FROM pages GROUP BY ALL"""

# --- ledger -----------------------------------------------------------------------------
ORACLES["unseen_urls"] = f"""WITH {BASE}
SELECT task_id, CAST(pos AS INT) AS pos, url FROM task_urls WHERE url NOT IN (SELECT url FROM ledger WHERE success)"""

GATED = """gated AS (
  SELECT a.*, coalesce(l.success, FALSE) OR coalesce(max(CAST(a.success AS INT)) OVER (
      PARTITION BY a.url ORDER BY a.created_at, a.task_id, a.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skip
  FROM attempt_rows a LEFT JOIN (SELECT DISTINCT url, TRUE AS success FROM ledger WHERE success) l ON a.url = l.url)"""

ORACLES["attempt_gate"] = f"""WITH {BASE}, {GATED}
SELECT task_id, CAST(pos AS INT) AS pos, url, CAST(skip AS INT) AS ledger_skip FROM gated"""

ORACLES["video_dedup"] = f"""WITH {BASE}
SELECT task_id, CAST(pos AS INT) AS pos, url, video_id, CAST(video_id IS NOT NULL AND
  row_number() OVER (PARTITION BY task_id, video_id ORDER BY pos) > 1 AS INT) AS duplicate
FROM task_urls WHERE url NOT IN (SELECT url FROM ledger WHERE success)"""

ORACLES["gate_rows"] = f"""WITH {BASE}, {GATED}
SELECT task_id, CAST(pos AS INT) AS pos, url, CASE WHEN skip THEN 'ledger_skip'
  WHEN video_id IS NOT NULL AND row_number() OVER (PARTITION BY task_id, video_id, skip ORDER BY pos) > 1 THEN 'duplicate'
  ELSE 'try' END AS action FROM gated"""


def walk(source: str) -> str:
    """Recursive fold, task after task, per video (or plain URL): state s = URLs succeeded so far."""
    return f"""grouped AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY created_at, task_id) AS n FROM (
    SELECT coalesce('v:' || video_id, 'u:' || url) AS g, created_at, task_id,
      list({{'pos': pos, 'url': url, 'ok': success}} ORDER BY pos) AS us
    FROM {source} GROUP BY ALL)),
start AS (
  SELECT g, list(DISTINCT url) AS s FROM (SELECT g, unnest(us).url AS url FROM grouped)
  WHERE url IN (SELECT url FROM ledger WHERE success) GROUP BY g),
walk AS (
  SELECT b.g, b.n, b.task_id, b.us, coalesce(start.s, CAST([] AS VARCHAR[])) AS s FROM grouped b LEFT JOIN start ON b.g = start.g WHERE b.n = 1
  UNION ALL
  SELECT b.g, b.n, b.task_id, b.us, CASE WHEN list_filter(w.us, lambda x: NOT list_contains(w.s, x.url))[1].ok
    THEN list_append(w.s, list_filter(w.us, lambda x: NOT list_contains(w.s, x.url))[1].url) ELSE w.s END
  FROM walk w JOIN grouped b ON b.g = w.g AND b.n = w.n + 1),
steps AS (
  SELECT g, task_id, s, list_filter(us, lambda x: NOT list_contains(s, x.url))[1].pos AS first_pos, unnest(us) AS r FROM walk),
acted AS (
  SELECT task_id, r.pos AS pos, r.url AS url, CASE WHEN list_contains(s, r.url) THEN 'ledger_skip'
    WHEN g LIKE 'v:%' AND r.pos > first_pos THEN 'duplicate' ELSE 'try' END AS action FROM steps)"""


ORACLES["gate_with_aliases"] = f"""WITH RECURSIVE {BASE}, {walk("attempt_rows")}
SELECT task_id, CAST(pos AS INT) AS pos, url, action FROM acted"""

MERGED = """last_rows AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, task_id DESC, pos DESC) AS rn FROM attempt_rows),
merged AS (
  SELECT coalesce(u.url, l.url) AS url, coalesce(u.task_id, l.task_id) AS task_id,
    coalesce(u.created_at, l.processed_at) AS processed_at, coalesce(u.success, l.success) AS success
  FROM ledger l FULL OUTER JOIN (SELECT * FROM last_rows WHERE rn = 1) u ON l.url = u.url)"""

ORACLES["ledger_upsert"] = f"""WITH {BASE}, {MERGED}
SELECT url, task_id, processed_at, CAST(success AS INT) AS success FROM merged"""
ORACLES["ledger_store"] = ORACLES["ledger_upsert"]
ORACLES["ledger_stats"] = f"""WITH {BASE}, {MERGED}
SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM merged"""

# --- tasks -------------------------------------------------------------------------------
ORACLES["flatten_task_pages"] = r"""WITH rows AS (
  SELECT conv_id * 1000 + turn AS page_no, turn % 4 AS shape, CAST(conv_id AS VARCHAR) AS project_id, role AS labels, text,
    string_split(text, chr(10)) AS l FROM conversations),
lines AS (
  SELECT page_no, shape, project_id, labels, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS i, len(l) AS n
  FROM rows WHERE shape <> 2)
SELECT page_no, CAST(i AS INT) AS item_no, CAST(i AS VARCHAR) AS id, project_id, content, labels FROM lines
UNION ALL SELECT page_no, CAST(n + i AS INT), CAST(i AS VARCHAR), project_id, content, labels FROM lines WHERE shape = 3
UNION ALL SELECT page_no, 0, '0', project_id, text, labels FROM rows WHERE shape = 2"""

ORACLES["capture_scope"] = f"WITH {CAPTURES} SELECT id, project_id, content FROM captures WHERE project_id = 2"
ORACLES["oldest_tasks"] = f"WITH {CAPTURES} SELECT id, created_at, content FROM captures ORDER BY created_at, id LIMIT 100"
ORACLES["label_filter"] = f"WITH {CAPTURES} SELECT id, content FROM captures WHERE NOT list_contains(labels, '{V.NOT_SCRAPEABLE}')"
ORACLES["label_append"] = f"SELECT page_id AS id, '{V.NOT_SCRAPEABLE}' AS labels, 1 AS n_labels FROM pages"
ORACLES["notebook_gate"] = """SELECT page_id AS id, CAST(page_id % 70 = 6 AND page_id % 50 <> 7 AS INT) AS has_notebook FROM pages"""

# --- outcomes -------------------------------------------------------------------------------
ORACLES["error_class"] = f"""WITH {BASE}
SELECT task_id, CAST(pos AS INT) AS pos, CASE (task_id + length(url)) % 6 WHEN 3 THEN 'llm_error' WHEN 4 THEN 'extract_error'
  WHEN 5 THEN 'no_content' ELSE 'ok' END AS error_class, 0 AS hidden_error FROM attempts"""

RUN = f"""{BASE},
scope AS (SELECT *, list_contains(labels, '{V.NOT_SCRAPEABLE}') AS labelled, id % 70 = 6 AND id % 50 <> 7 AS notebook
  FROM captures WHERE project_id = 2),
work AS (SELECT * FROM attempt_rows WHERE task_id IN (SELECT id FROM scope WHERE NOT labelled AND NOT notebook)),
{walk("work")},
tried AS (SELECT w.* FROM work w JOIN acted a ON w.task_id = a.task_id AND w.pos = a.pos WHERE a.action = 'try'),
counts AS (SELECT task_id, count(*) FILTER (action <> 'ledger_skip') AS n_new, count(*) FILTER (action = 'ledger_skip') AS n_skip
  FROM acted GROUP BY task_id),
flags AS (
  SELECT task_id, count(*) AS n_tried, count(*) FILTER (success) AS n_ok,
    count(*) FILTER (error IS NOT NULL AND (content LIKE 'Error generating summary:%' OR contains(error, 'Error calling LLM'))) AS n_model,
    count(*) FILTER (content LIKE '[Error:%') AS n_extract,
    count(*) FILTER (content LIKE 'Error generating summary:%' OR contains(coalesce(error, ''), 'Error calling LLM')) AS n_counter
  FROM tried GROUP BY task_id),
states AS (
  SELECT s.id AS task_id, s.labels, labelled, notebook, coalesce(n_new, 0) AS n_new, coalesce(n_skip, 0) AS n_skip,
    coalesce(n_tried, 0) AS n_tried, coalesce(n_counter, 0) AS n_counter,
    CASE WHEN labelled OR notebook THEN 'skipped'
      WHEN coalesce(n_model, 0) > 0 OR coalesce(n_extract, 0) > 0 THEN 'failed'
      WHEN coalesce(n_new, 0) = 0 AND coalesce(n_skip, 0) > 0 THEN 'closed'
      WHEN coalesce(n_ok, 0) = 0 THEN 'failed' ELSE 'closed' END AS status
  FROM scope s LEFT JOIN counts ON s.id = counts.task_id LEFT JOIN flags ON s.id = flags.task_id),
outcome AS (
  SELECT *, CASE WHEN status = 'closed' AND n_counter > 0 THEN 'failed' WHEN status = 'closed' THEN 'successful' ELSE status END AS counted_as,
    status = 'closed' AND n_counter = 0 AND n_tried > 0 AS in_report,
    CASE WHEN status = 'failed' OR (notebook AND NOT labelled) THEN '{V.NOT_SCRAPEABLE}' ELSE array_to_string(labels, ',') END AS new_labels
  FROM states)"""

ORACLES["task_outcome"] = f"""WITH RECURSIVE {RUN}
SELECT task_id, status, counted_as, n_new, n_skip, new_labels AS labels, CAST(in_report AS INT) AS in_report FROM outcome"""

ORACLES["run_summary"] = f"""WITH RECURSIVE {RUN}
SELECT count(*) AS total_tasks_considered, count(*) AS tasks_to_process,
  count(*) FILTER (counted_as = 'successful') AS successful_tasks, count(*) FILTER (counted_as = 'failed') AS failed_tasks,
  count(*) FILTER (counted_as = 'skipped') AS skipped_tasks, count(*) FILTER (notebook AND NOT labelled) AS notebook_tasks_skipped,
  CAST(sum(n_skip) AS BIGINT) AS skipped_urls, CAST(sum(n_new) AS BIGINT) AS processed_urls,
  count(*) FILTER (status <> 'closed') AS tasks_remaining_in_capture FROM outcome"""

ORACLES["run_ledger_changes"] = f"""WITH RECURSIVE {RUN}
SELECT url, task_id, CAST(success AS INT) AS success FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, task_id DESC, pos DESC) AS rn FROM tried) WHERE rn = 1"""


def section(source: str, where: str) -> str:
    """Report sections of the tasks picked by ``where`` from the attempts in ``source``."""
    return rf"""links AS (
  SELECT *, CASE WHEN contains(s3_url, 'mp4') THEN '- [Video: 1](' || s3_url || ')' END AS l1,
    CASE WHEN markdown_path IS NOT NULL THEN '- [Markdown](' || markdown_path || ')' END AS l2,
    CASE WHEN contains(s3_url, '.png') THEN '- [Image](' || s3_url || ')' END AS l3 FROM {source}),
sections AS (
  SELECT task_id, pos, '**Type**: ' || upper(type[1]) || lower(type[2:]) || '  ' || chr(10)
    || '*Extraction Method: fixture*  ' || chr(10) || '  ' || chr(10)
    || CASE WHEN coalesce(l1, l2, l3) IS NOT NULL THEN concat_ws(chr(10), l1, l2, l3) || chr(10) || chr(10) ELSE '' END
    || CASE WHEN error IS NOT NULL THEN '**Error:** ' || error || chr(10) ELSE '' END
    || coalesce(content, '[No content extracted]') || chr(10) AS section FROM links),
heads AS (
  SELECT id AS task_id, '## ' || content || chr(10)
    || CASE WHEN description <> '' THEN chr(10) || '### Original Description' || chr(10) || '> ' || replace(description, chr(10), chr(10) || '> ') || chr(10) ELSE '' END
    || CASE WHEN len(labels) > 0 THEN chr(10) || '### Labels' || chr(10) || '`' || array_to_string(labels, '`, `') || '`' || chr(10) ELSE '' END AS head
  FROM captures WHERE {where}),
report AS (
  SELECT task_id, 0 AS part, any_value(head) || chr(10) || string_agg(section, chr(10) ORDER BY pos) || chr(10) || '---' || chr(10) AS markdown
  FROM heads JOIN sections USING (task_id) GROUP BY task_id)"""


ORACLES["task_report"] = f"""WITH RECURSIVE {RUN}, {section("tried", "id IN (SELECT task_id FROM outcome WHERE in_report)")}
SELECT task_id, part, markdown FROM report"""

BAD = "content LIKE '[Error:%' OR (error IS NOT NULL AND (content LIKE 'Error generating summary:%' OR contains(error, 'Error calling LLM')))"

ORACLES["write_report"] = f"""WITH {BASE},
{section("attempts", f"id NOT IN (SELECT task_id FROM attempts WHERE {BAD})")},
lines AS (SELECT unnest(string_split(markdown, chr(10))) AS value FROM report)
SELECT value, count(*) AS n FROM lines WHERE value <> '' GROUP BY value"""

ORACLES["report_filter"] = f"""WITH {BASE}
SELECT task_id, CAST(count(*) AS INT) AS n_attempts FROM attempts GROUP BY task_id HAVING count(*) FILTER ({BAD}) = 0"""
ORACLES["reportable_tasks"] = f"""WITH {BASE}
SELECT task_id FROM attempts GROUP BY task_id HAVING count(*) FILTER ({BAD}) = 0"""

ORACLES["batch_summary"] = """SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful,
  count(*) FILTER (event_type = 'error') AS failed, 1 AS success FROM events GROUP BY user_id"""

ORACLES["batch_summary_all"] = """SELECT coalesce(user_id, c_custkey) AS batch, count(event_id) AS total,
  count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed, CAST(count(event_id) > 0 AS INT) AS success
FROM events FULL OUTER JOIN customer ON user_id = c_custkey GROUP BY ALL"""

ORACLES["report_lines"] = f"""WITH {BASE},
{section("attempts", f"id NOT IN (SELECT task_id FROM attempts WHERE {BAD})")},
whole AS (SELECT '# Capture Report - 2024-06-01' || chr(10) || chr(10) || string_agg(markdown, chr(10) ORDER BY task_id) AS t FROM report)
SELECT generate_subscripts(string_split(t, chr(10)), 1) AS n, unnest(string_split(t, chr(10))) AS value FROM whole"""

ORACLES["retry_table"] = """WITH log AS (
  SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS rn FROM events),
state AS (
  SELECT user_id, day, count(*) AS attempts, bool_or(event_type = 'purchase') AS success, max(event_type) FILTER (rn = 1) AS last
  FROM log GROUP BY user_id, day)
SELECT user_id, day, attempts, CAST(success AS INT) AS success, CASE WHEN NOT success THEN 'failed: ' || last END AS error,
  CASE WHEN success THEN NULL WHEN last = 'error' THEN 'language_unavailable' ELSE 'other_error' END AS reason,
  CAST(NOT success AND last <> 'error' AND attempts < 3 AS INT) AS retry FROM state"""

# --- pages --------------------------------------------------------------------------------------
ENTITIES = [(name, char) for name, char in V.HTML_ENTITIES.items()]


def entities(column: str) -> str:
    for name, char in ENTITIES:
        column = f"replace({column}, {q(name)}, {q(char)})"
    return column


def squeezed(column: str) -> str:
    column = rf"regexp_replace({column}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(f"regexp_replace({column}, ' {{2,}}', ' ', 'g')")


TEXT_OF = squeezed(
    r"regexp_replace(" + entities(replaced("html", H.RAW_BLOCKS + H.WHITESPACE + H.TEXT_BLOCKS + H.ANY_TAG)) + r", ' *\n *', chr(10), 'g')"
)
MARKDOWN_OF = strip(
    r"regexp_replace(regexp_replace("
    + entities(replaced("html", H.RAW_BLOCKS + H.WHITESPACE + H.MARKDOWN_BLOCKS + H.ANY_TAG))
    + r", '\n +', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)


def inner(column: str) -> str:
    return strip(f"regexp_replace({entities(replaced(column, H.ANY_TAG))}, '[ \\t\\r\\n\\f]+', ' ', 'g')")


ORACLES["page_text"] = f"SELECT page_id, {TEXT_OF} AS text FROM pages"
ORACLES["page_markdown"] = f"SELECT page_id, {MARKDOWN_OF} AS markdown FROM pages"
ORACLES["page_fields"] = rf"""SELECT page_id, {inner("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
  array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>', 1), lambda h: {inner("h")}), '|') AS headings,
  CAST(len(regexp_extract_all(html, '<a href=')) AS INT) AS n_links, CAST(len(regexp_extract_all(html, '(?i)<img\b')) AS INT) AS n_images,
  CAST(len(regexp_extract_all(html, '(?i)<p\b')) AS INT) AS n_paragraphs FROM pages"""

SENTENCE = r"[^.!?\n]+(?:[.!?]+[^\s.!?][^.!?\n]*)*[.!?]*"
ANCHORS = rf"""anchors AS (
  SELECT page_id, url AS page_url, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(
    regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>', '', 'g'),
    '(?is)<a\b[^>]*>.*?</a\s*>') AS l FROM pages)),
links AS (
  SELECT page_id, CAST(pos AS INT) AS pos, {entities("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href, {inner("a")} AS text,
    regexp_extract(page_url, '^[a-z]+://[^/?#]*') AS origin FROM anchors)"""
ORACLES["page_links"] = f"WITH {ANCHORS} SELECT page_id, pos, href, text, origin || href AS url FROM links"
ORACLES["tweet_links"] = f"""WITH {ANCHORS}
SELECT page_id, pos, CASE pos % 5 WHEN 2 THEN CASE WHEN page_id % 2 = 0 THEN 'https://full.example.com' || href ELSE 'https://t.co/' || pos END
  ELSE CASE WHEN contains(href, 't.co') AND page_id % 2 = 0 THEN 'https://full.example.com' || href ELSE href END END AS link
FROM links WHERE pos % 5 NOT IN (0, 1)"""

ORACLES["content_gate"] = "SELECT doc_id, CAST(length(text) > 50 AND text NOT LIKE '[Error:%' AS INT) AS usable FROM documents"


def cut(keep: int, limit: int) -> str:
    return f"CASE WHEN length(text) > {limit} THEN left(text, {keep}) || '...' ELSE text END"


ORACLES["truncate_text"] = f"""SELECT doc_id, md5({cut(14000, 14000)}) AS page_md5, CAST(length({cut(25000, 25000)}) AS INT) AS transcript_chars,
  {cut(97, 100)} AS comment, {cut(297, 300)} AS description FROM documents"""

ORACLES["squeeze_text"] = rf"""WITH d AS (
  SELECT doc_id, '  ' || replace(replace(text, '. ', '.   '), chr(10), ' ' || repeat(chr(10), 4)) || ' ' || chr(10) AS text FROM documents)
SELECT doc_id, {squeezed("text")} AS text,
  regexp_replace(regexp_replace({strip("text")}, '\s+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS pdf_text FROM d"""


def summaries(docs: str, key: str) -> str:
    """Same scoring as plain SQL: word weights, sentence scores, running word budget."""
    return rf"""sents AS (
  SELECT {key}, unnest(l) AS sentence, generate_subscripts(l, 1) AS pos FROM (
    SELECT {key}, list_filter(list_transform(regexp_extract_all(text, {q(SENTENCE)}), lambda s: {strip("s")}),
      lambda s: regexp_matches(s, {q(summary.WORD)})) AS l FROM {docs})),
doc_words AS (SELECT {key}, unnest(list_distinct(regexp_extract_all(lower(text), {q(summary.WORD)}))) AS word FROM {docs}),
weights AS (
  SELECT word, CAST(round(ln((SELECT count(*) FROM {docs}) / count(*)) * 1000) AS BIGINT) AS weight FROM doc_words GROUP BY word),
sent_words AS (
  SELECT {key}, pos, len(l) AS n_words, unnest(list_distinct(l)) AS word FROM (
    SELECT {key}, pos, regexp_extract_all(lower(sentence), {q(summary.WORD)}) AS l FROM sents)),
scores AS (
  SELECT {key}, pos, max(n_words) AS n_words, CAST(sum(weight) AS BIGINT) // (count(*) + {summary.DAMPING}) AS score
  FROM sent_words JOIN weights USING (word) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER w AS rank, sum(n_words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM scores WINDOW w AS (PARTITION BY {key} ORDER BY score DESC, pos)),
chosen AS (SELECT * FROM ranked JOIN sents USING ({key}, pos) WHERE so_far <= {V.SUMMARY_WORDS} OR rank = 1),
summaries AS (
  SELECT {key}, string_agg(sentence, ' ' ORDER BY pos) AS summary,
    string_agg(sentence, chr(10) ORDER BY rank) FILTER (rank <= {V.SUMMARY_QUOTES}) AS quotes, CAST(sum(n_words) AS BIGINT) AS n_words
  FROM chosen GROUP BY {key})"""


ORACLES["extractive_summary"] = f"""WITH {summaries("documents", "doc_id")}
SELECT doc_id, summary, quotes, n_words FROM documents LEFT JOIN summaries USING (doc_id)"""

HIT = """CASE WHEN page_id % 4 = 1 THEN NULL WHEN page_id % 4 = 2 THEN 'Title: Hit 1 for ' || page_id || ' | Description: about ' || page_id
  ELSE 'Title: Hit 1 for ' || page_id END"""
ORACLES["fallback_enrich"] = f"""SELECT page_id, coalesce({HIT}, CASE WHEN page_id % 2 = 0 THEN {q(V.TIMEOUT_EMPTY_CONTENT)} ELSE {q(V.SEARCH_EMPTY_CONTENT)} END) AS content,
  CASE WHEN {HIT} IS NULL THEN 'Page load timeout' END AS error, CASE WHEN {HIT} IS NULL THEN 'unknown' ELSE 'google_search' END AS extraction_method
FROM pages"""

ORACLES["page_attempts"] = f"""WITH texts AS (SELECT page_id, {TEXT_OF} AS text FROM pages),
good AS (SELECT * FROM texts WHERE page_id % 6 <> 0 AND length(text) > 50 AND text NOT LIKE '[Error:%'),
{summaries("good", "page_id")}
SELECT page_id, 'webpage' AS type, summary AS content, NULL AS error, 'pandoc_llm' AS extraction_method
FROM good LEFT JOIN summaries USING (page_id)
UNION ALL
SELECT page_id, 'webpage', coalesce({HIT}, CASE WHEN page_id % 6 = 0 THEN {q(V.TIMEOUT_EMPTY_CONTENT)} ELSE {q(V.SEARCH_EMPTY_CONTENT)} END),
  CASE WHEN {HIT} IS NULL THEN CASE WHEN page_id % 6 = 0 THEN 'Page load timeout' ELSE {q(V.INSUFFICIENT_CONTENT_ERROR)} END END,
  CASE WHEN {HIT} IS NULL THEN 'unknown' ELSE 'google_search' END
FROM texts WHERE page_id NOT IN (SELECT page_id FROM good)"""


def prompt(kind: str, body: str) -> str:
    return f"{q(inference.TEMPLATES[kind] + V.PROMPT_HEADERS[kind])} || {body}"


PROMPT = f"""CASE doc_id % 4 WHEN 0 THEN {prompt("webpage", cut(14000, 14000))} WHEN 1 THEN {prompt("pdf", cut(14000, 14000))}
  WHEN 2 THEN {prompt("github", "text")} ELSE {prompt("youtube", cut(25000, 25000))} END"""
ORACLES["build_prompt"] = f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'webpage' WHEN 1 THEN 'pdf' WHEN 2 THEN 'github' ELSE 'youtube' END AS kind,
  md5({PROMPT}) AS prompt_md5 FROM documents"""
ORACLES["summarize_with"] = f"""SELECT doc_id, CASE WHEN length({PROMPT}) % 50 = 0 THEN 'Error generating summary: refused'
  ELSE 'prompt of ' || length({PROMPT}) || ' characters' END AS summary FROM documents"""



def _joined(level: int) -> str:
    """One level of answers from the one before, four at a time."""
    return f"""l{level} AS (
  SELECT doc_id, kind, part // 4 AS part, (n + 3) // 4 AS n, CASE WHEN count(*) = 1 THEN max(answer)
    ELSE 'answer to ' || (length({q(inference.JOIN_TEMPLATE)}) + sum(9 + length(CAST(part + 1 AS VARCHAR)) + length(answer))) || ' characters' END AS answer
  FROM l{level - 1} WHERE n > 1 GROUP BY doc_id, kind, part // 4, n)"""


ORACLES["summarize_tree"] = f"""WITH t AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'webpage' WHEN 1 THEN 'pdf' WHEN 2 THEN 'github' ELSE 'youtube' END AS kind,
    CASE doc_id % 11 WHEN 5 THEN '' WHEN 6 THEN '[Error: no text]' ELSE text END AS text FROM documents),
c AS (SELECT *, greatest(CAST(ceil((length(text) - 100) / 2900.0) AS BIGINT), 1) AS n,
    CASE WHEN coalesce(text, '') = '' THEN CASE WHEN kind = 'youtube' THEN {q(V.NO_TRANSCRIPT_ANSWER)} ELSE {q(V.NO_TEXT_ANSWER)} END
      WHEN text LIKE '[Error:%' THEN text END AS given,
    CASE kind {" ".join(f"WHEN '{k}' THEN {len(inference.TEMPLATES[k].strip() + V.PROMPT_HEADERS[k])}" for k in inference.TEMPLATES)} END AS head FROM t),
l0 AS (SELECT doc_id, kind, part, n, coalesce(given, 'answer to ' || (head + length(substr(text, part * 2900 + 1, 3000))
    + CASE WHEN n > 1 THEN length(' (Part ' || (part + 1) || ' of ' || n || ')') ELSE 0 END) || ' characters') AS answer
  FROM (SELECT *, unnest(range(0, n)) AS part FROM c)),
{", ".join(_joined(k) for k in range(1, 7))}
SELECT doc_id, kind, answer AS summary FROM ({" UNION ALL ".join(f"SELECT doc_id, kind, n, answer FROM l{k}" for k in range(7))}) WHERE n = 1"""

ORACLES["post_fields"] = """SELECT conv_id * 1000 + turn AS page_id, role || ' & Co ' || conv_id AS user_name, role || conv_id AS user_handle,
  'Turn ' || turn || ' of ' || conv_id || ' <all> second ' || turn AS text,
  'https://full.example.com/' || conv_id || '?a=1&b=2 https://e.example.com' AS urls,
  CASE WHEN turn % 2 = 0 THEN '2024-03-0' || (turn % 8 + 1) || 'T10:00:00.000Z' ELSE '' END AS created_at,
  CASE WHEN turn % 2 = 0 THEN CAST(epoch(TIMESTAMP '2024-03-01 10:00:00') AS BIGINT) + turn % 8 * 86400 END AS "timestamp" FROM conversations"""

# --- media and threads --------------------------------------------------------------------------------
TIMELINE = """lines AS (
  SELECT conv_id * 1000 + turn AS f, role, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations),
timeline AS (
  SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS focal_tweet_id, 0 AS entry_pos, 'tweet-' || (conv_id * 1000 + turn) AS entry_id,
    CAST(conv_id * 1000 + turn AS VARCHAR) AS tweet_id, role AS author_id FROM conversations
  UNION ALL
  SELECT CAST(f AS VARCHAR), 1, 'conversationthread-1', f || '.' || i, CASE WHEN i % 2 = 0 THEN role ELSE 'other' END FROM lines)"""
ORACLES["read_timeline"] = f"WITH {TIMELINE} SELECT * FROM timeline"
ORACLES["thread_count_json"] = f"""WITH {TIMELINE}
SELECT t.focal_tweet_id, count(DISTINCT t.tweet_id) AS n_tweets FROM timeline t
JOIN timeline f ON t.focal_tweet_id = f.focal_tweet_id AND f.entry_pos = 0 AND t.author_id = f.author_id GROUP BY ALL"""
ORACLES["thread_count"] = """SELECT c.conv_id || '-0' AS focal_tweet_id, count(DISTINCT CASE WHEN c.role = f.role THEN c.turn END) AS n_tweets
FROM conversations c LEFT JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0 GROUP BY c.conv_id"""

BEST = "CASE WHEN p_size % 7 >= p_size % 5 THEN '/low.mp4' ELSE '/high.MP4' END"
ORACLES["tweet_media"] = f"""WITH p AS (SELECT * FROM part WHERE p_size % 10 <> 0)
SELECT CAST(p_partkey AS VARCHAR) AS tweet_id, 'photo' AS type, 0 AS index, 'https://i.example.com/' || p_partkey || '.png' AS url, 'png' AS extension FROM p
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'video', 1, 'https://v.example.com/' || p_partkey || {BEST}, 'mp4' FROM p
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'animated_gif', 2, 'https://v.example.com/' || p_partkey || '.m3u8', 'mp4' FROM p"""

ORACLES["best_variant"] = """SELECT l_orderkey, bitrate, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, CAST(l_quantity AS INT) AS bitrate, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS INT) DESC,
    l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS rn FROM lineitem WHERE l_returnflag = 'A') WHERE rn = 1"""

ORACLES["media_type_counts"] = "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY ALL"

ORACLES["best_stream"] = """WITH s AS (
  SELECT *, CAST(floor(l_quantity / 10) * 144 AS INT) AS resolution, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus = 'F' DESC,
    floor(l_quantity / 10) DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey AS video_id, l_linenumber, l_partkey, CAST(l_linestatus = 'F' AS INT) AS progressive, resolution, NULL AS error FROM s WHERE rn = 1
UNION ALL SELECT DISTINCT l_orderkey, NULL, NULL, NULL, NULL, 'no downloadable stream' FROM lineitem
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM s)"""

ORACLES["assemble_tweet"] = """WITH media AS (
  SELECT l_orderkey AS o, count(*) AS n, string_agg('https://i.example.com/' || l_partkey || '.jpg', ' '
    ORDER BY l_linenumber, 'https://i.example.com/' || l_partkey || '.jpg') AS urls FROM lineitem GROUP BY ALL),
stored AS (
  SELECT l_orderkey AS o, l_linenumber AS i, CASE l_linestatus WHEN 'O' THEN 'Photo' ELSE 'Video' END AS t,
    'https://b.s3.amazonaws.com/week_01/' || l_partkey || '.jpg' AS s3 FROM lineitem WHERE l_returnflag = 'A'),
types AS (
  SELECT o, string_agg('- ' || t || ': ' || n, chr(10) ORDER BY first_seen, t) AS lines, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT o, t, count(*) AS n, min(i) AS first_seen FROM stored GROUP BY ALL) GROUP BY o),
places AS (SELECT o, string_agg('- ' || s3, chr(10) ORDER BY i, s3) AS lines FROM stored GROUP BY o)
SELECT CAST(o_orderkey AS VARCHAR) AS tweet_id, 0 AS part,
  'User: @user' || o_custkey || ' (name ' || o_custkey || ')  ' || chr(10) || 'Tweet ID: ' || o_orderkey || '  ' || chr(10)
  || 'Posted on: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' UTC  ' || chr(10) || chr(10) || '---' || chr(10) || 'Order of ' || o_orderpriority
  || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'URLs in tweet:' || chr(10) || ' - /user' || o_custkey || chr(10) || ' - https://e.example.com' ELSE '' END
  || CASE WHEN media.n > 0 THEN chr(10) || chr(10) || 'Media: ' || media.n || ' items detected' ELSE '' END || chr(10) || chr(10)
  || CASE WHEN media.n IS NULL THEN '[Note: No media files found to process]'
    WHEN types.n IS NULL THEN '[Note: Media download/upload was attempted but no files were successfully processed]'
    ELSE 'Uploaded to S3 ' || types.n || ' media files:' || chr(10) || types.lines || chr(10) || chr(10) || 'S3 Locations:' || chr(10) || places.lines END AS content,
  CASE WHEN o_orderstatus = 'P' THEN 'API data fetch failed' END AS error, coalesce(media.urls, '') AS media_urls,
  coalesce(media.n, 0) AS n_media, coalesce(types.n, 0) AS n_files
FROM orders LEFT JOIN media ON o_orderkey = media.o LEFT JOIN types ON o_orderkey = types.o LEFT JOIN places ON o_orderkey = places.o"""

# --- videos ---------------------------------------------------------------------------------------------
ORACLES["video_projection"] = """SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_name AS title, '' AS description, p_brand AS channel_id,
  p_type || ',' || p_brand AS tags, CAST(CASE WHEN p_size % 4 <> 0 THEN p_size END AS BIGINT) AS view_count, CAST(NULL AS BIGINT) AS like_count,
  'PT' || p_size || 'M' AS duration, CAST(p_size % 2 = 0 AS INT) AS caption,
  'YouTube Video: "' || p_name || '"' || chr(10) || 'Channel: N/A' || chr(10) || 'Views: '
  || CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS VARCHAR) ELSE 'N/A' END || ', Likes: N/A' || chr(10) || 'Published: ' || chr(10)
  || 'Description Snippet: ' AS block FROM part"""
ORACLES["playlist_items"] = """SELECT p_brand AS playlist_id, CASE WHEN p_size % 9 <> 0 THEN p_name ELSE 'N/A' END AS title,
  CAST(p_partkey AS VARCHAR) AS video_id, p_size + 1 AS position FROM part WHERE p_partkey % 5 <> 0"""
ORACLES["comment_projection"] = """SELECT CAST(user_id AS VARCHAR) AS video_id, CAST(event_id AS INT) AS position,
  CASE WHEN event_id % 3 <> 0 THEN 'user ' || user_id END AS author, event_type AS text,
  CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS like_count, 'c' || user_id AS author_channel_id FROM events"""
ORACLES["channel_projection"] = """SELECT CAST(c_custkey AS VARCHAR) AS channel_id, c_name AS title, '' AS description,
  CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS country, c_custkey AS subscriber_count, CAST(NULL AS BIGINT) AS view_count,
  c_mktsegment AS keywords FROM customer"""
ORACLES["language_projection"] = """SELECT source AS video_id, lang AS language_code, upper(lang) AS language_name,
  CAST(n_chars % 3 = 1 AS INT) AS auto, count(*) AS n FROM documents GROUP BY ALL"""
ORACLES["preview_n"] = """SELECT * FROM (SELECT p_brand AS playlist_id, p_name AS title, p_partkey AS position,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS number FROM part) WHERE number <= 60"""
ORACLES["playlist_block"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
shown AS (
  SELECT p_brand, count(*) AS n, string_agg(p_partkey || '. [' || p_name || '](https://www.youtube.com/watch?v=' || p_partkey || ')  ', chr(10) ORDER BY rn) AS lines
  FROM r WHERE rn <= 10 GROUP BY p_brand),
lists AS (SELECT p_brand, count(*) AS n, min(p_name) AS title, max(p_type) AS channel, min(p_type) AS about FROM part GROUP BY p_brand)
SELECT p_brand AS playlist_id, 'Playlist: ' || title || '  ' || chr(10) || '---' || chr(10) || 'Channel: ' || channel || '  ' || chr(10)
  || 'Total Videos: ' || l.n || '  ' || chr(10) || 'Published: 2024-01-01  ' || chr(10) || '   ' || chr(10) || '---' || chr(10)
  || 'Description:' || chr(10) || about || chr(10) || '---' || chr(10)
  || 'Videos in playlist (showing first ' || s.n || ' of ' || l.n || '):' || chr(10) || chr(10) || lines || chr(10) || '---' AS content
FROM lists l JOIN shown s USING (p_brand)"""
ORACLES["top_comments"] = """WITH r AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number,
    repeat(event_type || ' ', CAST(floor(value) AS INT) % 30 + 1) AS text FROM events)
SELECT user_id AS video_id, CAST(number AS INT) AS number, event_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS text
FROM r WHERE number <= 5"""
ORACLES["languages_by_name"] = """WITH l AS (
  SELECT DISTINCT source, lang, n_chars % 2 = 0 AS auto,
    CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Spanish' END AS name FROM documents)
SELECT source AS video_id, string_agg(name || '/' || lang || '/' || CAST(auto AS INT), ',' ORDER BY name, lang, auto) AS languages FROM l GROUP BY source"""
ORACLES["language_available"] = """WITH known AS (SELECT DISTINCT source, lang FROM documents),
codes AS (SELECT source, string_agg(lang, ',' ORDER BY lang) AS codes FROM known GROUP BY source),
r AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' ELSE 'it' END AS language FROM documents)
SELECT doc_id, r.source AS video_id, language, CAST(k.lang IS NOT NULL AS INT) AS available,
  CASE WHEN k.lang IS NULL THEN 'language_unavailable' END AS error, CASE WHEN k.lang IS NULL THEN codes END AS alternatives
FROM r LEFT JOIN known k ON r.source = k.source AND language = k.lang JOIN codes c ON r.source = c.source"""
ORACLES["transcript_text"] = """SELECT CAST(conv_id AS VARCHAR) AS video_id, 0 AS part, string_agg(text, chr(10) ORDER BY turn) AS text,
  CAST(length(string_agg(text, chr(10) ORDER BY turn)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id"""
ORACLES["assemble_video"] = """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS rn,
    repeat(l_returnflag, CAST(l_quantity AS INT) * 3) AS text FROM lineitem),
top AS (
  SELECT l_orderkey, count(*) AS n, string_agg(rn || '. supplier ' || l_suppkey || ': ' ||
    CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END, chr(10) ORDER BY rn) AS lines FROM r WHERE rn <= 5 GROUP BY ALL),
script AS (SELECT user_id, CAST(length(string_agg(event_type, chr(10))) AS BIGINT) AS n FROM events GROUP BY user_id)
SELECT CAST(o_orderkey AS VARCHAR) AS video_id, 'Views: ' || CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) ELSE 'N/A' END || '  ' || chr(10)
  || 'Likes: ' || o_orderkey % 10 || '  ' || chr(10) || 'Duration: ' || o_orderpriority || '  ' || chr(10)
  || 'Has captions: ' || CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END || '  ' || chr(10) || '   ' || chr(10) || '---' || chr(10)
  || CASE WHEN c_custkey IS NULL THEN '' ELSE 'Channel Details:  ' || chr(10) || 'Name: ' || c_name || '  ' || chr(10) || 'Subscribers: ' || c_custkey || '  ' || chr(10)
    || 'Total Views: N/A  ' || chr(10) || 'Total Videos: ' || c_nationkey || '  ' || chr(10) || '  ' || chr(10) || '---' || chr(10) END
  || CASE WHEN script.n IS NULL THEN 'Transcript: Not available' ELSE 'Full transcript length: ' || script.n || ' characters  ' || chr(10) || '  ' END
  || CASE WHEN top.n IS NULL THEN '' ELSE chr(10) || 'Top 5 Comments:' || chr(10) || top.lines || chr(10) || '--' END AS content,
  coalesce(script.n, 0) AS transcript_chars, CAST(coalesce(top.n, 0) AS INT) AS n_comments
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN top ON o_orderkey = top.l_orderkey LEFT JOIN script ON o_orderkey = user_id"""

ORACLES["video_details"] = """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS rn
  FROM lineitem),
top AS (
  SELECT l_orderkey, string_agg(rn || '. ' || CASE WHEN l_returnflag <> 'R' THEN 'supplier ' || l_suppkey ELSE 'Anonymous' END || ': ' || l_linestatus,
    chr(10) ORDER BY rn) AS lines FROM r WHERE rn <= 5 GROUP BY ALL)
SELECT CAST(o_orderkey AS VARCHAR) AS video_id, concat_ws(chr(10), 'Video Details:', 'Title: ' || o_orderpriority, 'Channel: N/A', 'Views: ' || o_custkey,
  'Likes: N/A', 'Duration: ' || o_orderstatus, 'Has captions: ' || CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END, repeat('-', 80),
  'Top 5 Comments:' || chr(10) || lines || chr(10) || repeat('-', 80),
  CASE WHEN c_custkey IS NOT NULL THEN 'Channel Details:' || chr(10) || 'Name: ' || c_name || chr(10) || 'Subscribers: ' || c_custkey || chr(10)
    || 'Total Views: N/A' || chr(10) || 'Total Videos: ' || c_nationkey END) AS content
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN top ON o_orderkey = l_orderkey"""

# --- artifacts ---------------------------------------------------------------------------------------------
ORACLES["artifact_names"] = r"""WITH p AS (
  SELECT *, 'h' || p_size || '.example.com' AS h, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) AS b FROM part)
SELECT p_partkey,
  trim(regexp_replace(regexp_replace(lower(p_name || '  ' || p_type || '--' || p_brand || '.v' || p_size), '[^a-z0-9_]', '_', 'g'), '_{2,}', '_', 'g'), '_') || '.txt' AS file,
  replace(p_name, ' ', '_') || '_' || p_brand || '_' || p_type AS title,
  h || '_' || replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '_pdf' ELSE '' END || '_20240506_070809.md' AS page,
  h || '_20240506_070809_' || CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) || '.pdf' ELSE 'document.pdf' END AS pdf,
  'github_' || replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '.pdf' ELSE '' END || '_20240506_070809.md' AS repo,
  '1714979289_tweet_' || b || '_' || p_partkey || '_asset_' || (p_size + 1) || '.jpg' AS media,
  upper(p_type[1]) || lower(p_type[2:]) || '_' || lower(p_name) AS word,
  regexp_replace(p_name || p_type || p_brand || p_size, '[^0-9]', '', 'g') AS digits FROM p"""
ORACLES["repo_fields"] = """WITH p AS (
  SELECT *, CASE WHEN p_size % 2 = 0 THEN p_type || ' & more' ELSE '' END AS about, p_size || 'k' AS s,
    CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE '0' END AS f FROM part)
SELECT p_partkey AS page_id, p_name AS title, about AS description, s AS stars, f AS forks, '0' AS watching, p_brand AS languages,
  'About ' || p_name AS readme, 'Unknown' AS commit_count,
  md5('Title: ' || p_name || '  ' || chr(10) || '    ' || chr(10) || 'S  ' || chr(10) || chr(10) || 'Technologies: ' || p_brand || '  ' || chr(10)
    || 'Forks: ' || f || '  ' || chr(10) || 'Stars: ' || s || '  ' || chr(10) || 'Commit Activity: Unknown commits, last commit on ') AS block_md5,
  md5('Title: ' || p_name || '  Description: ' || about || chr(10) || chr(10) || 'Statistics:' || chr(10) || '- Stars: ' || s || chr(10)
    || '- Forks: ' || f || chr(10) || '- Watchers: 0' || chr(10) || 'Last Commit:  ()' || chr(10) || 'Languages: ' || p_brand || chr(10) || chr(10)
    || 'README Content:' || chr(10) || 'About ' || p_name) AS input_md5 FROM p"""
ORACLES["media_lines"] = """WITH p AS (
  SELECT *, 'https://h.example.com/' || p_partkey || CASE p_size % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.JPG' WHEN 2 THEN '.mp3' ELSE '.bin' END AS url,
    CASE p_size % 4 WHEN 0 THEN 'Video' WHEN 1 THEN 'Photo' WHEN 2 THEN 'Audio' ELSE 'Media' END AS word,
    CASE WHEN p_size % 5 = 0 THEN '/data/' || p_partkey || '.md' END AS path FROM part)
SELECT p_partkey, 'Top' || chr(10) || '- [' || word || '](' || url || ')' || chr(10) || CASE WHEN p_size % 3 = 0
    THEN 'URLs in tweet:' || chr(10) || ' - [user' || p_partkey || '](https://x.com/user' || p_partkey || ')' || chr(10) || ' - https://e.example.com'
    ELSE ' - /user' END AS text,
  concat_ws(chr(10), CASE WHEN p_size % 4 = 0 THEN '- [Video: 1](' || url || ')' END, '- [Markdown](' || path || ')',
    CASE p_size % 4 WHEN 1 THEN '- [Image](' || url || ')' WHEN 2 THEN '- [Audio](' || url || ')' WHEN 3 THEN '- [Media](' || url || ')' END) AS links,
  p_name || coalesce(chr(10) || chr(10) || '[Markdown version saved to: ' || path || ']', '') AS note, word FROM p"""
ORACLES["numbered_media"] = """SELECT p_partkey, 'Post ' || p_partkey || chr(10) || chr(10) || 'Media: ' || p_size || ' items detected' || chr(10) || chr(10)
  || list_reduce(list_transform(range(1, 2 + p_size % 3), lambda i: '- [' || CASE p_size % 4 WHEN 1 THEN 'Photo' WHEN 3 THEN 'Media' ELSE 'Video' END
    || ': ' || i || '](https://s.example.com/' || p_partkey || '/' || i || '.mp4)' || chr(10)), lambda a, b: a || b)
  || chr(10) || chr(10) || 'URLs in tweet:' || chr(10) || ' - https://e.example.com' AS text FROM part"""
ORACLES["video_names_and_playlists"] = """SELECT p_partkey AS id,
  p_size || '_' || replace(replace(replace(p_name || '  ' || p_type, ' ', '_'), ',', ''), '__', '_') || '.mp4' AS value FROM part
UNION ALL SELECT s_suppkey, concat_ws(chr(10), 'YouTube Playlist: "' || s_name || '"',
  'Channel: ' || CASE WHEN s_suppkey % 3 > 0 THEN 'Channel ' || s_nationkey ELSE 'N/A' END, 'Total Videos: ' || s_nationkey, 'Published: 2024-01-02',
  'Description Snippet: About', 'Video Preview:', '- "V1"', '- "V2"', '- "V3"', '- "V4"', '- "V5"') FROM supplier"""
ORACLES["tweet_reports"] = """SELECT o_orderkey, concat_ws(chr(10), 'TWEET DOWNLOAD REPORT', repeat('=', 56), 'User: @u' || o_custkey || ' (' || o_orderstatus || ')',
  'Tweet ID: ' || o_orderkey, 'Posted on: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' UTC', repeat('-', 80), 'CONTENT: ', o_orderpriority, repeat('-', 80),
  CASE WHEN o_orderkey % 2 = 0 THEN 'URLs in tweet:' || chr(10) || '  - https://e.example.com' || chr(10) || repeat('-', 80) END) AS block FROM orders"""
ORACLES["time_columns"] = """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS display,
  strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS parsed FROM events"""
ORACLES["reference_records"] = """SELECT CAST(p_partkey AS VARCHAR) AS video_id, '1700000000_' || replace(p_name, ' ', '_') || '_reference.json' AS filename,
  CAST(p_partkey AS VARCHAR) AS youtube_video_id, p_name AS title, 'https://www.youtube.com/watch?v=' || p_partkey AS url,
  '1700000000' AS processed_at, 'youtube_video' AS reference_type, 'https://www.youtube.com/embed/' || p_partkey AS direct_embed_url FROM part"""
ORACLES["transcript_parts"] = """WITH n AS (
  SELECT CAST(user_id AS VARCHAR) AS video_id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
p AS (SELECT video_id, CAST(i // 10 AS INT) AS part, string_agg(text, chr(10) ORDER BY i) AS text FROM n GROUP BY video_id, i // 10),
w AS (SELECT video_id, sum(length(text)) + count(*) - 1 AS n_chars FROM n GROUP BY video_id)
SELECT video_id, part, text, CAST(n_chars AS BIGINT) AS n_chars FROM p JOIN w USING (video_id)"""
ORACLES["transcript_docs"] = """SELECT CAST(conv_id AS VARCHAR) AS video_id, 0 AS part, '1700000000_youtube_Talk_' || conv_id || '_part_one.txt' AS filename,
  'Talk ' || conv_id || ': part, one' AS title, 'https://www.youtube.com/watch?v=' || conv_id AS url, 'en' AS language,
  md5(string_agg(text, chr(10) ORDER BY turn)) AS body_md5 FROM conversations GROUP BY conv_id HAVING min(turn) = 0"""
ORACLES["page_markdown_docs"] = rf"""WITH p AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS taken, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h,
    trim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^a-zA-Z0-9_]', '_', 'g'), '_') AS slug,
    {MARKDOWN_OF} AS md, {inner("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages)
SELECT page_id, replace(h, 'www.', '') || '_' || CASE WHEN slug = '' THEN 'index' ELSE slug END || '_' || strftime(taken, '%Y%m%d_%H%M%S') || '.md' AS filename,
  '# ' || CASE WHEN title = '' THEN 'Untitled Webpage' ELSE title END || chr(10) || chr(10) || 'Source: [' || url || '](' || url || ')' || chr(10) || chr(10)
  || 'Captured on: ' || strftime(taken, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || md AS content FROM p"""
ORACLES["week_partition"] = """SELECT CAST(isoyear(ts) AS INT) AS iso_year, CAST(weekofyear(ts) AS INT) AS iso_week,
  'week_' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS folder, count(*) AS n FROM events GROUP BY ALL"""
MANIFEST = f"""{CAPTURES},
manifest AS (
  SELECT id, content, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) || '.md' AS filename, isoyear(created_at) AS y, weekofyear(created_at) AS w,
    'week_' || lpad(CAST(weekofyear(created_at) AS VARCHAR), 2, '0') AS folder FROM captures JOIN pages ON id = page_id)"""
ORACLES["artifact_collisions"] = f"""WITH {MANIFEST},
keyed AS (SELECT id, y || '/' || folder || '/' || filename AS key, count(*) OVER (PARTITION BY y, folder, filename) AS n FROM manifest)
SELECT id, key, 'https://notes.s3.amazonaws.com/' || key AS s3_url, n AS n_same_key FROM keyed WHERE n > 1"""
ORACLES["write_artifacts"] = f"""WITH {MANIFEST}
SELECT id, filename, folder, CAST(y AS INT) AS iso_year, CAST(w AS INT) AS iso_week, content FROM manifest"""
ORACLES["write_objects"] = f"""WITH {MANIFEST},
keyed AS (SELECT *, y || '/' || folder || '/' || filename AS k, substr(sha256(content), 1, 16) AS digest,
  count(*) OVER (PARTITION BY y, folder, filename) AS n FROM manifest)
SELECT CASE WHEN n > 1 THEN regexp_replace(k, '\\.md$', '~' || digest || '.md') ELSE k END AS key, filename, CAST(n > 1 AS INT) AS shared, content FROM keyed"""
ORACLES["stable_numbers"] = """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events"""

ORACLES["range_numbers"] = """SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber) AS number FROM lineitem"""

# --- logs ------------------------------------------------------------------------------------------------------
LOGS = f"""log AS (SELECT event_id, ts, {D.LOGGER} AS logger, {D.LOG_LEVEL} AS level, {D.LOG_MESSAGE} AS message FROM events)"""
WARN = "level IN ('WARNING', 'ERROR', 'CRITICAL')"
APP_NOISE = f"""({any_of("message", V.TEX_PHRASES)}
  OR ({WARN} AND ({any_of("lower(message)", V.EDITOR_PHRASES)} OR starts_with(message, '[vs/') OR (contains(message, ']') AND contains(message, 'vs/'))
    OR (contains(message, 'at Object.') AND contains(message, 'js:'))))
  OR (contains(message, 'HTTP Request:') AND {any_of("message", V.HTTP_OK)})
  OR ({any_of("message", V.API_POLL_PHRASES)} AND contains(message, 'HTTP/1.1 200')))"""
TOO_LOW = """CASE WHEN logger = 'playwright.browser.console' THEN level <> 'ERROR' WHEN logger IN ('playwright', 'urllib3.pool') THEN level = 'INFO' ELSE FALSE END"""
ORACLES["log_noise_filter"] = f"WITH {LOGS} SELECT * FROM log WHERE NOT {APP_NOISE} AND NOT {TOO_LOW}"
ORACLES["log_noise_scraper"] = f"""WITH {LOGS} SELECT event_id, message FROM log WHERE NOT CASE WHEN contains(message, 'HTTP Request:')
  THEN NOT {any_of("message", V.HTTP_ERRORS)}
  ELSE (level = 'WARNING' AND {any_of("lower(message)", V.SCRAPER_EDITOR_PHRASES)})
    OR ({any_of("message", V.API_POLL_PHRASES)} AND contains(message, 'HTTP/1.1 200')) END"""
ORACLES["console_filter"] = f"""SELECT event_id, event_type AS type, message FROM (SELECT event_id, event_type, {D.LOG_MESSAGE} AS message FROM events)
WHERE event_type = 'error' AND message <> '' AND NOT {any_of("lower(message)", V.CONSOLE_ALWAYS_IGNORED + V.CONSOLE_ERROR_IGNORED + V.BROWSER_ERROR_IGNORED)}"""
ORACLES["apply_rules"] = """WITH rules AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS phrase FROM part)
SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM rules WHERE phrase <> '' AND contains(d.text, phrase))"""
ORACLES["apply_many_rules"] = """WITH rules AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS phrase FROM benchmark)
SELECT page_id, url FROM pages p WHERE EXISTS (SELECT 1 FROM rules WHERE phrase <> '' AND contains(p.url, phrase))"""

# --- streams ---------------------------------------------------------------------------------------------------
ORACLES["stream_capture"] = f"""WITH RECURSIVE {BASE},
work AS (SELECT * FROM attempt_rows WHERE task_id % 10 <> 0 AND NOT (task_id % 70 = 6 AND task_id % 50 <> 7)),
{walk("work")},
tried AS (SELECT w.* FROM work w JOIN acted a ON w.task_id = a.task_id AND w.pos = a.pos WHERE a.action = 'try'),
last_rows AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, task_id DESC, pos DESC) AS rn FROM tried)
SELECT coalesce(u.url, l.url) AS url, coalesce(u.task_id, l.task_id) AS task_id, CAST(coalesce(u.success, l.success) AS INT) AS success
FROM ledger l FULL OUTER JOIN (SELECT * FROM last_rows WHERE rn = 1) u ON l.url = u.url"""
ORACLES["stream_url_state"] = """SELECT 'https://e.example.com/' || user_id AS url, arg_min(event_id, (ts, event_id)) AS event_id
FROM events WHERE event_type = 'purchase' GROUP BY user_id"""
ORACLES["stream_recent_dedup"] = "SELECT DISTINCT 'https://e.example.com/' || user_id || '/' || event_type AS url FROM events"
ORACLES["stream_outcomes"] = """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS total,
  count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL"""
ORACLES["stream_log_filter"] = ORACLES["log_noise_filter"]
