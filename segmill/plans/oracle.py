"""The registered queries as SQL for DuckDB."""

from __future__ import annotations

from segmill.parameters import DEFAULT, Parameters
from segmill.plans.fixtures import AUDIO_SQL, CONVERSATION_SQL, DOC_SEGMENTS_SQL, ENTRIES_SQL, EVENT_PARAMETERS, EVENT_SEGMENTS_SQL, LOG_SQL, SUBMISSIONS_SQL


#: White space of any kind in the regular expressions of DuckDB.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _any(phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in phrases) + ")"


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _expanded(p: Parameters) -> str:
    return f"""
judged AS (
  SELECT *, is_ad OR {_any(p.promotions)} OR coalesce(lead(is_ad) OVER w AND lead(start_s) OVER w - end_s <= {p.bridge_gap}, false) AS belongs,
         {_any(p.transitions)} AND NOT is_ad AS starts, max(CAST(is_ad AS INT)) OVER (PARTITION BY tid) AS any_ad
  FROM segments WINDOW w AS (PARTITION BY tid ORDER BY pos)),
runs AS (SELECT *, sum(CASE WHEN belongs THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY pos) AS run FROM judged),
expanded AS (
  SELECT tid, id, pos, text, start_s, end_s,
         is_ad OR (any_ad = 1 AND max(CAST(starts AS INT)) OVER (PARTITION BY tid, run ORDER BY pos) = 1) AS is_ad FROM runs)"""


def _blocks(p: Parameters) -> str:
    return f"""
marked AS (
  SELECT *, is_ad AND NOT coalesce(lag(is_ad) OVER w AND start_s - lag(end_s) OVER w <= {p.block_gap}, false) AS new
  FROM expanded WINDOW w AS (PARTITION BY tid ORDER BY pos)),
numbered AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY tid ORDER BY pos) AS BIGINT) AS block FROM marked)"""


def _merged(p: Parameters) -> str:
    return f"""
seen AS (
  SELECT tid, start_s, end_s, max(end_s) OVER (PARTITION BY tid ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM expanded WHERE is_ad AND end_s >= start_s),
islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_s > reach + {p.max_gap} THEN 1 ELSE 0 END) OVER (
      PARTITION BY tid ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM seen),
unions AS (
  SELECT tid, min(start_s) AS start_s, max(end_s) AS end_s FROM islands GROUP BY tid, island HAVING max(end_s) - min(start_s) >= {p.min_duration})"""


KEPT_SQL = """
cuts AS (
  SELECT a.tid, a.len_ms, CAST(trunc(u.start_s * 1000) AS BIGINT) AS a_ms, CAST(trunc(u.end_s * 1000) AS BIGINT) AS b_ms
  FROM audio a LEFT JOIN unions u ON a.tid = u.tid),
edged AS (
  SELECT *, lag(b_ms, 1, 0) OVER (PARTITION BY tid ORDER BY a_ms, b_ms) AS from_ms, lead(a_ms) OVER (PARTITION BY tid ORDER BY a_ms, b_ms) IS NULL AS is_last
  FROM cuts),
spans AS (
  SELECT tid, len_ms, from_ms, a_ms AS to_ms FROM edged WHERE from_ms < a_ms
  UNION ALL SELECT tid, len_ms, b_ms, len_ms FROM edged WHERE is_last AND b_ms < len_ms
  UNION ALL SELECT tid, len_ms, 0, len_ms FROM edged WHERE a_ms IS NULL)"""

DOC, DOC_AUDIO = (DOC_SEGMENTS_SQL, _expanded(DEFAULT)), (DOC_SEGMENTS_SQL, AUDIO_SQL, _expanded(DEFAULT), _merged(DEFAULT), KEPT_SQL)
EVENT, EVENT_AUDIO = (EVENT_SEGMENTS_SQL, _expanded(EVENT_PARAMETERS)), (EVENT_SEGMENTS_SQL, AUDIO_SQL, _expanded(EVENT_PARAMETERS), _merged(EVENT_PARAMETERS), KEPT_SQL)

BLOCK_SELECT = """
SELECT tid, block, arg_min(id, pos) AS first_id, arg_max(id, pos) AS last_id, arg_min(start_s, pos) AS start_s, arg_max(end_s, pos) AS end_s,
       count(*) AS n_segments, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids, round(arg_max(end_s, pos) - arg_min(start_s, pos), 6) AS duration_s
FROM numbered WHERE is_ad GROUP BY tid, block"""

UPDATES_SQL = """
updates AS (
  SELECT seq, correlation_id, regexp_extract(topic, '^podcast\\.([a-z_]+)\\.[a-z]+$', 1) AS step,
         CASE WHEN topic LIKE '%.failed' THEN 'failed' WHEN file_path IS NULL THEN NULL
              WHEN topic = 'podcast.audio_processing.complete' THEN 'completed' ELSE 'processing' END AS status FROM log),
valid AS (SELECT *, CASE WHEN status = 'failed' THEN 'failed' ELSE 'completed' END AS step_status FROM updates WHERE status IS NOT NULL)"""

CURRENT_SQL = """
opened AS (SELECT correlation_id, max(seq) AS since FROM submissions GROUP BY correlation_id),
requests AS (SELECT s.* FROM submissions s JOIN opened o ON o.correlation_id = s.correlation_id AND o.since = s.seq),
current AS (SELECT v.* FROM valid v JOIN opened o ON o.correlation_id = v.correlation_id AND v.seq >= o.since)"""

CLAIMS_SQL = """
claims AS (
  SELECT seq, file_path AS key, CASE WHEN topic = 'podcast.audio_processing.complete' THEN 'done'
         WHEN topic = 'podcast.download.failed' THEN 'failed' ELSE 'request' END AS event FROM log WHERE file_path IS NOT NULL)"""

SQL = {
    "segments_from_model": _with(DOC_SEGMENTS_SQL, select=rf"SELECT tid, pos AS id, pos, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS text, start_s, end_s, false AS is_ad FROM segments"),
    "ad_segments": _with(DOC_SEGMENTS_SQL, select="SELECT * FROM segments WHERE is_ad"),
    "non_ad_segments": _with(DOC_SEGMENTS_SQL, select="SELECT * FROM segments WHERE NOT is_ad"),
    "promo_segments": _with(DOC_SEGMENTS_SQL, select=f"SELECT tid, id FROM segments WHERE {_any(DEFAULT.promotions)}"),
    "transition_segments": _with(DOC_SEGMENTS_SQL, select=f"SELECT tid, id FROM segments WHERE {_any(DEFAULT.transitions)}"),
    "chunks": _with(DOC_SEGMENTS_SQL, select="SELECT tid, id, pos // 6 AS chunk_id FROM segments"),
    "chunk_prompts": _with(DOC_SEGMENTS_SQL, select="SELECT tid, pos // 6 AS chunk_id, string_agg('ID: ' || CAST(id AS VARCHAR) || ' Text: ' || text, chr(10) ORDER BY pos) AS prompt FROM segments GROUP BY tid, pos // 6"),
    "dedup_segments": _with(DOC_SEGMENTS_SQL, select="SELECT tid, id, pos, CASE WHEN (tid + id) % 5 = 0 THEN text || ' v2' ELSE text END AS text, start_s, end_s, is_ad FROM segments"),
    "expand_ad_blocks": _with(*DOC, select="SELECT tid, id, is_ad FROM expanded"),
    "ad_blocks": _with(*DOC, _blocks(DEFAULT), select=BLOCK_SELECT),
    "merged_intervals": _with(*DOC, _merged(DEFAULT), select="SELECT * FROM unions"),
    "merge_counts": _with(*DOC, _merged(DEFAULT), select="""
SELECT b.tid, b.n AS n_before, coalesce(a.n, 0) AS n_after FROM (SELECT tid, count(*) AS n FROM seen GROUP BY tid) b
LEFT JOIN (SELECT tid, count(*) AS n FROM unions GROUP BY tid) a ON a.tid = b.tid"""),
    "kept_spans": _with(*DOC_AUDIO, select="SELECT tid, from_ms, to_ms FROM spans"),
    "segment_report": _with(*DOC, select="SELECT tid, id, start_s, end_s, is_ad, round(end_s - start_s, 6) AS duration_s FROM expanded"),
    "transcript_report": _with(*DOC, _blocks(DEFAULT), select="SELECT tid, count(*) AS n_segments, count_if(is_ad) AS n_ads, count_if(new) AS n_blocks FROM marked GROUP BY tid"),
    "reduction_report": _with(*DOC_AUDIO, _blocks(DEFAULT), select="""
SELECT s.tid, s.n_segments, s.n_ads, s.n_blocks, coalesce(r.removed_ms, 0) AS removed_ms, coalesce(k.kept_ms, 0) AS kept_ms,
       CASE WHEN a.len_ms > 0 THEN round(CAST(a.len_ms - coalesce(k.kept_ms, 0) AS DOUBLE) / CAST(a.len_ms AS DOUBLE) * 100, 6) END AS reduction_percent
FROM (SELECT tid, count(*) AS n_segments, count_if(is_ad) AS n_ads, count_if(new) AS n_blocks FROM marked GROUP BY tid) s
JOIN audio a ON a.tid = s.tid
LEFT JOIN (SELECT tid, round(sum((end_s - start_s) * 1000), 3) AS removed_ms FROM unions GROUP BY tid) r ON r.tid = s.tid
LEFT JOIN (SELECT tid, CAST(sum(least(to_ms, len_ms) - least(from_ms, len_ms)) AS BIGINT) AS kept_ms FROM spans GROUP BY tid) k ON k.tid = s.tid"""),
    "ad_blocks_events": _with(*EVENT, _blocks(EVENT_PARAMETERS), select=BLOCK_SELECT),
    "merged_intervals_events": _with(*EVENT, _merged(EVENT_PARAMETERS), select="SELECT * FROM unions"),
    "kept_spans_events": _with(*EVENT_AUDIO, select="SELECT tid, from_ms, to_ms FROM spans"),
    "merge_classifications": _with(CONVERSATION_SQL, select="SELECT tid, id, coalesce(answer, is_ad) AS is_ad, answer IS NOT NULL AS matched FROM merged"),
    "chunk_stats": _with(CONVERSATION_SQL, select="""
SELECT tid, chunk_id, count(*) AS n_total, count(answer) AS n_updated, count_if(coalesce(answer, false)) AS n_ads FROM merged GROUP BY tid, chunk_id"""),
    "message_envelopes": r"""
SELECT event_id AS seq, 'podcast.' || event_type AS topic, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS correlation_id,
       CASE event_id % 5 WHEN 0 THEN '"plain \"text\" \\ "' WHEN 1 THEN '"5"' WHEN 2 THEN '[1,{"a":null},' || CAST(event_id AS VARCHAR) || ']'
            WHEN 3 THEN '{"file_path":"fi \"' || event_type || '","user":' || CAST(user_id AS VARCHAR) || '}' END AS data,
       CASE WHEN event_id % 5 = 3 THEN 'fi "' || event_type END AS file_path
FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0""",
    "next_requests": _with(LOG_SQL, select="""
SELECT seq, CASE topic WHEN 'podcast.download.complete' THEN 'podcast.transcribe.request' WHEN 'podcast.transcribe.complete' THEN 'podcast.ad_detection.request'
       ELSE 'podcast.audio_processing.request' END AS topic, correlation_id, file_path
FROM log WHERE file_path IS NOT NULL AND topic IN ('podcast.download.complete', 'podcast.transcribe.complete', 'podcast.ad_detection.complete')"""),
    "invalid_requests": _with(LOG_SQL, select="SELECT seq, regexp_replace(topic, '[^.]+$', 'failed') AS topic, correlation_id, 'Missing file_path' AS error FROM log WHERE file_path IS NULL"),
    "request_status": _with(LOG_SQL, UPDATES_SQL, SUBMISSIONS_SQL, CURRENT_SQL, select="""
SELECT r.correlation_id, any_value(r.type) AS type, any_value(r.url) AS url, coalesce(arg_max(c.status, c.seq), 'processing') AS status,
       count(c.seq) + 1 AS n_steps, greatest(any_value(r.seq), coalesce(max(c.seq), -1)) AS last_seq
FROM requests r LEFT JOIN current c ON c.correlation_id = r.correlation_id GROUP BY r.correlation_id"""),
    "request_steps": _with(LOG_SQL, UPDATES_SQL, SUBMISSIONS_SQL, CURRENT_SQL, select="""
SELECT correlation_id, CAST(0 AS BIGINT) AS step_no, 'submitted' AS step, 'completed' AS step_status FROM requests
UNION ALL SELECT correlation_id, row_number() OVER (PARTITION BY correlation_id ORDER BY seq), step, step_status FROM current"""),
    "unknown_updates": _with(LOG_SQL, UPDATES_SQL, SUBMISSIONS_SQL, select="""
SELECT seq, correlation_id, status, step, step_status FROM valid v
WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.correlation_id = v.correlation_id AND s.seq <= v.seq)"""),
    "claim_outcome": _with(LOG_SQL, CLAIMS_SQL, """
folded AS (
  SELECT *, coalesce(max(CAST(event = 'done' AS INT)) OVER w, 0) AS done, coalesce(sum(CAST(event = 'failed' AS INT)) OVER w, 0) AS freed
  FROM claims WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", select="""
SELECT seq, key, CASE WHEN done = 1 THEN 'already_processed' WHEN row_number() OVER (PARTITION BY key, freed ORDER BY seq) > 1 THEN 'in_progress' ELSE 'claimed' END AS outcome
FROM folded WHERE event = 'request'"""),
    "new_work": _with(LOG_SQL, CLAIMS_SQL, select="SELECT seq, key FROM claims WHERE event = 'request' AND key NOT IN (SELECT key FROM claims WHERE event = 'done' AND seq % 29 = 0)"),
    "already_processed": _with(LOG_SQL, CLAIMS_SQL, select="""
SELECT seq, key FROM claims WHERE event = 'request' AND key IN (SELECT key FROM claims WHERE event = 'done' AND seq % 29 = 0)
  AND key IN (SELECT key FROM claims WHERE event = 'request' AND seq % 4 <> 0)"""),
    "feed_requests": "SELECT page_id, coalesce(url IN (SELECT url FROM pages WHERE page_id % 13 = 0 AND url IS NOT NULL), false) AS already_processed FROM pages",
    "serve_decision": """
WITH files AS (
  SELECT url, page_id AS seq, CASE WHEN page_id % 2 = 0 THEN '.mp3' ELSE '.wav' END AS ending FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT url, page_id + 1000000000, CASE WHEN page_id % 2 = 0 THEN '.wav' ELSE '.mp3' END FROM pages WHERE page_id % 15 = 0),
produced AS (SELECT url, 'podcasts/' || md5(url) || arg_max(ending, seq) AS file FROM files GROUP BY url),
objects AS (SELECT DISTINCT 'podcasts/' || md5(url) || '.mp3' AS key FROM pages WHERE page_id % 4 <> 1),
requests AS (SELECT page_id AS request_id, CASE WHEN page_id % 11 <> 0 THEN url END AS url FROM pages)
SELECT r.request_id, CASE WHEN coalesce(r.url, '') = '' THEN 400 WHEN o.key IS NOT NULL THEN 200 ELSE 202 END AS status,
       CASE WHEN o.key IS NOT NULL THEN p.file END AS file
FROM requests r LEFT JOIN produced p ON p.url = r.url LEFT JOIN objects o ON o.key = p.file""",
    "route_requests": """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'process' WHEN 1 THEN 'rss' WHEN 2 THEN 'status' WHEN 3 THEN 'download' WHEN 4 THEN 'process' END AS route,
       CASE WHEN page_id % 6 IN (0, 1) THEN url_decode(regexp_extract(url, '^([^&#]*)', 1)) END AS url_value,
       CASE page_id % 6 WHEN 4 THEN 400 WHEN 5 THEN 404 ELSE 200 END AS status
FROM pages""",
    "feed_episodes": _with(ENTRIES_SQL, select="SELECT page_id, host, title, 'http://localhost:8080/process?url=' || audio_url AS audio_url, audio_url AS original_url FROM entries"),
    "feed_xml": _with(ENTRIES_SQL, """
items AS (
  SELECT *, '<item>' || CASE WHEN title = '' THEN '<title />' ELSE '<title>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title>' END
         || '<description /><enclosure url="' || replace(replace(replace(replace(audio_url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')
         || '" type="audio/mpeg" /></item>' AS item FROM entries),
hosts AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, min(page_id) AS n FROM pages GROUP BY 1)""", select="""
SELECT i.host, '<rss version="2.0"><channel>' || CASE WHEN any_value(h.n) % 7 = 0 OR any_value(h.n) % 3 = 0 THEN '<title>Episodes</title>' WHEN any_value(h.n) % 5 = 0 THEN '<title />' ELSE '<title>Feed &amp; ' || i.host || '</title>' END
       || CASE WHEN any_value(h.n) % 7 <> 0 AND any_value(h.n) % 2 = 0 THEN '<link>https://' || i.host || '</link>' ELSE '<link />' END || '<description>Episodes without advertisements</description>'
       || string_agg(item, '' ORDER BY page_id) || '</channel></rss>' AS xml FROM items i JOIN hosts h ON h.host = i.host GROUP BY i.host"""),
    "feed_cache": "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, arg_max(regexp_extract(html, '<title>([^<]*)</title>', 1), page_id) AS title FROM pages GROUP BY 1",
    "storage_keys": """
SELECT page_id, 'podcasts/original/' || string_split(url, '/')[-1] AS path_key, 'podcasts/' || md5(url) AS url_key,
       regexp_replace(string_split(url, '/')[-1], '^(\\.*[^.].*?|)(\\.[^.]*)?$', '\\1_clean\\2') AS clean_name FROM pages""",
    "existing_objects": """
SELECT page_id, 'podcasts/' || md5(url) || '.mp3' AS key FROM pages
WHERE md5(url) IN (SELECT md5(url) FROM pages WHERE page_id % 4 <> 1)""",
    "content_type": "SELECT page_id, CASE WHEN page_id % 3 = 0 OR page_id % 3 = 2 AND url LIKE '%.mp3' THEN 'audio/mpeg' WHEN page_id % 3 = 1 OR url LIKE '%.wav' THEN 'audio/wav' ELSE 'application/octet-stream' END AS content_type FROM pages",
}
