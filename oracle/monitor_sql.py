"""SQL for the monitoring queries."""

from __future__ import annotations

from memlake.functions import lexicon as lx
from memlake.sources.logs import ERRORS
from oracle.base import NOW, any_term, d, define, hours, in_list, q, r6, trim, with_ctes

SQL: dict[str, str] = {}


def _v(x):
    return "NULL" if x is None else q(x) if isinstance(x, str) else str(x)


def _case(i: int) -> str:
    return "CASE WHEN event_type = 'error' THEN CASE event_id % 6 " + " ".join(
        f"WHEN {n} THEN {_v(e[i])}" for n, e in enumerate(ERRORS)) + " END END"


define("att", [], f"""
SELECT event_id // 3 AS job_id, CASE WHEN (event_id // 3) % 4 = 0 THEN 'summarise-session' ELSE 'process-event' END AS job_type,
  's' || ((event_id // 6) % 100) AS session_id, CAST(event_id % 3 + 1 AS INT) AS attempt, 3 AS max_attempts,
  {_case(0)} AS error_name, CAST({_case(1)} AS VARCHAR) AS error_code, {_case(2)} AS error_status, {_case(3)} AS error_message,
  sha256((CASE WHEN (event_id // 3) % 4 = 0 THEN 'summarise-session' ELSE 'process-event' END) || ':s' || ((event_id // 6) % 100)
     || ':' || (event_id // 6) || ':') AS ikey,
  value / 100 AS duration_s, ts FROM events""")
_MSG = "lower(coalesce(error_message, ''))"
define("attc", ["att"], f"""
SELECT *, error_message IS NOT NULL AS failed,
  CASE WHEN error_message IS NULL THEN NULL
    WHEN coalesce(error_code IN {in_list(lx.TRANSIENT_CODES)}, false) OR coalesce(error_status IN {in_list(lx.TRANSIENT_STATUS)}, false)
      OR coalesce(error_name IN {in_list(lx.TRANSIENT_NAMES)}, false) OR {any_term(_MSG, lx.TRANSIENT_SUBSTRINGS)} THEN 'transient'
    WHEN coalesce(error_status IN {in_list(lx.PERMANENT_STATUS)}, false) OR coalesce(error_name IN {in_list(lx.PERMANENT_NAMES)}, false)
      OR {any_term(_MSG, lx.PERMANENT_SUBSTRINGS)} THEN 'permanent' ELSE 'unknown' END AS category FROM att""")
define("atts", ["attc"], "SELECT *, failed AND category <> 'permanent' AND attempt < max_attempts AS will_retry FROM attc")
define("req", [], """
SELECT event_id AS request_id, event_type AS route, 'c' || user_id AS client_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CAST(json_extract_string(props, '$.k') AS INT) >= 60 AS cache_hit, CAST(json_extract_string(props, '$.k') AS INT) % 17 AS result_count,
  value / 100 AS duration_s, ts FROM events""")
_SCORE = ("least(1e0, greatest(0e0, importance * 0.34e0 + confidence * 0.18e0 + signal_strength * 0.16e0 + permanence * 0.12e0 "
          "+ specificity * 0.08e0 + actionability * 0.08e0 + domain_confidence * 0.04e0))")
define("wsets", ["stored", "ev"], f"""
SELECT t.session_id, coalesce(memory_count, 0) AS memory_count, t.turn_count, newest,
  least(1e0, coalesce(top, 0e0) * 0.45e0 + coalesce(mean, 0e0) * 0.25e0
    + (CASE WHEN newest IS NULL THEN 0.25e0 ELSE least(1e0, greatest(0e0, 1e0 - {hours('newest', NOW)} / 24e0)) END) * 0.2e0
    + least(1e0, t.turn_count / 8e0) * 0.1e0) AS relevance
FROM (SELECT session_id, count(*) AS turn_count FROM ev GROUP BY 1) t LEFT JOIN
  (SELECT session_id, count(*) AS memory_count, max({_SCORE}) AS top, avg({_SCORE}) AS mean, max(created_at) AS newest
   FROM stored GROUP BY 1) m USING (session_id)""")
_TTL = "CAST(floor(least(604800e0, greatest(3600e0, 7200e0 + (604800e0 - 7200e0) * relevance)) + 0.5e0) AS BIGINT)"
SQL["r19_working_set_ttl"] = with_ctes("wsets") + f"""
SELECT session_id, memory_count, turn_count, {r6('relevance')} AS relevance, {_TTL} AS ttl_seconds FROM wsets"""
SQL["r19_unexpired"] = with_ctes("wsets") + f"""
SELECT session_id, ttl_seconds FROM (SELECT session_id, newest, {_TTL} AS ttl_seconds FROM wsets)
WHERE (epoch_us({NOW}) - epoch_us(newest)) / 1000000e0 < ttl_seconds"""
SQL["m01_session_overview"] = with_ctes("wsets") + f"""
SELECT session_id, strftime(newest, '%Y-%m-%d %H:%M:%S') AS updated_at, memory_count, turn_count, {_TTL} AS ttl_seconds FROM wsets"""
SQL["m02_sessions_by_recency"] = with_ctes("ev") + f"""
SELECT CASE WHEN u >= {NOW} THEN 'Today' WHEN u >= {NOW} - INTERVAL 1 DAY THEN 'Yesterday'
            WHEN u >= {NOW} - INTERVAL 6 DAY THEN 'Last 7 days' ELSE 'Older' END AS period, count(*) AS sessions
FROM (SELECT session_id, max(created_at) AS u FROM ev GROUP BY 1) GROUP BY 1"""
SQL["m03_job_counters"] = with_ctes("atts") + """
, firsts AS (SELECT ikey, min({'ts': ts, 'job_id': job_id}) AS done FROM atts WHERE NOT failed GROUP BY 1)
, f AS (SELECT a.*, coalesce(a.job_id <> done.job_id AND a.ts > done.ts, false) AS dup, coalesce(category, 'none') AS cat
        FROM atts a LEFT JOIN firsts USING (ikey))
SELECT job_type, cat AS category, count(*) FILTER (NOT dup AND NOT failed) AS processed, count(*) FILTER (NOT dup AND failed) AS failed,
  count(*) FILTER (NOT dup AND will_retry) AS retried, count(*) FILTER (NOT dup AND failed AND NOT will_retry) AS dead_lettered,
  count(*) FILTER (dup) AS duplicates
FROM f GROUP BY GROUPING SETS ((job_type, cat), (job_type))"""


def _bounds(bs) -> str:
    return "(VALUES " + ", ".join(f"({d(b)})" for b in bs) + ", ('Infinity'::DOUBLE)) AS b(le)"


define("hist", ["req"], f"""
SELECT route, le, (SELECT count(*) FROM req r WHERE r.route = t.route AND r.duration_s <= le) AS cumulative, n AS count, s AS sum
FROM (SELECT route, count(*) AS n, sum(duration_s) AS s FROM req GROUP BY 1) t, {_bounds(lx.HTTP_BUCKETS)}""")
SQL["m04_latency_histogram"] = with_ctes("hist") + f"""
SELECT route, CASE WHEN isinf(le) THEN -1e0 ELSE le END AS le, cumulative, count, {r6('sum')} AS sum FROM hist"""
SQL["m05_histogram_quantile"] = with_ctes("hist") + f"""
, h AS (SELECT *, coalesce(lag(cumulative) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0e0) AS lower FROM hist WINDOW w AS (PARTITION BY route ORDER BY le))
, t AS (SELECT h.*, q, count * q AS target FROM h, (VALUES (0.5e0), (0.95e0), (0.99e0)) AS qs(q))
SELECT route, q, {r6('CASE WHEN isinf(le) THEN lower WHEN cumulative = below THEN le ELSE lower + (le - lower) * ((target - below) / (cumulative - below)) END')} AS value
FROM t WHERE cumulative >= target QUALIFY row_number() OVER (PARTITION BY route, q ORDER BY le) = 1"""
SQL["m06_event_rate"] = with_ctes("req") + f"""
, w AS (SELECT route, date_trunc('minute', ts) - to_minutes(i) AS ws FROM req, range(0, 5) AS r(i))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, route, count(*) AS events, {r6('count(*) / 300e0')} AS per_second FROM w GROUP BY ws, route"""
SQL["m06_error_rate"] = with_ctes("req") + f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (status >= 500) AS errors, count(*) AS requests,
  {r6('count(*) FILTER (status >= 500) / 3600e0')} AS errors_per_second, {r6('count(*) FILTER (status >= 500)::DOUBLE / count(*)')} AS error_share FROM req GROUP BY date_trunc('hour', ts)"""
SQL["m07_cache_hit_ratio"] = with_ctes("req") + f"""
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) FILTER (cache_hit) AS hits, count(*) AS requests, {r6('count(*) FILTER (cache_hit)::DOUBLE / count(*)')} AS hit_ratio
FROM req GROUP BY time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')"""
SQL["m08_results_histogram"] = with_ctes("req") + f"""
SELECT cache_hit, CASE WHEN isinf(le) THEN -1e0 ELSE le END AS le,
  (SELECT count(*) FROM req r WHERE r.cache_hit = t.cache_hit AND r.result_count <= le) AS cumulative, n AS count, s AS sum
FROM (SELECT cache_hit, count(*) AS n, CAST(sum(result_count) AS BIGINT) AS s FROM req GROUP BY 1) t, {_bounds(lx.RESULT_COUNT_BUCKETS)}"""
SQL["m09_job_outcomes"] = with_ctes("atts") + f"""
, l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY attempt DESC) AS rn,
    count(*) FILTER (failed) OVER (PARTITION BY job_id) AS failures, sum(duration_s) OVER (PARTITION BY job_id) AS total FROM atts)
SELECT job_id, job_type, CASE WHEN NOT failed THEN 'completed' WHEN will_retry THEN 'retrying' ELSE 'dead_lettered' END AS outcome,
  category, attempt AS attempts, failures, {r6('total')} AS duration_s FROM l WHERE rn = 1"""
_DLQ = """
, l AS (SELECT * FROM atts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt DESC) = 1)
, dlq AS (SELECT * FROM l WHERE failed AND NOT will_retry AND ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)"""
SQL["m10_dead_letters"] = with_ctes("atts") + _DLQ + """
SELECT job_id, attempt, category, error_message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM dlq"""
SQL["m10_requeue"] = with_ctes("atts") + _DLQ + """
SELECT job_id, job_type, session_id, 1 AS attempt, true AS requeued FROM dlq WHERE category <> 'permanent'"""
SQL["m11_summary_batches"] = with_ctes("ev") + """
, w AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY session_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS a,
    list((CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END) || content) OVER (PARTITION BY session_id ORDER BY created_at, event_id
      ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS ls FROM ev)
SELECT session_id, event_id, a AS assistant_turn, len(ls) AS turns, sha256(array_to_string(ls, chr(10))) AS transcript_digest,
  0.72e0 AS importance, 0.85e0 AS confidence FROM w WHERE role = 'assistant' AND a % 2 = 0 AND len(ls) >= 4"""
SQL["x04_rate_violations"] = with_ctes("req").replace("WITH ", "WITH RECURSIVE ", 1) + """
, seq AS (SELECT client_id, ts, row_number() OVER (PARTITION BY client_id ORDER BY ts) AS n FROM req)
, run AS (
  SELECT client_id, n, ts, ts AS start, 1 AS request_count FROM seq WHERE n = 1
  UNION ALL
  SELECT s.client_id, s.n, s.ts, CASE WHEN s.ts >= r.start + INTERVAL 3600 SECOND THEN s.ts ELSE r.start END,
    CASE WHEN s.ts >= r.start + INTERVAL 3600 SECOND THEN 1 ELSE r.request_count + 1 END
  FROM run r JOIN seq s ON s.client_id = r.client_id AND s.n = r.n + 1)
SELECT client_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, request_count FROM run WHERE request_count > 2"""
SQL["x04_stream_rate_violations"] = SQL["x04_rate_violations"]
SQL["m04_stage_histograms"] = with_ctes("req") + " UNION ALL ".join(f"""
SELECT '{stage}' AS stage, route, le, count(*) FILTER (le < 0 OR duration_s <= le) AS cumulative, count(*) AS count
FROM req, (SELECT unnest({[*map(float, buckets), -1.0]})::DOUBLE AS le) GROUP BY route, le"""
    for stage, buckets in (("job", lx.JOB_BUCKETS), ("retrieval", lx.RETRIEVAL_BUCKETS), ("rerank", lx.RERANK_BUCKETS)))
SQL["m10_list_dead_letters"] = with_ctes("atts") + _DLQ + """
SELECT job_id, job_type, attempt, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM dlq ORDER BY dlq.ts DESC, job_id DESC LIMIT 50"""
SQL["m11_summary_memories"] = SQL["m11_summary_batches"].replace("a % 2 = 0", "a % 4 = 0").replace(
    "SELECT session_id, event_id, a AS assistant_turn", ", due AS (SELECT session_id, event_id, a AS assistant_turn", 1).replace(
    "sha256(array_to_string(ls, chr(10))) AS transcript_digest", "array_to_string(ls, chr(10)) AS transcript") + f""")
, said AS (SELECT *, {trim('substr(transcript, 1, 200)')} AS content FROM due)
SELECT session_id, event_id, assistant_turn, content, CASE WHEN len(content) <= 140 THEN content ELSE substr(content, 1, 137) || '...' END AS summary,
  'semantic' AS memory_type, importance FROM said WHERE len(content) >= 10"""
