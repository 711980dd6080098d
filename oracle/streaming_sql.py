"""SQL for the streaming queries.

Streams run to the end of their input, windows still open there included.
"""

from __future__ import annotations

from oracle.base import d, r6, with_ctes
from oracle import monitor_sql  # noqa: F401  (log CTEs)
from oracle import retrieval_sql, consolidation_sql, text_sql  # noqa: F401

SQL: dict[str, str] = {}
SQL["x02_drop_duplicate_jobs"] = with_ctes("att").replace("WITH ", "WITH RECURSIVE ", 1) + """
, seq AS (SELECT ikey, job_id, attempt, ts, error_message IS NULL AS done, row_number() OVER (PARTITION BY ikey ORDER BY ts, job_id, attempt) AS n FROM att)
, run AS (
  SELECT ikey, job_id, attempt, n, true AS runs, CASE WHEN done THEN ts END AS marked FROM seq WHERE n = 1
  UNION ALL
  SELECT s.ikey, s.job_id, s.attempt, s.n, coalesce(s.ts >= r.marked + INTERVAL 7 DAY, true) AS runs,
    CASE WHEN s.done AND coalesce(s.ts >= r.marked + INTERVAL 7 DAY, true) THEN s.ts ELSE r.marked END
  FROM run r JOIN seq s ON s.ikey = r.ikey AND s.n = r.n + 1)
SELECT ikey AS idempotency_key, job_id, attempt FROM run WHERE runs"""
SQL["x03_quarantine_invalid"] = """
SELECT event_id, CASE WHEN event_type = 'signup' OR event_type = 'error' THEN 'dead' ELSE 'kept' END AS sink FROM events"""
SQL["x05_stream_session_state"] = text_sql.SQL["p23_infer_session_state"].replace(
    "SELECT c.session_id, w.event_id AS last_event_id,", "SELECT c.session_id, turns,", 1).replace(
    "  substr(content, 1, 180) AS last_user_intent,\n", "", 1).replace(
    "counts AS (SELECT session_id,", "counts AS (SELECT session_id, least(12, count(*)) AS turns,", 1)
SQL["x07_stream_sweeps"] = with_ctes("n_fact") + "SELECT id, topic, status, len(source_ids) AS n_sources FROM n_fact"
SQL["x06_stream_dedup_upsert"] = with_ctes("stored") + "SELECT session_id, fingerprint, memory_type FROM stored"
SQL["x08_stream_metrics"] = with_ctes("req") + f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, route, count(*) AS requests, count(*) FILTER (status >= 500) AS errors,
  count(*) FILTER (cache_hit) AS hits, {r6('sum(duration_s)')} AS duration_sum, count(*) FILTER (duration_s <= {d(1)}) AS le_7
FROM req GROUP BY date_trunc('hour', ts), route"""
SQL["x08_stream_event_rate"] = with_ctes("req") + f"""
, w AS (SELECT route, time_bucket(INTERVAL 20 MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes(i * 20) AS ws FROM req, range(0, 3) AS r(i))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, route, count(*) AS events, {r6('count(*) / 3600e0')} AS per_second FROM w GROUP BY ws, route"""
SQL["x09_session_activity"] = with_ctes("req") + """
, g AS (SELECT client_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM req WINDOW w AS (PARTITION BY client_id ORDER BY ts))
, s AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT client_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS expires_at, count(*) AS events
FROM s GROUP BY client_id, n"""
_PEN = "CASE status WHEN 'stale' THEN 0.6e0 WHEN 'conflicted' THEN 0.8e0 ELSE 1e0 END"
SQL["r17_inject_consolidations"] = with_ctes("ranked", "n_fact", "qs") + f"""
, best AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, importance DESC, id) AS cr FROM (
    SELECT *, confidence * importance * {_PEN} AS score FROM n_fact) QUALIFY cr <= 3)
, rows AS (SELECT query_id, id, 'memory' AS kind, rank::DOUBLE AS spot, 0 AS tie FROM ranked WHERE rank <= 5
  UNION ALL SELECT query_id, b.id, 'consolidation', 1.5e0, cr FROM qs JOIN best b USING (user_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, tie) AS position, id, kind FROM rows"""
