"""SQL for consolidation and table maintenance."""

from __future__ import annotations

from memlake.functions import lexicon as lx
from oracle.base import NOW, define, hit, in_list, normalized, q, r2, r6, similarity_raw, tokens, with_ctes
from oracle.dedup_sql import tier

SQL: dict[str, str] = {}
EARLIER = "TIMESTAMP '2024-05-01 00:00:00'"


def chunk_ctes(p: str, source: str, now: str) -> None:
    """CTEs with prefix ``p``: groups, topics, conflicts and facts of ``source``."""
    define(f"{p}row", ["stored"], f"""
SELECT *, user_id || '/' || memory_type || '/' || domain AS bucket,
  row_number() OVER (PARTITION BY user_id, memory_type, domain ORDER BY importance DESC, id) AS spot,
  list_filter(string_split_regex(regexp_replace(lower(content), '[^a-z0-9_]+', ' ', 'g'), ' +'),
    lambda t: len(t) >= 3 AND t NOT IN {in_list(lx.CONSOLIDATION_STOP_WORDS)}) AS cw FROM {source} WHERE lifecycle_state <> 'archived'""")
    # every pair of a bucket that shares a word, in order, is tried in one step of the recursion
    define(f"{p}pair", [f"{p}row"], f"""
SELECT a.bucket, a.spot AS i, b.spot AS j, row_number() OVER (PARTITION BY a.bucket ORDER BY a.spot, b.spot) AS step
FROM {p}row a JOIN {p}row b ON a.bucket = b.bucket AND a.spot < b.spot AND list_has_any(a.cw, b.cw)""")
    define(f"{p}walk", [f"{p}row", f"{p}pair"], f"""
SELECT bucket, 0::BIGINT AS step, range(1, count(*) + 1) AS head FROM {p}row GROUP BY 1
UNION ALL
SELECT w.bucket, w.step + 1, CASE WHEN head[i] <> head[j] AND len(list_filter(head, lambda x: x = head[i] OR x = head[j])) <= 20
  THEN list_transform(head, lambda x: CASE WHEN x = greatest(head[i], head[j]) THEN least(head[i], head[j]) ELSE x END) ELSE head END
FROM {p}walk w JOIN {p}pair p ON p.bucket = w.bucket AND p.step = w.step + 1""")
    define(f"{p}grp", [f"{p}row", f"{p}walk"], f"""
SELECT *, count(*) OVER (PARTITION BY group_id) AS n_members FROM (
  SELECT r.* EXCLUDE (bucket, cw), h.id AS group_id FROM {p}row r
  JOIN (SELECT bucket, arg_max(head, step) AS head FROM {p}walk GROUP BY 1) l ON l.bucket = r.bucket
  JOIN {p}row h ON h.bucket = r.bucket AND h.spot = l.head[r.spot])
QUALIFY count(*) OVER (PARTITION BY group_id) >= 2""")
    define(f"{p}pl0", [f"{p}grp"], f"""
SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY importance DESC, id) AS position, {normalized('content')} AS norm,
  list_filter(string_split_regex(regexp_replace(lower(content), '[^a-z0-9_]+', ' ', 'g'), ' +'),
    lambda t: len(t) >= 3 AND t NOT IN {in_list(lx.CONSOLIDATION_STOP_WORDS)}) AS words FROM {p}grp""")
    define(f"{p}pl", [f"{p}pl0"], f"SELECT *, list_distinct({tokens('norm')}) AS nt FROM {p}pl0")
    rules = " UNION ALL ".join(
        f"SELECT group_id, position, {i} AS rule, {q(t)} AS name FROM {p}pl WHERE {hit('content', pat, True)}"
        for i, (t, pat) in enumerate(lx.GROUP_TOPICS))
    define(f"{p}topic", [f"{p}pl"], f"""
SELECT g.group_id, coalesce(v.name, CASE WHEN w.n >= greatest(2, ceil(g.size / 2)) THEN w.word END,
    CASE WHEN g.domain <> 'general' THEN g.memory_type || '/' || g.domain ELSE g.memory_type END) AS topic
FROM (SELECT group_id, count(*) AS size, any_value(domain) AS domain, any_value(memory_type) AS memory_type FROM {p}pl GROUP BY 1) g
LEFT JOIN (SELECT * FROM (SELECT group_id, name, count(*) AS n, min((position, rule)) AS seen FROM ({rules}) GROUP BY 1, 2)
   QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, seen) = 1) v ON v.group_id = g.group_id
LEFT JOIN (SELECT * FROM (SELECT group_id, word, count(*) AS n, min((position, spot)) AS seen FROM (
     SELECT group_id, position, word, min(spot) AS spot FROM (
       SELECT group_id, position, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM {p}pl) GROUP BY ALL) GROUP BY 1, 2)
   QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, seen) = 1) w ON w.group_id = g.group_id""")
    define(f"{p}conf", [f"{p}pl"], f"""
SELECT *, CASE WHEN similarity >= 0.6e0 THEN 'low' WHEN similarity >= 0.4e0 THEN 'medium' ELSE 'high' END AS severity FROM (
 SELECT group_id, id_a, id_b, {r2('raw')} AS similarity FROM (
  SELECT a.group_id, a.id AS id_a, b.id AS id_b, {similarity_raw('a.norm', 'b.norm', 'a.nt', 'b.nt')} AS raw
  FROM {p}pl a JOIN {p}pl b ON a.group_id = b.group_id AND a.position < b.position))
WHERE similarity < 0.88e0 AND similarity >= 0.25e0""")
    define(f"{p}best", [f"{p}pl"], f"""
SELECT * FROM (SELECT *, (confidence * importance) * 0.7e0 + least(1e0, epoch_ms(created_at)::DOUBLE / epoch_ms({now})) * 0.3e0 AS s FROM {p}pl)
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY s DESC, position) = 1""")
    define(f"{p}fact", [f"{p}topic", f"{p}conf", f"{p}best"], f"""
SELECT *, 'con_' || regexp_replace(user_id || '_' || topic || '_' || array_to_string(source_ids[1:2], '-'), '[^a-zA-Z0-9_-]', '_', 'g') AS id,
  {r2('craw')} AS confidence, {r2('iraw')} AS importance,
  CASE WHEN severity IS NOT NULL THEN 'conflicted' WHEN inactive / n >= 0.6e0 THEN 'stale' ELSE 'active' END AS status, n > inactive AS has_active FROM (
 SELECT g.*, t.topic, s.severity, b.content AS bc, b.summary AS bs, sum_ci / sum_i AS craw, least(0.95e0, avg_i * 1.1e0) AS iraw
 FROM (SELECT group_id, any_value(user_id) AS user_id, count(*)::DOUBLE AS n, list_sort(list(id)) AS source_ids, sum(confidence * importance) AS sum_ci,
         sum(importance) AS sum_i, avg(importance) AS avg_i, count(*) FILTER (lifecycle_state IN ('stale', 'archived')) AS inactive FROM {p}pl GROUP BY 1) g
 JOIN {p}topic t USING (group_id) JOIN {p}best b USING (group_id)
 LEFT JOIN (SELECT group_id, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
            FROM {p}conf GROUP BY 1) s USING (group_id))""")


chunk_ctes("n_", "stored", NOW)
chunk_ctes("o_", f"(SELECT * FROM stored WHERE created_at < {EARLIER})", EARLIER)
SQL["c01_eligible"] = with_ctes("stored") + """
SELECT user_id, count(*) AS eligible FROM stored WHERE lifecycle_state <> 'archived' GROUP BY 1"""
# list_distinct does not keep order, so the words are compared sorted by first position
SQL["c02_content_tokens"] = with_ctes("stored") + f"""
, w AS (SELECT id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM (SELECT id, list_filter(string_split_regex(
    regexp_replace(lower(content), '[^a-z0-9_]+', ' ', 'g'), ' +'), lambda t: len(t) >= 3 AND t NOT IN ({', '.join(q(t) for t in lx.CONSOLIDATION_STOP_WORDS)})) AS l FROM stored))
, f AS (SELECT id, word, min(p) AS p FROM w GROUP BY 1, 2)
SELECT s.id, coalesce(x.words, '') AS words FROM stored s LEFT JOIN (SELECT id, string_agg(word, '|' ORDER BY p) AS words FROM f GROUP BY 1) x USING (id)"""
SQL["c05_group_conflicts"] = with_ctes("n_conf") + """
SELECT group_id, id_a, id_b, similarity, severity, CASE severity WHEN 'low' THEN 'Slight phrasing difference' WHEN 'medium' THEN 'Factual disagreement detected'
  ELSE 'Direct contradiction suspected' END || ' (similarity ' || printf('%.2f', similarity) || ')' AS reason FROM n_conf"""
SQL["c06_elect_source"] = with_ctes("n_best") + "SELECT group_id, id FROM n_best"
SQL["c03_group_candidates"] = with_ctes("n_grp") + "SELECT group_id, id, user_id, memory_type, domain, n_members FROM n_grp"
SQL["c04_infer_topic"] = with_ctes("n_topic") + "SELECT group_id, topic FROM n_topic"
SQL["c07_consolidate"] = with_ctes("n_fact") + """
, tg AS (SELECT group_id, string_agg(t, '|' ORDER BY position, p) || '|consolidated' AS tags FROM (
   SELECT group_id, t, position, p FROM (SELECT group_id, position, unnest(tags) AS t, generate_subscripts(tags, 1) AS p FROM n_pl)
   QUALIFY row_number() OVER (PARTITION BY group_id, t ORDER BY position, p) = 1) GROUP BY 1)
, src AS (SELECT *, CASE WHEN len(bc) > 200 AND len(bs) > 0 THEN bs ELSE bc END AS s FROM n_fact)
SELECT group_id, id, user_id, topic, CASE WHEN len(s) > 200 THEN substr(s, 1, 197) || '…' ELSE s END AS summary,
  array_to_string(source_ids, '|') AS source_ids, confidence, importance, status, severity, coalesce(tags, 'consolidated') AS tags
FROM src LEFT JOIN tg USING (group_id)"""
SQL["u02_summarise_hook"] = with_ctes("n_pl", "n_topic") + """
SELECT group_id, topic, topic || ': ' || summary AS summary FROM n_topic JOIN (
  SELECT group_id, string_agg(substr(content, 1, 40), ' / ' ORDER BY position) AS summary FROM n_pl WHERE position <= 2 GROUP BY 1) USING (group_id)"""
define("rec", ["n_fact", "o_fact"], """
SELECT o.id AS existing_id, o.source_ids AS old_ids, n.group_id, n.user_id, n.source_ids, n.confidence, n.importance, n.status,
  len(list_filter(n.source_ids, lambda s: NOT list_contains(o.source_ids, s)))::DOUBLE / len(n.source_ids) AS new_fraction, o.status AS old_status, n.has_active
FROM n_fact n JOIN (SELECT * FROM o_fact QUALIFY row_number() OVER (PARTITION BY user_id, source_ids[1] ORDER BY id) = 1) o
  ON o.user_id = n.user_id AND o.source_ids[1] = n.source_ids[1]""")
_NEED = "(new_fraction >= 0.3e0 OR (old_status = 'stale' AND has_active))"
SQL["c08_needs_reconsolidation"] = with_ctes("rec") + f"""
SELECT existing_id, group_id, {r6('new_fraction')} AS new_fraction, {_NEED} AS needed FROM rec"""
SQL["c09_sweep_actions"] = with_ctes("rec") + f"""
SELECT n.group_id, n.user_id, CASE WHEN existing_id IS NULL THEN 'created' WHEN {_NEED} THEN 'updated' ELSE 'skipped' END AS action, existing_id
FROM n_fact n LEFT JOIN rec r USING (group_id)""".replace("has_active)", "r.has_active)")
SQL["c09_consolidation_sweep"] = SQL["c09_sweep_actions"].replace("SELECT n.group_id", ", acts AS (SELECT n.group_id", 1) + """)
SELECT user_id, count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated,
  count(*) FILTER (action = 'skipped') AS skipped, count(*) AS groups FROM acts GROUP BY 1"""
SQL["c10_update_consolidated"] = with_ctes("rec") + f"""
SELECT existing_id AS id, 2 AS version, len(list_distinct(list_concat(old_ids, source_ids))) AS n_sources, confidence, importance, status FROM rec WHERE {_NEED}"""
SQL["c11_provenance"] = with_ctes("n_fact") + """
, s AS (SELECT f.id, m.id AS mid, m.created_at FROM (SELECT id, unnest(source_ids) AS sid FROM n_fact) f JOIN stored m ON m.id = f.sid
        QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY m.created_at DESC, m.id) = 1)
SELECT f.id, len(source_ids) AS source_count, s.mid AS latest_source_id, confidence, 1 AS version FROM n_fact f JOIN s USING (id)"""
SQL["c12_with_evidence"] = with_ctes("n_fact") + """
SELECT f.id, m.id AS source_id, m.importance FROM (SELECT id, unnest(source_ids) AS sid FROM n_fact) f JOIN stored m ON m.id = f.sid"""

# -- tables --------------------------------------------------------------------
SQL["s01_read_events"] = with_ctes("ev") + "SELECT event_id, session_id, role FROM ev ORDER BY created_at DESC, event_id DESC LIMIT 200"
SQL["s01_read_all_events"] = with_ctes("ev") + """
SELECT row_number() OVER (ORDER BY created_at, event_id) AS position, event_id, session_id, role FROM ev"""
SQL["s05_write_routed"] = with_ctes("stored") + """
SELECT id, CASE WHEN memory_type = 'factual' THEN 'relational' ELSE 'vector' END AS route FROM stored"""
SQL["s02_append_events"] = with_ctes("ev") + """
SELECT session_id, count(*) AS events, count(DISTINCT created_at::DATE) AS days FROM ev GROUP BY 1"""
SQL["s03_read_memories"] = with_ctes("stored") + "SELECT session_id, count(*) AS memories FROM stored GROUP BY 1"
SQL["s04_upsert_memories"] = with_ctes("mem") + """
, old AS (SELECT * FROM mem WHERE created_at < TIMESTAMP '2024-04-01' QUALIFY row_number() OVER (PARTITION BY session_id, fingerprint ORDER BY created_at, id) = 1)
, rows AS (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM mem WHERE created_at >= TIMESTAMP '2024-04-01')
, w AS (SELECT *, first_value(id) OVER f AS first_id, first_value(created_at) OVER f AS first_at,
    max(importance) OVER (PARTITION BY session_id, fingerprint) AS imp,
    row_number() OVER (PARTITION BY session_id, fingerprint ORDER BY n DESC, created_at DESC, id DESC) AS back FROM rows
    WINDOW f AS (PARTITION BY session_id, fingerprint ORDER BY n, created_at, id))
SELECT session_id, fingerprint, first_id AS id, event_id, content, imp AS importance, confidence,
  strftime(first_at, '%Y-%m-%d') AS created, strftime(created_at, '%Y-%m-%d') AS updated FROM w WHERE back = 1"""
SQL["s05_route_memories"] = with_ctes("stored") + """
SELECT CASE WHEN memory_type = 'factual' THEN 'relational' ELSE 'vector' END AS route, memory_type, count(*) AS memories FROM stored GROUP BY 1, 2"""
SQL["s06_write_tiered"] = with_ctes("stored") + f"SELECT {tier(NOW)} AS tier, count(*) AS memories FROM stored GROUP BY 1"
SQL["s06_write_tiered_twice"] = with_ctes("stored") + f"""
SELECT id, CASE WHEN vec_id % 3 = 0 THEN {tier("TIMESTAMP '2025-06-01 00:00:00'")} ELSE {tier(NOW)} END AS tier FROM stored WHERE vec_id % 8 <> 1"""
SQL["s10_remove_sessions"] = with_ctes("stored") + """
SELECT session_id, fingerprint FROM stored WHERE session_id NOT IN (SELECT session_id FROM stored WHERE saved)"""
SQL["s07_read_all_tiers"] = with_ctes("stored") + f"""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rank, id, {tier(NOW)} AS tier FROM stored"""
SQL["s08_upsert_consolidated"] = with_ctes("n_fact", "o_fact") + """
SELECT coalesce(n.id, o.id) AS id, coalesce(n.confidence, o.confidence) AS confidence, coalesce(n.importance, o.importance) AS importance,
  coalesce(n.status, o.status) AS status, CASE WHEN o.id IS NULL THEN '2024-06-01' ELSE '2024-05-01' END AS created,
  CASE WHEN n.id IS NULL THEN '2024-05-01' ELSE '2024-06-01' END AS updated
FROM o_fact o FULL JOIN n_fact n ON n.id = o.id"""
SQL["s09_find_consolidated"] = with_ctes("n_fact") + """
SELECT id, user_id, importance FROM n_fact WHERE status = 'active' AND topic = 'planning'"""
SQL["s10_purge_and_delete"] = with_ctes("stored") + """
SELECT session_id, count(*) AS memories FROM stored WHERE lifecycle_state <> 'archived' AND session_id NOT IN (SELECT session_id FROM stored WHERE saved) GROUP BY 1"""
SQL["s11_patch_memories"] = with_ctes("sweep") + """
SELECT to_state AS lifecycle_state, CASE WHEN from_state <> to_state AND to_state = 'archived' THEN 'cold' ELSE 'warm' END AS tier, count(*) AS memories
FROM sweep GROUP BY 1, 2"""
define("hits", ["stored"], "SELECT s.id, e.ts FROM events e JOIN stored s ON s.session_id = 's' || e.user_id")
SQL["s12_record_access"] = with_ctes("hits") + """
SELECT s.id, access_count + coalesce(n, 0) AS access_count, strftime(coalesce(greatest(h.last, last_accessed_at), h.last, last_accessed_at), '%Y-%m-%d %H:%M:%S') AS last_accessed_at
FROM stored s LEFT JOIN (SELECT id, count(*) AS n, max(ts) AS last FROM hits GROUP BY 1) h USING (id)"""
SQL["s12_usage_rows"] = with_ctes("hits") + """
SELECT h.id, count(*) AS hits, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_used_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used_at,
  any_value(importance) AS last_importance, any_value(memory_type) AS memory_type FROM hits h JOIN stored s USING (id) GROUP BY 1"""
