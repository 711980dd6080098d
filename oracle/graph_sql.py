"""SQL for the graph queries."""

from __future__ import annotations

from memlake.functions import lexicon as lx
from oracle.base import WS, define, hit, in_list, q, r6, rx, with_ctes
from oracle import retrieval_sql

SQL: dict[str, str] = {}

define("sen", ["gm"], f"""
SELECT id, session_id, type, value, pos FROM (
  SELECT id, session_id, split_part(e, ':', 1) AS type, trim(substr(e, strpos(e, ':') + 1)) AS value, pos FROM (
    SELECT id, session_id, unnest(ents) AS e, generate_subscripts(ents, 1) AS pos FROM gm)
  WHERE split_part(e, ':', 1) NOT IN {in_list(lx.NOISY_ENTITY_TYPES)} AND len(trim(substr(e, strpos(e, ':') + 1))) >= 3
  QUALIFY row_number() OVER (PARTITION BY id, type, lower(value) ORDER BY pos) = 1)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 6""")
define("stg", ["gm"], "SELECT DISTINCT id, session_id, unnest(tags) AS tag FROM gm")
_GATE = "importance >= 0.45e0 AND confidence >= 0.55e0"
SQL["g01_graph_gate"] = with_ctes("stored") + f"SELECT id, importance, confidence FROM stored WHERE {_GATE}"
SQL["g02_memory_keywords"] = with_ctes("skw") + "SELECT id, session_id, position, term AS keyword FROM skw JOIN stored USING (id)"
SQL["g03_memory_entities"] = with_ctes("sen") + "SELECT id, session_id, type, value FROM sen"
_N = "NULL::INT AS position, NULL::DOUBLE AS confidence"
define("ge", ["gm", "skw", "sen", "ev"], f"""
SELECT 'Session:' || session_id AS src, 'HAS_MEMORY' AS rel, 'Memory:' || id AS dst, {_N} FROM gm
UNION SELECT 'RawEvent:' || event_id, 'PRODUCED_MEMORY', 'Memory:' || id, {_N} FROM gm
UNION SELECT 'Memory:' || id, 'ABOUT', 'Domain:' || domain, {_N} FROM gm
UNION SELECT 'Memory:' || id, 'IS_TYPE', 'MemoryType:' || memory_type, {_N} FROM gm
UNION SELECT 'Memory:' || id, 'HAS_IMPORTANCE', 'ImportanceLevel:' || CASE WHEN importance >= 0.75e0 THEN 'critical' WHEN importance >= 0.5e0 THEN 'high' ELSE 'medium' END, {_N} FROM gm
UNION SELECT 'Memory:' || id, 'HAS_SENTIMENT', 'Sentiment:' || sentiment, {_N} FROM gm
UNION SELECT 'Memory:' || id, 'TAGGED_WITH', 'Tag:' || t, {_N} FROM (SELECT id, unnest(tags) AS t FROM gm)
UNION SELECT 'Memory:' || id, 'HAS_KEYWORD', 'Keyword:' || term, position, NULL FROM skw SEMI JOIN gm USING (id)
UNION SELECT 'Memory:' || id, 'MENTIONS', 'Entity:' || type || ':' || value, {_N} FROM sen SEMI JOIN gm USING (id)
UNION SELECT 'Memory:' || id, 'COULD_BE_ABOUT', 'Domain:' || a, NULL, 0.3e0 FROM (SELECT id, unnest(alternate_domains) AS a FROM gm)
UNION SELECT 'Session:' || session_id, 'HAS_EVENT', 'RawEvent:' || event_id, {_N} FROM ev""")
SQL["g04_graph_edges"] = with_ctes("ge") + "SELECT * FROM ge"
SQL["g04_graph_nodes"] = with_ctes("ge") + """
SELECT split_part(n, ':', 1) AS label, count(*) AS nodes FROM (SELECT src AS n FROM ge UNION SELECT dst FROM ge) GROUP BY 1"""
SQL["g05_keyword_frequency"] = with_ctes("skw") + "SELECT term AS keyword, count(*) AS frequency FROM skw GROUP BY 1"
SQL["g05_entity_occurrences"] = with_ctes("sen") + "SELECT type, value, count(*) AS occurrences FROM sen GROUP BY 1, 2"

# entity graph, one CTE per pass
_SQ = f"trim(regexp_replace(name, '[{WS}]+', ' ', 'g'))"
define("txt", ["stored"], "SELECT id, memory_type, created_at, domain, content || ' ' || summary AS t FROM stored")
define("e_early", ["txt"], f"""
SELECT id, 0 AS pass, 1 AS pos, 'topic' AS type, domain AS name, 'domain' AS source FROM txt WHERE len(domain) >= 2
UNION ALL SELECT id, 2, pos, CASE WHEN {hit('name', lx.ORGANIZATION_PATTERN, True)} THEN 'organization' ELSE 'project' END, name, 'proper_noun' FROM (
  SELECT id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM (SELECT id, regexp_extract_all(t, {rx(lx.MULTI_PROPER_PATTERN)}, 1) AS l FROM txt))
  WHERE len(name) BETWEEN 2 AND 80""")
define("e_ids", ["e_early"], f"SELECT id, list(type || ':' || lower({_SQ})) AS ids FROM e_early GROUP BY 1")


def _phrase(n: int, kind: str, pattern: str) -> str:
    return f"""SELECT id, {n}, pos, '{kind}', {_SQ}, '{kind}_signal' FROM (
  SELECT id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM (SELECT id, regexp_extract_all(t, {rx(pattern, True)}, 1) AS l FROM txt))
  WHERE len({_SQ}) BETWEEN 2 AND 80"""


define("e_all", ["e_early", "e_ids"], f"""
SELECT * FROM e_early
UNION ALL SELECT s.id, 3, pos, 'person', name, 'single_proper' FROM (
  SELECT id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM (SELECT id, regexp_extract_all(t, {rx(lx.SINGLE_PROPER_PATTERN)}, 1) AS l FROM txt)) s
  JOIN e_ids USING (id) WHERE name NOT IN {in_list(lx.PROPER_SKIP)} AND len(name) <= 80
   AND len(list_filter(ids, lambda i: ends_with(i, ':' || lower(name)) OR contains(i, ' ' || lower(name)))) = 0
UNION ALL {_phrase(4, 'task', lx.TASK_PATTERN)}
UNION ALL {_phrase(5, 'preference', lx.PREFERENCE_PATTERN)}
UNION ALL {_phrase(6, 'decision', lx.DECISION_PHRASE_PATTERN)}""")
_PRI = "CASE type " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(lx.ENTITY_PRIORITY)) + " END"
define("gent", ["e_all"], f"""
SELECT id, entity_id, name, type, source, row_number() OVER (PARTITION BY id ORDER BY {_PRI}, pass, pos) - 1 AS position FROM (
  SELECT *, type || ':' || lower({_SQ}) AS entity_id FROM e_all
  QUALIFY row_number() OVER (PARTITION BY id, entity_id ORDER BY pass, pos) = 1)
QUALIFY position < 12""")
SQL["g06_extract_graph_entities"] = with_ctes("gent") + "SELECT id, entity_id, name, type, source, position::INT AS position FROM gent"
define("cue", ["txt"], f"""
SELECT id, memory_type, created_at, {hit('t', lx.WORKS_ON_PATTERN, True)} AS works, {hit('t', lx.DEPENDS_ON_PATTERN, True)} AS dep,
  {hit('t', lx.COMPLETED_PATTERN, True)} AS done FROM txt""")
define("gpair", ["gent", "cue"], """
SELECT a.id, a.entity_id AS from_id, b.entity_id AS to_id, a.type AS f, b.type AS t, 1000 + a.position * 100 + b.position AS ord, c.* EXCLUDE (id)
FROM gent a JOIN gent b ON a.id = b.id AND a.position < b.position JOIN cue c ON c.id = a.id
UNION ALL SELECT a.id, a.entity_id, 'memory:' || a.id, a.type, 'memory', a.position, c.* EXCLUDE (id) FROM gent a JOIN cue c ON c.id = a.id""")
define("gtyped", ["gpair"], """
SELECT *, CASE WHEN t = 'memory' THEN 'mentioned_in' WHEN f = 'person' AND t = 'project' THEN 'works_on'
  WHEN f = 'person' AND t = 'task' THEN CASE WHEN done THEN 'completed' ELSE 'assigned_to' END
  WHEN f = 'person' AND t = 'organization' THEN 'belongs_to' WHEN f = 'person' AND t = 'preference' THEN 'prefers'
  WHEN f = 'person' AND t = 'decision' THEN 'decided'
  WHEN (f, t) IN (('project', 'task'), ('project', 'project'), ('task', 'task')) AND dep THEN 'depends_on' ELSE 'related_to' END AS rel,
 CASE WHEN t = 'memory' THEN 0.5e0 WHEN f = 'person' AND t = 'project' THEN CASE WHEN works THEN 0.55e0 + 0.25e0 ELSE 0.55e0 END
  WHEN f = 'person' AND t = 'task' THEN (CASE WHEN works THEN 0.55e0 + 0.2e0 ELSE 0.55e0 END) + (CASE WHEN done THEN 0.1e0 ELSE 0e0 END)
  WHEN f = 'person' AND t = 'organization' THEN 0.6e0 WHEN f = 'person' AND t = 'preference' THEN 0.7e0 WHEN f = 'person' AND t = 'decision' THEN 0.65e0
  WHEN f = 'project' AND t = 'task' THEN CASE WHEN dep THEN 0.55e0 + 0.15e0 ELSE 0.55e0 END WHEN f = 'project' AND t = 'project' THEN CASE WHEN dep THEN 0.45e0 + 0.25e0 ELSE 0.45e0 END
  WHEN f = 'task' AND t = 'task' THEN CASE WHEN dep THEN 0.4e0 + 0.3e0 ELSE 0.4e0 END WHEN f = 'topic' OR t = 'topic' THEN 0.4e0 ELSE 0.35e0 END AS c0 FROM gpair""")
define("grel", ["gtyped"], f"""
SELECT id, from_id, to_id, rel, least(1e0, c0 + CASE WHEN (memory_type = 'factual' AND rel IN ('prefers', 'decided'))
   OR (memory_type = 'episodic' AND rel IN ('completed', 'assigned_to')) THEN 0.1e0 ELSE 0e0 END) AS confidence,
  CASE WHEN t = 'memory' THEN 'baseline' ELSE 'entity_pair' END AS source, created_at, ord FROM gtyped
QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, ord) <= 20""")
SQL["g07_extract_relationships"] = with_ctes("grel") + f"SELECT id, from_id, to_id, rel, {r6('confidence')} AS confidence, source FROM grel"
define("gedge", ["grel"], """
SELECT from_id, rel, to_id, confidence, source FROM grel
QUALIFY row_number() OVER (PARTITION BY from_id, rel, to_id ORDER BY created_at DESC, id DESC) = 1""")
define("gnode", ["gent", "gedge", "txt"], """
SELECT entity_id, name, type, source FROM (SELECT g.*, t.created_at FROM gent g JOIN txt t USING (id)) x
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) = 1
UNION ALL SELECT DISTINCT to_id, NULL, NULL, NULL FROM gedge WHERE rel = 'mentioned_in'""")
SQL["g08_upsert_graph_nodes"] = with_ctes("gnode") + "SELECT * FROM gnode"
SQL["g08_upsert_graph_edges"] = with_ctes("gedge") + f"SELECT from_id, rel, to_id, {r6('confidence')} AS confidence, source FROM gedge"
define("kset", ["skw"], "SELECT items, count(*) AS n FROM (SELECT id, list_sort(list(term)) AS items FROM skw GROUP BY 1) GROUP BY 1")
define("tset", ["stg"], "SELECT items, count(*) AS n FROM (SELECT id, list_sort(list(tag)) AS items FROM stg GROUP BY 1) GROUP BY 1")


def similar(sets: str) -> str:
    return with_ctes(sets) + f"""
SELECT least(array_to_string(a.items, '|'), array_to_string(b.items, '|')) AS items_a, greatest(array_to_string(a.items, '|'), array_to_string(b.items, '|')) AS items_b,
  len(list_intersect(a.items, b.items)) AS score, 2 * a.n * b.n AS memory_links
FROM {sets} a JOIN {sets} b ON a.items < b.items WHERE len(list_intersect(a.items, b.items)) >= 2
UNION ALL SELECT array_to_string(items, '|'), array_to_string(items, '|'), len(items), n * (n - 1) FROM {sets} WHERE n > 1 AND len(items) >= 2"""


SQL["g09_similar_by_keywords"] = similar("kset")
SQL["g11_similar_by_tags"] = similar("tset")
SQL["g10_similar_by_domain"] = with_ctes("gm") + """
SELECT a.id, b.id AS neighbour_id, row_number() OVER (PARTITION BY a.id ORDER BY b.importance DESC, b.id) AS rank
FROM gm a JOIN gm b ON a.domain = b.domain AND a.id <> b.id QUALIFY rank <= 3"""
SQL["g10_domain_links"] = with_ctes("gm") + "SELECT id, domain, count(*) OVER (PARTITION BY domain) - 1 AS links FROM gm"
SQL["g10_expand_domains"] = with_ctes("gm") + """
SELECT a.id, b.id AS neighbour_id FROM gm a JOIN gm b ON a.domain = b.domain AND a.id <> b.id WHERE a.saved"""
SQL["g12_keyword_cooccurrence"] = with_ctes("skw") + """
SELECT a.term AS keyword_a, b.term AS keyword_b, count(*) AS cooccurrences FROM skw a JOIN skw b ON a.id = b.id AND a.term < b.term GROUP BY 1, 2"""


def best(keys: str, source: str, extra: str = "", tie: str = "") -> str:
    return f"""
SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY importance DESC, created_at DESC, id{tie}) AS rank, id{extra} FROM {source} QUALIFY rank <= 2"""


SQL["g13_memories_by_domain"] = with_ctes("gm") + best("session_id, domain", "gm")
SQL["g13_memories_by_keyword"] = with_ctes("skw") + best("session_id, keyword", "(SELECT s.*, term AS keyword FROM gm s JOIN skw USING (id))")
SQL["g13_memories_by_entity"] = with_ctes("sen") + best(
    "session_id, value", "(SELECT s.*, e.value, e.type AS entity_type FROM gm s JOIN sen e USING (id))", ", entity_type", ", entity_type")
SQL["g14_similar_memories"] = with_ctes("nbr") + """
SELECT id, neighbour_id, row_number() OVER (PARTITION BY id ORDER BY importance DESC, created_at DESC, neighbour_id) AS rank FROM nbr"""
SQL["g15_graph_stats"] = with_ctes("skw", "sen") + """
SELECT s.session_id, count(*) AS memories, count(DISTINCT domain) AS domains, coalesce(any_value(k), 0) AS keywords, coalesce(any_value(e), 0) AS entities
FROM gm s LEFT JOIN (SELECT session_id, count(DISTINCT term) AS k FROM skw JOIN gm USING (id) GROUP BY 1) kk ON kk.session_id = s.session_id
LEFT JOIN (SELECT session_id, count(DISTINCT (type, value)) AS e FROM sen GROUP BY 1) ee ON ee.session_id = s.session_id GROUP BY 1"""
SQL["g16_related_entities"] = with_ctes("gedge", "gnode") + f"""
SELECT from_id, to_id, n.name, n.type, rel, {r6('confidence')} AS confidence, row_number() OVER (PARTITION BY from_id ORDER BY e.confidence DESC, to_id, rel) AS rank
FROM gedge e JOIN gnode n ON n.entity_id = e.to_id WHERE rel <> 'mentioned_in' AND e.confidence >= 0.4e0 QUALIFY rank <= 5"""
define("gctx", ["gedge"], """
SELECT m.id, count(DISTINCT m.entity_id) AS entity_count, least(count(e.rel), 30) AS rel_count FROM (
  SELECT substr(to_id, 8) AS id, from_id AS entity_id FROM gedge WHERE rel = 'mentioned_in'
  QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY confidence DESC, from_id) <= 20) m
LEFT JOIN gedge e ON e.rel <> 'mentioned_in' AND e.from_id = m.entity_id
  AND e.to_id IN (SELECT o.from_id FROM gedge o WHERE o.rel = 'mentioned_in' AND o.to_id = 'memory:' || m.id)
GROUP BY m.id""")
SQL["g17_graph_context"] = with_ctes("gctx") + "SELECT * FROM gctx"
SQL["g18_remove_entities"] = with_ctes("gnode", "gedge") + """
, gone AS (SELECT entity_id FROM gnode WHERE type = 'topic')
SELECT 'node:' || coalesce(type, '-') AS kind, count(*) AS n FROM gnode WHERE type IS DISTINCT FROM 'topic' GROUP BY 1
UNION ALL SELECT 'edge:' || rel, count(*) FROM gedge WHERE from_id NOT IN (FROM gone) AND to_id NOT IN (FROM gone) GROUP BY 1"""
SQL["g18_remove_relationships"] = with_ctes("gedge") + "SELECT rel, count(*) AS n FROM gedge WHERE confidence >= 0.5e0 GROUP BY 1"
SQL["g19_entity_cooccurrence"] = with_ctes("sen") + """
SELECT a.value AS value_a, b.value AS value_b, count(*) AS cooccurrences FROM sen a JOIN sen b ON a.id = b.id AND a.value < b.value GROUP BY 1, 2"""
SQL["g19_domain_counts"] = with_ctes("gm") + "SELECT domain, count(*) AS memories FROM gm GROUP BY 1"
SQL["g19_shared_keyword_clusters"] = with_ctes("skw") + """
SELECT a.term AS keyword, count(DISTINCT a.id) + count(DISTINCT b.id) AS memory_count FROM skw a JOIN skw b ON a.term = b.term AND a.id < b.id GROUP BY 1"""
SQL["g19_mention_counts"] = with_ctes("sen") + "SELECT type, value, count(id) AS mentions FROM sen GROUP BY 1, 2"
retrieval_sql.graph_dependent()
