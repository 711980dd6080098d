"""SQL for the segmentation, classification and scoring queries."""

from __future__ import annotations

from memlake.functions import lexicon as lx
from oracle.base import (
    NOW, STORABLE, any_term, hours, keyword_cte, normalized, define, r2, tokens, trim, with_ctes, WS,
)

SQL: dict[str, str] = {}

SQL["p01_segment_events"] = with_ctes("seg") + "SELECT event_id, segment_index::INT AS segment_index, content FROM seg"
SQL["p02_tokenize"] = with_ctes("cls") + """
SELECT event_id, segment_index, array_to_string(toks, '|') AS tokens, len(toks) AS n FROM cls"""
SQL["p03_normalize_text"] = with_ctes("seg") + f"SELECT event_id, segment_index, {normalized('content')} AS norm FROM seg"
SQL["p04_classify_type"] = with_ctes("cls") + """
SELECT event_id, segment_index, n_factual, n_episodic, n_semantic, memory_type FROM cls"""
SQL["p05_classify_with_confidence"] = with_ctes("cls_c") + f"""
, alt AS (SELECT event_id, segment_index, t, row_number() OVER (PARTITION BY event_id, segment_index ORDER BY n DESC, o) AS rn,
    least(1e0, n::DOUBLE / n_others + 0.2e0) AS c
  FROM (SELECT event_id, segment_index, n_others, memory_type, 'factual' AS t, n_factual AS n, 0 AS o FROM cls_c
        UNION ALL SELECT event_id, segment_index, n_others, memory_type, 'episodic', n_episodic, 1 FROM cls_c
        UNION ALL SELECT event_id, segment_index, n_others, memory_type, 'semantic', n_semantic, 2 FROM cls_c)
  WHERE n > 0 AND t <> memory_type)
SELECT s.event_id, s.segment_index, s.memory_type, s.classification_confidence,
  a.t AS alt1, {r2('a.c')} AS alt1_confidence, b.t AS alt2, {r2('b.c')} AS alt2_confidence
FROM cls_c s LEFT JOIN alt a ON a.event_id = s.event_id AND a.segment_index = s.segment_index AND a.rn = 1
LEFT JOIN alt b ON b.event_id = s.event_id AND b.segment_index = s.segment_index AND b.rn = 2"""
# r2 of NULL falls through to printf(NULL) which is NULL
SQL["p06_infer_domain"] = with_ctes("cls_c") + """
SELECT event_id, segment_index, domain, domain_confidence, array_to_string(alternate_domains, '|') AS alternate_domains FROM cls_c"""
SQL["p07_infer_tags"] = with_ctes("cls_a") + """
SELECT event_id, segment_index, array_to_string(tags, '|') AS tags FROM cls_a"""
SQL["p08_infer_keywords"] = with_ctes("kw") + """
SELECT m.id, coalesce((SELECT string_agg(term, '|' ORDER BY position) FROM kw WHERE kw.id = m.id), '') AS keywords FROM mem m"""
SQL["p09_extract_entities"] = with_ctes("cls_b") + """
SELECT event_id, segment_index, array_to_string(ents, '|') AS entities FROM cls_b"""
for _n, _c in [("p10_score_specificity", "specificity"), ("p11_score_permanence", "permanence"),
               ("p12_score_actionability", "actionability"), ("p13_infer_sentiment", "sentiment"),
               ("p14_score_signal_strength", "signal_strength")]:
    SQL[_n] = with_ctes("cls_d") + f"SELECT event_id, segment_index, {_c} FROM cls_d"
SQL["p15_score_confidence"] = with_ctes("cls_f") + "SELECT event_id, segment_index, confidence FROM cls_f"
SQL["p16_score_importance"] = with_ctes("cls_h") + "SELECT event_id, segment_index, extraction_importance FROM cls_h"
SQL["p17_composite_importance"] = with_ctes("stored") + f"""
, parts AS (SELECT id, extraction_importance AS base, recency_raw,
    least(1e0, ln(1e0 + access_count) / ln(21e0)) AS freq, CASE WHEN saved THEN 0.15e0 ELSE 0e0 END AS saved_part,
    least(1e0, ln(1e0 + n_semantic) / ln(11e0)) AS ment, least(1e0, len(content) / 400e0) AS lens FROM stored)
, total AS (SELECT *, base * 0.6e0 + recency_raw * 0.15e0 + freq * 0.1e0 + saved_part + ment * 0.08e0 + lens * 0.05e0 AS t FROM parts)
SELECT id, {r2('t')} AS importance, base, {r2('recency_raw')} AS recency_part, {r2('freq')} AS frequency_part,
  saved_part, {r2('ment')} AS mention_part, {r2('lens')} AS length_part FROM total"""
SQL["p18_gate_memories"] = with_ctes("cls") + f"""
SELECT event_id, segment_index, role, memory_type FROM cls WHERE {STORABLE}"""
_PLAIN = f"regexp_replace(lower({trim('content')}), '[^a-z0-9{WS}]', '', 'g')"
SQL["p19_is_small_talk"] = with_ctes("seg") + f"""
SELECT event_id, segment_index, content FROM seg
WHERE len(string_split_regex({_PLAIN}, '[{WS}]+')) <= 2 AND {any_term(_PLAIN, lx.SMALL_TALK_WORDS)}"""
SQL["p20_summarize_140"] = with_ctes("seg") + """
SELECT event_id, segment_index, CASE WHEN len(content) > 140 THEN substr(content, 1, 137) || '...' ELSE content END AS summary FROM seg"""
SQL["p21_fingerprint"] = with_ctes("cls") + """
SELECT event_id, segment_index, array_to_string(list_sort(toks), ' ') AS fingerprint FROM cls"""
SQL["p22_extract_candidates"] = with_ctes("mem", "kw") + """
SELECT m.id, event_id, segment_index, session_id, user_id, memory_type, content, summary, fingerprint, importance,
  confidence, domain, domain_confidence, array_to_string(alternate_domains, '|') AS alternate_domains,
  array_to_string(tags, '|') AS tags,
  coalesce((SELECT string_agg(term, '|' ORDER BY position) FROM kw WHERE kw.id = m.id), '') AS keywords,
  array_to_string(ents, '|') AS entities, sentiment, signal_strength, specificity, permanence, actionability,
  classification_confidence
FROM mem m"""
SQL["p23_infer_session_state"] = with_ctes("ev") + """
, lastu AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, event_id DESC) AS rn
            FROM ev WHERE role = 'user')
, counts AS (SELECT session_id, count(*) FILTER (role = 'assistant') AS assistant_turns FROM ev GROUP BY session_id)
, w AS (SELECT *, list_filter(string_split_regex(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g'), ' +'),
          lambda t: len(t) > 3)[1:6] AS ws FROM lastu WHERE rn = 1)
SELECT c.session_id, w.event_id AS last_event_id,
  CASE WHEN w.event_id IS NULL THEN NULL WHEN len(ws) > 0 THEN array_to_string(ws, ' ') ELSE 'general' END AS current_topic,
  substr(content, 1, 180) AS last_user_intent,
  CASE WHEN w.event_id IS NULL THEN NULL
       WHEN regexp_matches(lower(content), 'implement|code|fix') THEN 'implementation'
       WHEN regexp_matches(lower(content), 'architecture|design') THEN 'architecture'
       WHEN regexp_matches(lower(content), 'how|why|what') THEN 'explanation' ELSE 'conversation' END AS mode,
  c.assistant_turns
FROM counts c LEFT JOIN w USING (session_id)"""
SQL["p24_importance_level"] = with_ctes("mem") + """
SELECT CASE WHEN importance >= 0.75e0 THEN 'critical' WHEN importance >= 0.5e0 THEN 'high'
            WHEN importance >= 0.25e0 THEN 'medium' ELSE 'low' END AS level, count(*) AS memories FROM mem GROUP BY 1"""
SQL["w01_recent_turns"] = with_ctes("ev") + """
SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, event_id) AS position
FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, event_id DESC) <= 6)"""
SQL["w02_top_memories_per_session"] = with_ctes("stored") + """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, id) AS rank, id, importance,
  memory_type, domain FROM stored QUALIFY rank <= 5"""
SQL["w03_top_memories"] = with_ctes("mem") + """
SELECT id, importance, memory_type FROM mem ORDER BY importance DESC, id LIMIT 20"""
SQL["w07_assistant_turn_numbers"] = with_ctes("ev") + """
SELECT event_id, count(*) FILTER (role = 'assistant') OVER (PARTITION BY session_id ORDER BY created_at, event_id
  ROWS UNBOUNDED PRECEDING) AS assistant_turn FROM ev"""
