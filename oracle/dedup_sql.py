"""SQL for duplicates, tiers and the lifecycle."""

from __future__ import annotations

from memlake.functions import lexicon as lx
from oracle.base import (
    LN2, NOW, _ENT, any_term, d, define, hit, hours, in_list, jaccard, normalized, q, r2, r6,
    similarity_raw, tokens, with_ctes, words3,
)

SQL: dict[str, str] = {}
SPLIT = "TIMESTAMP '2024-04-01 00:00:00'"

define("memn", ["mem"], f"SELECT *, {normalized('content')} AS norm FROM mem")
define("memt", ["memn"], f"SELECT *, list_distinct({tokens('norm')}) AS nt FROM memn")
define("prev", ["memt"], """
SELECT *, lag(id) OVER w AS id_a, lag(norm) OVER w AS norm_a, lag(nt) OVER w AS nt_a, lag(toks) OVER w AS toks_a,
  lag(ents) OVER w AS ents_a, lag(domain) OVER w AS domain_a
FROM memt WINDOW w AS (PARTITION BY session_id ORDER BY created_at, event_id, segment_index)""")
SQL["d02_text_similarity"] = with_ctes("prev") + f"""
, s AS (SELECT id, id_a, {similarity_raw('norm_a', 'norm', 'nt_a', 'nt')} AS raw FROM prev WHERE id_a IS NOT NULL)
SELECT id, id_a, {r2('raw')} AS similarity FROM s"""


def near_dup(source: str, scope: str, ident: str, norm: str, toks: str) -> str:
    return f"""
, reps AS (SELECT {scope}, {norm} AS norm, min({ident}) AS rep, any_value({toks}) AS nt FROM {source} GROUP BY 1, 2)
, pairs AS (SELECT a.{scope}, a.rep AS id_a, b.rep AS id_b, a.norm AS an, b.norm AS bn, a.nt AS ant, b.nt AS bnt
   FROM reps a JOIN reps b ON a.{scope} = b.{scope} AND a.rep < b.rep
   WHERE least(len(a.nt), len(b.nt)) >= 0.85e0 * greatest(len(a.nt), len(b.nt)) AND len(list_intersect(a.nt, b.nt)) >= 0.85e0 * greatest(len(a.nt), len(b.nt))
     AND len(a.nt) > 0)
, s AS (SELECT *, {similarity_raw('an', 'bn', 'ant', 'bnt')} AS raw FROM pairs)
SELECT {scope}, id_a, id_b, {r2('raw')} AS similarity, 'similar' AS kind FROM s WHERE {r2('raw')} >= 0.92e0
UNION ALL
SELECT m.{scope}, r.rep, m.{ident}, 1e0, 'copy' FROM {source} m JOIN reps r ON m.{scope} = r.{scope} AND m.{norm} = r.norm WHERE m.{ident} <> r.rep"""


SQL["d03_near_dup_pairs"] = with_ctes("memt") + near_dup("memt", "user_id", "id", "norm", "nt")
define("docn", [], f"SELECT doc_id, lang, {normalized('text')} AS norm FROM documents")
define("doct", ["docn"], f"SELECT *, list_distinct({tokens('norm')}) AS nt FROM docn")
SQL["d03_near_dup_documents"] = with_ctes("doct") + near_dup("doct", "lang", "doc_id", "norm", "nt")

# confidence fold, row by row
define("mgr", ["mem"], f"""
SELECT *, row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY created_at, id) AS k,
  count(*) OVER (PARTITION BY user_id, fingerprint) AS n,
  CAST((conv_id * 3 + turn) % 25 AS INT) AS access_count, conv_id % 11 = 0 AS saved FROM mem""")
_MERGE = with_ctes("mgr", "kw").replace("WITH ", "WITH RECURSIVE ", 1)
SQL["d04_merge_memories"] = _MERGE + f"""
, fold AS (
  SELECT user_id, fingerprint, k, n, confidence AS c FROM mgr WHERE k = 1
  UNION ALL
  SELECT user_id, fingerprint, k, n, {r2('raw')} FROM (
    SELECT f.user_id, f.fingerprint, m.k, f.n, f.c * (2e0 / 3e0) + m.confidence * (1e0 / 3e0) AS raw
    FROM fold f JOIN mgr m ON m.user_id = f.user_id AND m.fingerprint = f.fingerprint AND m.k = f.k + 1))
, tg AS (SELECT user_id, fingerprint, string_agg(t, '|' ORDER BY k, p) AS tags FROM (
    SELECT user_id, fingerprint, t, k, p FROM (SELECT user_id, fingerprint, k, unnest(tags) AS t, generate_subscripts(tags, 1) AS p FROM mgr)
    QUALIFY row_number() OVER (PARTITION BY user_id, fingerprint, t ORDER BY k, p) = 1) GROUP BY 1, 2)
, kws AS (SELECT user_id, fingerprint, string_agg(term, '|' ORDER BY k, position) AS keywords FROM (
    SELECT m.user_id, m.fingerprint, m.k, kw.term, kw.position FROM mgr m JOIN kw USING (id)
    QUALIFY row_number() OVER (PARTITION BY m.user_id, m.fingerprint, kw.term ORDER BY m.k, kw.position) = 1) GROUP BY 1, 2)
, agg AS (SELECT user_id, fingerprint, arg_min(id, k) AS id, arg_min(content, (-len(content), k)) AS content, max(importance) AS importance,
    CAST(sum(access_count) AS BIGINT) AS access_count, bool_or(saved) AS saved, count(*) AS merged_rows, max(created_at) AS latest FROM mgr GROUP BY 1, 2)
SELECT a.user_id, id, content, importance, f.c AS confidence, access_count, saved, merged_rows, coalesce(tags, '') AS tags,
  coalesce(keywords, '') AS keywords, strftime(latest, '%Y-%m-%d') AS latest
FROM agg a JOIN fold f ON f.user_id = a.user_id AND f.fingerprint = a.fingerprint AND f.k = f.n
LEFT JOIN tg ON tg.user_id = a.user_id AND tg.fingerprint = a.fingerprint
LEFT JOIN kws ON kws.user_id = a.user_id AND kws.fingerprint = a.fingerprint"""
SQL["d05_dedup_fingerprint"] = with_ctes("stored") + "SELECT id, session_id, fingerprint FROM stored"

define("vec", ["mem"], """
SELECT m.*, e.embedding::DOUBLE[] AS emb FROM mem m LEFT JOIN embeddings e ON e.vec_id = (m.conv_id * 8 + m.turn) % 500""")
define("old", ["vec"], f"""
SELECT * FROM vec WHERE created_at < {SPLIT} QUALIFY row_number() OVER (PARTITION BY session_id, fingerprint ORDER BY created_at, id) = 1""")
define("new", ["vec"], f"SELECT * FROM vec WHERE created_at >= {SPLIT}")
define("near1", ["old", "new"], f"""
SELECT n.id, o.id AS oid, {r6('list_cosine_similarity(n.emb, o.emb)')} AS c FROM new n JOIN old o ON n.session_id = o.session_id
QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY c DESC, o.id) = 1""")
SQL["d06_dedup_embedding"] = with_ctes("near1") + """
SELECT n.id, CASE WHEN c >= 0.92e0 THEN oid END AS existing_id, CASE WHEN c > 0 THEN c ELSE 0e0 END AS similarity,
  coalesce(c >= 0.92e0, false) AS is_duplicate FROM new n LEFT JOIN near1 USING (id)"""
SQL["d07_cosine"] = with_ctes("stored") + f"""
, v AS (SELECT s.*, e.embedding::DOUBLE[] AS emb FROM stored s LEFT JOIN embeddings e ON e.vec_id = s.vec_id)
, p AS (SELECT id, emb, lag(id) OVER w AS id_a, lag(emb) OVER w AS emb_a FROM v
        WINDOW w AS (PARTITION BY session_id ORDER BY created_at, event_id, segment_index))
SELECT id, id_a, {r6('list_cosine_similarity(emb_a, emb)')} AS cosine FROM p WHERE id_a IS NOT NULL"""
define("verdict", ["near1"], """
SELECT n.*, o.id AS same_id, n1.oid, n1.c FROM new n LEFT JOIN old o ON o.session_id = n.session_id AND o.fingerprint = n.fingerprint AND n.fingerprint <> ''
LEFT JOIN near1 n1 ON n1.id = n.id""")
_REASON = ("CASE WHEN same_id IS NOT NULL THEN 'fingerprint' WHEN memory_type <> 'factual' AND coalesce(c >= 0.92e0, false) "
           "THEN 'embedding' ELSE 'none' END")
SQL["d08_duplicate_checks"] = with_ctes("verdict") + f"""
SELECT id, memory_type, CASE WHEN same_id IS NOT NULL THEN same_id WHEN memory_type <> 'factual' AND c >= 0.92e0 THEN oid END AS existing_id,
  CASE WHEN same_id IS NOT NULL THEN 1e0 WHEN memory_type <> 'factual' AND c > 0 THEN c ELSE 0e0 END AS similarity, {_REASON} AS reason FROM verdict"""
SQL["d08_dedup_candidates"] = with_ctes("verdict") + f"""
SELECT id, session_id, memory_type FROM verdict WHERE {_REASON} = 'none'
QUALIFY row_number() OVER (PARTITION BY session_id, fingerprint ORDER BY created_at, id) = 1"""
SQL["d09_unseen_texts"] = with_ctes("mem") + f"""
, t AS (SELECT memory_type || ': ' || summary AS text, created_at FROM mem)
, emb AS (SELECT text, max(created_at) AS at FROM t WHERE created_at < {SPLIT} GROUP BY 1)
SELECT DISTINCT sha256('default:' || w.text) AS key, w.text FROM t w WHERE w.created_at >= {SPLIT} AND NOT EXISTS (
  SELECT 1 FROM emb WHERE emb.text = w.text AND {hours('emb.at', "TIMESTAMP '2024-04-20 00:00:00'")} <
    CASE WHEN len(w.text) < 24 THEN 6 WHEN contains(lower(w.text), 'factual:') OR contains(lower(w.text), 'semantic:')
         OR contains(lower(w.text), 'episodic:') THEN 720 ELSE 168 END)"""
_VALS = "list_transform({}, lambda v: lower(substr(v, strpos(v, ':') + 1)))"
SQL["d10_relatedness"] = with_ctes("prev") + f"""
, p AS (SELECT *, list_distinct(toks) AS tb, list_distinct(toks_a) AS ta, {_VALS.format('ents')} AS eb, {_VALS.format('ents_a')} AS ea
        FROM prev WHERE id_a IS NOT NULL)
SELECT id, id_a, {r6(f'''{jaccard('ta', 'tb')} * 0.5e0 + least(1e0, (len(list_filter(ea, lambda v: list_contains(eb, v))) + 0.5e0)
   / greatest(len(ea), len(eb), 1)) * 0.3e0 + (CASE WHEN domain = domain_a THEN 1e0 ELSE 0e0 END) * 0.2e0''')} AS relatedness FROM p"""


# -- tiers ---------------------------------------------------------------------

def tier(now: str) -> str:
    return (f"CASE WHEN {hours('coalesce(last_accessed_at, created_at)', now)} <= 168 THEN 'hot' "
            f"WHEN {hours('created_at', now)} > 2160 AND importance < 0.4e0 THEN 'cold' ELSE 'warm' END")


SQL["t01_assign_tier"] = with_ctes("stored") + f"SELECT id, {tier(NOW)} AS tier FROM stored"
define("moves", ["stored"], f"""SELECT *, {tier("TIMESTAMP '2024-05-02 00:00:00'")} AS from_tier, {tier(NOW)} AS to_tier FROM stored""")
SQL["t02_tier_moves"] = with_ctes("moves") + "SELECT id, user_id, from_tier, to_tier FROM moves WHERE from_tier <> to_tier"
SQL["t02_rebalance_counts"] = with_ctes("moves") + """
SELECT user_id, count(*) AS total, count(*) FILTER (from_tier <> to_tier) AS moved,
  count(*) FILTER (from_tier <> to_tier AND to_tier = 'hot') AS to_hot, count(*) FILTER (from_tier <> to_tier AND to_tier = 'warm') AS to_warm,
  count(*) FILTER (from_tier <> to_tier AND to_tier = 'cold') AS to_cold FROM moves GROUP BY 1"""
SQL["t03_promote_demote"] = with_ctes("moves") + f"""
SELECT id, to_tier AS tier, strftime(CASE WHEN to_tier = 'hot' THEN {NOW} ELSE last_accessed_at END, '%Y-%m-%d') AS accessed
FROM moves WHERE from_tier <> to_tier"""


def decay(h: str, half: int) -> str:
    return f"(CASE WHEN {h} <= 0 THEN 1e0 ELSE exp(-({d(LN2)} / {d(half)}) * least({h}, {d(half * 10)})) END)"


define("sig", ["stored"], f"""
SELECT *, {r2('ar')} AS age_score, {r2('cr')} AS access_score FROM (
  SELECT *, {decay('age_hours', 1440)} AS ar, {decay('last_access_hours', 504)} AS cr FROM (
    SELECT *, greatest(0e0, {hours('created_at', NOW)}) AS age_hours,
      greatest(0e0, {hours('coalesce(last_accessed_at, created_at)', NOW)}) AS last_access_hours FROM stored))""")
define("sigs", ["sig"], f"SELECT *, {r2('fr')} AS freshness FROM (SELECT *, age_score * 0.35e0 + access_score * 0.65e0 AS fr FROM sig)")
SQL["l01_lifecycle_signals"] = with_ctes("sigs") + """
SELECT id, age_hours, last_access_hours, age_score, access_score, freshness FROM sigs"""
_STALE = ("(last_access_hours >= CASE WHEN memory_type = 'factual' AND confidence >= 0.75e0 THEN 1440 ELSE 720 END "
          "AND importance < 0.3e0)")
_ARCH = "(lifecycle_state IN ('stale', 'conflicted') AND last_access_hours >= 2880 AND importance < 0.4e0)"
SQL["l02_lifecycle_masks"] = with_ctes("sigs") + f"SELECT id, {_STALE} AS stale, {_ARCH} AS archive FROM sigs"
define("trans", ["sigs"], f"""
SELECT *, CASE WHEN lifecycle_state = 'archived' THEN 'archived' WHEN lifecycle_state IN ('stale', 'conflicted') THEN
  CASE WHEN {_ARCH} THEN 'archived' ELSE lifecycle_state END WHEN {_STALE} THEN 'stale' ELSE 'active' END AS next_state FROM sigs""")
SQL["l03_transition"] = with_ctes("trans") + "SELECT id, lifecycle_state, next_state FROM trans"
SQL["l04_revive"] = with_ctes("stored") + f"""
SELECT id, 'active' AS lifecycle_state, {tier(NOW)} AS tier FROM stored WHERE lifecycle_state = 'archived'"""

SQL["l04_mark_stale"] = with_ctes("stored") + """
SELECT id, 'stale' AS lifecycle_state, 'warm' AS tier FROM stored WHERE importance < 0.5e0 AND NOT saved"""
SQL["l04_archive"] = with_ctes("stored") + """
SELECT id, 'archived' AS lifecycle_state, 'cold' AS tier FROM stored WHERE lifecycle_state = 'stale'"""

_TOPICS = "list_filter([" + ", ".join(
    f"CASE WHEN {hit('norm', p)} THEN {q(t)} END" for t, p in lx.CONFLICT_TOPICS) + "], lambda t: t IS NOT NULL)"
SQL["l05_conflict_topics"] = with_ctes("memt") + f"""
SELECT id, array_to_string({_TOPICS}, '|') AS topics FROM memt WHERE len({_TOPICS}) > 0"""
define("cl0", ["stored"], f"""
SELECT *, {normalized('content')} AS norm, {words3('content', lx.CONFLICT_STOP_WORDS)} AS words FROM stored""")
define("cl", ["cl0"], f"SELECT *, list_distinct({tokens('norm')}) AS nt, {_TOPICS} AS topics FROM cl0")
define("cpairs", ["cl"], f"""
SELECT *, {r2('raw')} AS similarity FROM (
SELECT a.user_id, a.id, b.id AS conflicting_id, a.content AS ca, b.content AS cb, a.memory_type AS ta, b.memory_type AS tb,
  list_filter(a.topics, lambda t: list_contains(b.topics, t)) AS shared,
  a.confidence AS mc, b.confidence AS pc, a.created_at AS mt, b.created_at AS pt,
  {similarity_raw('a.norm', 'b.norm', 'a.nt', 'b.nt')} AS raw
FROM cl a JOIN cl b ON a.user_id = b.user_id AND a.id <> b.id
WHERE (a.memory_type = b.memory_type OR (a.memory_type = 'semantic' AND b.memory_type = 'factual'))
  AND (len(a.words) = 0 OR len(b.words) = 0 OR len(list_intersect(a.words, b.words)) > 0))""")
define("crec", ["cpairs"], f"""
SELECT *, {r2('score')} AS confidence FROM (
SELECT *, (CASE WHEN len(shared) > 0 AND similarity < 0.88e0 THEN 0.5e0 ELSE 0e0 END) + {r2('band')} * 0.25e0 + greatest(mc, pc) * 0.15e0
   + (CASE WHEN mt <> pt THEN 0.1e0 ELSE 0e0 END) AS score
FROM (SELECT *, (similarity - 0.35e0) / (0.88e0 - 0.35e0) AS band FROM cpairs WHERE similarity >= 0.25e0 AND similarity < 0.92e0))""")
SQL["u03_embed_hook"] = with_ctes("stored") + """
SELECT DISTINCT sha256('default:' || content) AS key, len(content)::INTEGER AS length, (len(content) - len(replace(content, ' ', '')))::INTEGER AS spaces
FROM stored w WHERE len(content) < 24 OR NOT EXISTS (SELECT 1 FROM stored e WHERE e.saved AND e.content = w.content)"""
SQL["u01_custom_scorer"] = with_ctes("stored") + f"""
, reps AS (SELECT user_id, {normalized('content')} AS norm, min(id) AS id FROM stored GROUP BY 1, 2)
, t AS (SELECT r.user_id, r.id, s.content FROM reps r JOIN stored s ON s.id = r.id)
SELECT * FROM (SELECT a.user_id, a.id AS id_a, b.id AS id_b,
    floor((1 - levenshtein(a.content, b.content)::DOUBLE / greatest(len(a.content), len(b.content))) * 10000) / 10000 AS similarity
  FROM t a JOIN t b ON a.user_id = b.user_id AND a.id < b.id AND substr(a.content, 1, 6) = substr(b.content, 1, 6))
WHERE similarity >= 0.3e0"""
SQL["l06_conflict_candidates"] = with_ctes("cl") + """
SELECT DISTINCT a.user_id, a.content, a.memory_type, b.content AS other_content, b.memory_type AS other_type
FROM cl a JOIN cl b ON a.user_id = b.user_id AND (a.content <> b.content OR a.memory_type <> b.memory_type)
WHERE (a.memory_type = b.memory_type OR (a.memory_type = 'semantic' AND b.memory_type = 'factual')) AND len(list_intersect(a.words, b.words)) > 0
  AND (len(a.nt) < 3 OR len(b.nt) < 3
    OR len(list_intersect(a.nt, b.nt)) >= 0.245e0 * (len(a.nt) + len(b.nt) - len(list_intersect(a.nt, b.nt))))"""
SQL["l07_factored_conflicts"] = with_ctes("cpairs") + """
SELECT user_id, ca AS content, ta AS memory_type, cb AS other_content, tb AS other_type, similarity,
  count(DISTINCT id) AS members, count(DISTINCT conflicting_id) AS other_members
FROM cpairs WHERE similarity >= 0.25e0 AND similarity < 0.92e0 GROUP BY ALL"""
_REC = "crec WHERE confidence >= 0.5e0"
SQL["l07_detect_conflicts"] = with_ctes("crec") + f"""
SELECT id, conflicting_id, similarity, confidence,
  CASE WHEN len(shared) > 0 AND similarity < 0.88e0 THEN 'Conflicting ' || array_to_string(shared, ', ') || ' claim detected (similarity ' || printf('%.2f', similarity) || ')'
       ELSE 'Potentially contradictory content on overlapping topic (similarity ' || printf('%.2f', similarity) || ')' END AS reason,
  CASE WHEN abs(pc - mc) > 0.05e0 THEN pc > mc ELSE pt >= mt END AS prefer_other FROM {_REC}"""
SQL["l07_conflict_counts"] = with_ctes("crec") + f"SELECT id, count(*) AS conflict_count FROM {_REC} GROUP BY 1"
SQL["l04_mark_conflicted"] = with_ctes("crec") + f"""
SELECT id, 'conflicted' AS lifecycle_state, 'warm' AS tier, count(*) AS n_conflicts FROM {_REC} GROUP BY 1"""
define("sweep", ["crec", "trans"], f"""
SELECT id, user_id, lifecycle_state AS from_state,
  CASE WHEN next_state NOT IN ('archived', 'conflicted') AND coalesce(n, 0) > 0 THEN 'conflicted' ELSE next_state END AS to_state,
  CASE WHEN next_state NOT IN ('archived', 'conflicted') AND coalesce(n, 0) > 0 THEN n ELSE 0 END AS conflict_count
FROM trans LEFT JOIN (SELECT id, count(*) AS n FROM {_REC} GROUP BY 1) USING (id)""")
SQL["l08_lifecycle_sweep"] = with_ctes("sweep") + """
SELECT *, CASE WHEN to_state = 'archived' THEN 'cold' ELSE 'warm' END AS tier FROM sweep WHERE from_state <> to_state"""
SQL["l09_fan_out_lifecycle"] = with_ctes("sweep") + """
, c AS (SELECT s.*, m.memory_type FROM sweep s JOIN stored m USING (id) WHERE from_state <> to_state)
SELECT 'relational' AS target, count(*) FILTER (memory_type = 'factual') AS ok, count(*) FILTER (memory_type <> 'factual') AS skipped FROM c
UNION ALL SELECT 'vector', count(*) FILTER (memory_type <> 'factual'), count(*) FILTER (memory_type = 'factual') FROM c"""
