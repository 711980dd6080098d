"""SQL for the retrieval queries."""

from __future__ import annotations

from memlake.functions import lexicon as lx
from oracle.base import LN2, NOW, any_term, d, define, hours, r6, tokens, trim, with_ctes, WS

SQL: dict[str, str] = {}

define("qs", ["ev"], f"""
SELECT l.event_id AS query_id, l.session_id, l.user_id, l.content AS query_text, {tokens('l.content')} AS qt, e.embedding::DOUBLE[] AS qv,
  len(string_split_regex(regexp_replace(lower({trim('l.content')}), '[^a-z0-9{WS}]', '', 'g'), '[{WS}]+')) <= 2
   AND {any_term(f"regexp_replace(lower({trim('l.content')}), '[^a-z0-9{WS}]', '', 'g')", lx.STORE_SMALL_TALK_WORDS)} AS small
FROM (SELECT * FROM ev WHERE role = 'user') l
LEFT JOIN embeddings e ON e.vec_id = (l.conv_id * 8 + l.turn + 1) % 500""")
define("sv", ["stored"], f"""
SELECT s.*, e.embedding::DOUBLE[] AS emb, {tokens('s.summary')} AS st FROM stored s LEFT JOIN embeddings e ON e.vec_id = s.vec_id""")


def recency(half: int = 72) -> str:
    h = hours("created_at", NOW)
    return f"(CASE WHEN {h} <= 0 THEN 1e0 ELSE exp(-{d(LN2)} / {d(half)} * least({h}, {d(half * 10)})) END)"


def overlap(q: str, c: str) -> str:
    return f"len(list_filter({q}, lambda t: list_contains({c}, t)))"


define("qm", ["qs", "sv"], f"""
SELECT q.query_id, q.session_id AS query_session_id, q.qt, m.*, {overlap('q.qt', 'm.st')} AS lexical_score,
  {r6('list_cosine_similarity(q.qv, m.emb)')} AS vector_score FROM qs q JOIN sv m ON q.session_id = m.session_id""")


def hybrid(vec: str = "vector_score", lex: str = "lexical_score") -> str:
    return (f"(least(1e0, greatest(0e0, {vec})) * 0.5e0 + least(1e0, {lex} / 5e0) * 0.2e0 + importance * 0.2e0 "
            f"+ {recency()} * 0.1e0 + (CASE WHEN session_id = query_session_id THEN 0.04e0 ELSE 0e0 END))")


def vector_channel(scope: str) -> str:
    return f"""
SELECT q.query_id, q.session_id AS query_session_id, m.*, {r6('list_cosine_similarity(q.qv, m.emb)')} AS vector_score,
  {overlap('q.qt', 'm.st')} AS lexical_score FROM qs q JOIN sv m ON {scope} WHERE NOT q.small
QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY {r6('list_cosine_similarity(q.qv, m.emb)')} DESC, m.id) <= 24"""


define("vch", ["qs", "sv"], vector_channel("q.user_id = m.user_id"))
define("vtop", ["vch"], f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM (SELECT *, least(1e0, {hybrid()}) AS score FROM vch) WHERE score > 0.05e0 QUALIFY rank <= 8""")
SQL["r01_vector_topk"] = with_ctes("vtop") + f"SELECT query_id, rank, id, vector_score, lexical_score, {r6('score')} AS score FROM vtop"
define("vchg", ["qs", "sv"], vector_channel("true"))
SQL["r01_vector_topk_global"] = with_ctes("vchg") + f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, {r6('score')} AS score
FROM (SELECT *, least(1e0, {hybrid()}) AS score FROM vchg) WHERE score > 0.05e0 QUALIFY rank <= 8"""
define("ktop", ["qs", "sv"], f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT *, least(1e0, {hybrid('0e0')}) AS score FROM (
    SELECT q.query_id, q.session_id AS query_session_id, m.*, {overlap('q.qt', 'm.st')} AS lexical_score
    FROM qs q JOIN (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, created_at DESC, id) <= 32) m
      ON q.session_id = m.session_id WHERE NOT q.small)
  WHERE lexical_score > 0 OR importance >= 0.65e0) QUALIFY rank <= 8""")
SQL["r02_keyword_topk"] = with_ctes("ktop") + f"SELECT query_id, rank, id, lexical_score, {r6('score')} AS score FROM ktop"
SQL["r03_query_overlap"] = with_ctes("qm") + "SELECT query_id, id, lexical_score FROM qm"
SQL["r04_fulltext_rank"] = with_ctes("qs", "stored") + f"""
, post AS (SELECT session_id, id, term, count(*) AS tf FROM (SELECT session_id, id, unnest({tokens("content || ' ' || summary")}) AS term FROM stored) GROUP BY ALL)
, dfs AS (SELECT session_id, term, count(*) AS df FROM post GROUP BY ALL)
, nd AS (SELECT session_id, count(*) AS n FROM stored GROUP BY 1)
, qt AS (SELECT query_id, session_id, unnest(list_distinct(qt)) AS term FROM qs WHERE NOT small)
SELECT query_id, id, {r6('sum(tf * ln(1e0 + n::DOUBLE / df))')} AS rank_score
FROM qt JOIN dfs USING (session_id, term) JOIN nd USING (session_id) JOIN post USING (session_id, term) GROUP BY query_id, id"""
SQL["r05_keyword_score"] = with_ctes("qm") + "SELECT query_id, id, least(1e0, lexical_score / 5e0) AS keyword_score FROM qm"
SQL["r06_recency_decay"] = with_ctes("stored") + f"SELECT id, {r6(recency(336))} AS recency FROM stored"
_BONUS = "(CASE WHEN access_count > 0 THEN least(0.15e0, ln(1e0 + access_count) / ln(101e0)) ELSE 0e0 END)"
SQL["r07_access_bonus"] = with_ctes("stored") + f"SELECT id, {r6(_BONUS)} AS bonus FROM stored"
SQL["r09_hybrid_score"] = with_ctes("qm") + f"""
SELECT query_id, id, greatest(0e0, least(1e0, vector_score)) AS vector_part, least(1e0, lexical_score / 5e0) AS lexical_part,
  importance AS importance_part, {r6(recency())} AS recency_part, 0.04e0 AS session_bonus, {r6(f'least(1e0, {hybrid()})')} AS score FROM qm"""
_REL = "greatest(vector_score, least(1e0, lexical_score / 5e0), 0e0)"
SQL["r10_topical_penalty"] = with_ctes("qm") + f"""
SELECT query_id, id, {r6(f'least(1e0, {hybrid()} * CASE WHEN {_REL} < 0.1e0 THEN 0.3e0 WHEN {_REL} < 0.25e0 THEN 0.6e0 ELSE 1e0 END)')} AS score,
  {_REL} < 0.25e0 AS penalized FROM qm"""
SQL["r11_rerank"] = with_ctes("qm") + f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY least(1e0, {hybrid()}) DESC, id) AS rank, id,
  {r6(f'least(1e0, {hybrid()})')} AS score FROM qm QUALIFY rank <= 8"""
define("graded", ["qm"], f"""
SELECT *, least(1e0, importance + {_BONUS}) AS blended, {recency()} AS rec, least(1e0, lexical_score / 5e0) AS kws FROM qm""")
define("gscore", ["graded"], """
SELECT *, least(1e0, vector_score * 0.4e0 + kws * 0.2e0 + blended * 0.2e0 + rec * 0.1e0 + specificity * 0.1e0) AS final_score FROM graded""")
define("ranked", ["gscore"], """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank FROM gscore WHERE final_score > 0""")
SQL["r12_rank_memories"] = with_ctes("ranked") + f"SELECT query_id, rank, id, {r6('final_score')} AS final_score FROM ranked WHERE rank <= 5"


def reason(vec: str, kw: str, imp: str, rec: str, gr: str, sources: str) -> str:
    parts = (f"list_filter([CASE WHEN {vec} >= 0.5e0 THEN 'strong vector similarity' WHEN {vec} > 0 THEN 'partial vector similarity' END, "
             f"CASE WHEN {kw} >= 0.4e0 THEN 'keyword match' END, CASE WHEN {imp} >= 0.7e0 THEN 'high importance' WHEN {imp} >= 0.4e0 THEN 'moderate importance' END, "
             f"CASE WHEN {rec} >= 0.8e0 THEN 'recent' END, CASE WHEN {gr} >= 0.5e0 THEN 'graph-connected' END], lambda p: p IS NOT NULL)")
    return (f"'Selected via ' || {sources} || ' — ' || CASE WHEN len({parts}) = 0 THEN 'low-signal match' "
            f"ELSE array_to_string({parts}, ', ') END")


_REASON = reason("vector_score", "kws", "blended", "rec", "specificity",
                 "(CASE WHEN lexical_score > 0 THEN 'vector+keyword' ELSE 'vector' END)")
SQL["r13_explain_reason"] = with_ctes("ranked") + f"SELECT query_id, id, {_REASON} AS reason FROM ranked WHERE rank <= 5"
_PEN = "(CASE lifecycle_state WHEN 'stale' THEN 0.6e0 WHEN 'conflicted' THEN 0.8e0 ELSE 1e0 END)"
SQL["r16_lifecycle_rerank"] = with_ctes("ranked") + f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score * {_PEN} DESC, id) AS rank, id, {_PEN} AS penalty,
  {r6(f'final_score * {_PEN}')} AS final_score, {_REASON} || CASE lifecycle_state WHEN 'stale' THEN ' [lifecycle: stale penalty ×0.6]'
   WHEN 'conflicted' THEN ' [lifecycle: conflict penalty ×0.8]' ELSE '' END AS reason
FROM ranked WHERE rank <= 8 AND lifecycle_state <> 'archived'"""
define("chans", ["vtop", "ktop"], """
SELECT query_id, id, greatest(0e0, least(1e0, vector_score)) AS v, least(1e0, lexical_score / 5e0) AS k, 'vector' AS s, 0 AS ch, rank FROM vtop
UNION ALL SELECT query_id, id, 0e0, least(1e0, lexical_score / 5e0), 'keyword', 1, rank FROM ktop""")
define("merged", ["chans"], """
SELECT query_id, id, max(v) AS v, max(k) AS k, string_agg(s, '+' ORDER BY ch) AS sources, min((ch, rank)) AS seen FROM chans GROUP BY 1, 2""")
SQL["d11_merge_by_id"] = with_ctes("merged") + "SELECT query_id, id, v AS vector_score, k AS keyword_score, sources FROM merged"

# neighbours sharing two keywords
define("kwset", ["skw"], "SELECT id, list_sort(list(term)) AS items FROM skw GROUP BY 1")
define("nbr", ["kwset", "stored"], """
SELECT a.id, b.id AS neighbour_id, m.importance, m.created_at FROM kwset a JOIN kwset b ON a.id <> b.id AND len(list_intersect(a.items, b.items)) >= 2
JOIN stored m ON m.id = b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY m.importance DESC, m.created_at DESC, b.id) <= 5""")
define("nbr4", ["nbr"], """
SELECT * FROM nbr QUALIFY row_number() OVER (PARTITION BY id ORDER BY importance DESC, neighbour_id) <= 4""")


def enriched(source: str, vec: str, kw: str, sources: str, position: str) -> str:
    """CTEs ``enr``: graph-enriched candidates of ``source``."""
    return f"""
, cnt AS (SELECT id, count(*) AS n FROM nbr4 GROUP BY 1)
, base AS (SELECT c.query_id, c.id, {vec} AS v, {kw} AS k, {sources} AS sources, {position} AS position FROM {source} c)
, head AS (SELECT b.*, coalesce(n, 0) AS n, coalesce(x.entity_count, 0) AS ec, coalesce(x.rel_count, 0) AS rc FROM base b LEFT JOIN cnt USING (id) LEFT JOIN gctx x USING (id))
, enr AS (SELECT query_id, id, v, k, sources, CASE WHEN position <= 16 THEN least(1e0, greatest(
      CASE WHEN n > 0 THEN 0.3e0 + (n / 5e0) * 0.5e0 ELSE 0e0 END,
      CASE WHEN ec > 0 OR rc > 0 THEN 0.25e0 + least(0.3e0, (ec / 10e0) * 0.3e0) + least(0.15e0, (rc / 10e0) * 0.15e0) ELSE 0e0 END)) ELSE 0e0 END AS g FROM head
  UNION ALL
  SELECT r.query_id, r.neighbour_id, 0e0, least(1e0, {overlap('q.qt', 'm.st')} / 5e0), 'graph', least(1e0, 0.6e0 + m.importance * 0.4e0)
  FROM (SELECT DISTINCT b.query_id, n.neighbour_id FROM base b JOIN nbr4 n ON n.id = b.id WHERE b.position <= 16
        AND NOT EXISTS (SELECT 1 FROM base o WHERE o.query_id = b.query_id AND o.id = n.neighbour_id)) r
  JOIN qs q ON q.query_id = r.query_id JOIN sv m ON m.id = r.neighbour_id)"""


_BOTH_POS = "row_number() OVER (PARTITION BY c.query_id ORDER BY c.seen, c.id)"


def graph_dependent() -> None:
    """Statements that also need the entity graph CTEs (defined in ``graph_sql``)."""
    SQL["r14_graph_enrich"] = with_ctes("ktop", "nbr4", "gctx", "qs", "sv") + enriched(
        "ktop", "0e0", "least(1e0, c.lexical_score / 5e0)", "'keyword'", "c.rank") + f"""
SELECT query_id, id, {r6('g')} AS graph_score, k AS keyword_score, sources FROM enr"""
    SQL["r15_hybrid_retrieve"] = with_ctes("merged", "nbr4", "gctx", "qs", "sv") + enriched(
        "merged", "c.v", "c.k", "c.sources", _BOTH_POS) + f"""
, e2 AS (SELECT e.*, least(1e0, m.importance + {_BONUS}) AS blended, {recency()} AS rec FROM enr e JOIN sv m USING (id))
, e3 AS (SELECT *, least(1e0, v * 0.4e0 + k * 0.2e0 + blended * 0.2e0 + rec * 0.1e0 + g * 0.1e0) AS final_score FROM e2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank, id, {r6('final_score')} AS final_score,
  {reason('v', 'k', 'blended', 'rec', 'g', 'sources')} AS reason FROM e3 WHERE final_score > 0 QUALIFY rank <= 8"""


_WORDS = "list_filter(string_split_regex(lower(q.query_text), '\\s+'), lambda w: len(w) > 3)"
SQL["r18_working_set"] = with_ctes("qs", "mem", "ktop", "vtop") + f"""
, talk AS (SELECT query_id FROM qs WHERE NOT (
    len(string_split_regex(regexp_replace(lower({trim('query_text')}), '[^a-z0-9{WS}]', '', 'g'), '[{WS}]+')) <= 2
    AND {any_term(f"regexp_replace(lower({trim('query_text')}), '[^a-z0-9{WS}]', '', 'g')", lx.SMALL_TALK_WORDS)}))
, seeds AS (SELECT q.query_id, q.session_id AS query_session_id, m.id, m.session_id, m.fingerprint, m.importance, m.created_at
    FROM qs q JOIN mem m ON m.event_id = q.query_id WHERE len(list_filter({_WORDS}, lambda w: contains(lower(m.summary), w))) > 0)
, cand AS (SELECT *, NULL::DOUBLE AS vs, NULL::DOUBLE AS ls, 0 AS arrival FROM seeds
   UNION ALL SELECT query_id, query_session_id, id, session_id, fingerprint, importance, created_at, 0e0, lexical_score, 1 FROM ktop
   UNION ALL SELECT query_id, query_session_id, id, session_id, fingerprint, importance, created_at, vector_score, lexical_score, 2 FROM vtop)
, sc AS (SELECT query_id, id, arg_max(vs, arrival) AS vector_score, arg_max(ls, arrival) AS lexical_score FROM cand WHERE vs IS NOT NULL GROUP BY 1, 2)
, one AS (SELECT * FROM cand WHERE query_id IN (SELECT query_id FROM talk) QUALIFY row_number() OVER (PARTITION BY query_id,
    CASE WHEN fingerprint <> '' THEN fingerprint ELSE id END ORDER BY importance DESC, arrival, id) = 1)
, fin AS (SELECT one.*, coalesce(sc.vector_score, 0e0) AS vector_score, coalesce(sc.lexical_score, 0e0) AS lexical_score FROM one LEFT JOIN sc USING (query_id, id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arrival, id) AS rank, id, {r6('score')} AS score
FROM (SELECT *, least(1e0, {hybrid()}) AS score FROM fin) QUALIFY rank <= 8"""
