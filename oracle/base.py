"""Shared SQL pieces: expression helpers and named CTEs."""

from __future__ import annotations

import math
import re

from memlake.functions import lexicon as lx
from memlake.sources.corpus import AS_OF, STATES, TEMPLATES

WS = lx.WHITE_SPACE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def d(x: float) -> str:
    """A DOUBLE literal (plain decimals would be DECIMAL)."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def rx(pattern: str, ci: bool = False) -> str:
    return q(("(?i)" if ci else "") + lx.expand_white_space(pattern))


def hit(col: str, pattern: str, ci: bool = False) -> str:
    return f"regexp_matches({col}, {rx(pattern, ci)})"


def n_hits(col: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST({hit(col, p, True)} AS INT)" for p in patterns) + ")"


def n_terms(col: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(t)}) AS INT)" for t in terms) + ")"


def any_term(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(t)})" for t in terms) + ")"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def r2(x: str) -> str:
    """Two decimals on the exact binary value; printf is half-even, so exact ties are listed."""
    return (f"(CASE WHEN {x} <= 0 THEN 0e0 WHEN {x} >= 1 THEN 1e0 WHEN {x} = 0.125e0 THEN 0.13e0 "
            f"WHEN {x} = 0.625e0 THEN 0.63e0 ELSE CAST(printf('%.2f', {x}) AS DOUBLE) END)")


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000e0 + 0.5001e0) / 1000000e0)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def tokens(x: str) -> str:
    words = f"string_split_regex(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' +')"
    return f"list_filter({words}, lambda t: t <> '' AND t NOT IN {in_list(lx.STOP_TERMS)})"


def normalized(x: str) -> str:
    out = f"lower({x})"
    for pattern, replacement in lx.CONTRACTIONS:
        out = f"regexp_replace({out}, {rx(pattern)}, {q(replacement)}, 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def words3(x: str, stop: list[str]) -> str:
    words = f"string_split_regex(regexp_replace(lower({x}), '[^a-z0-9_]+', ' ', 'g'), ' +')"
    return f"list_distinct(list_filter({words}, lambda t: len(t) >= 3 AND t NOT IN {in_list(stop)}))"


def hours(a: str, b: str) -> str:
    """Hours from ``a`` to ``b``."""
    return f"((epoch_ms({b}) - epoch_ms({a})) / 3600000e0)"


def jaccard(a: str, b: str) -> str:
    i = f"len(list_intersect({a}, {b}))"
    return (f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0e0 "
            f"ELSE {i}::DOUBLE / (len({a}) + len({b}) - {i}) END)")


def lcs(a: str, b: str) -> str:
    """Longest common substring length, by trying every slice of ``a``."""
    return (f"coalesce(list_max(list_transform(range(1, len({a}) + 1), lambda i: "
            f"coalesce(list_max(list_filter(range(1, len({a}) - i + 2), "
            f"lambda l: contains({b}, substr({a}, i, l)))), 0))), 0)")


def similarity_raw(an: str, bn: str, at: str, bt: str) -> str:
    return (f"(CASE WHEN len({at}) = 0 AND len({bt}) = 0 THEN CASE WHEN {an} = {bn} THEN 1e0 ELSE 0e0 END "
            f"WHEN len({at}) < 3 OR len({bt}) < 3 THEN {jaccard(at, bt)} * 0.6e0 + "
            f"(CASE WHEN greatest(len({an}), len({bn})) = 0 THEN 1e0 ELSE "
            f"{lcs(an, bn)}::DOUBLE / greatest(len({an}), len({bn})) END) * 0.4e0 "
            f"ELSE {jaccard(at, bt)} END)")


NOW = f"TIMESTAMP '{AS_OF}'"
_CTES: dict[str, tuple[list[str], str]] = {}


def define(name: str, deps: list[str], body: str) -> None:
    _CTES[name] = (deps, body)


def with_ctes(*names: str) -> str:
    """``WITH …`` holding the named CTEs and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    recursive = {n for n in order if re.search(rf"\bFROM {n}\b", _CTES[n][1])}
    parts = [f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({_CTES[n][1]})" for n in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


# -- corpus ------------------------------------------------------------------

_TPL = "[" + ", ".join(q(t) for t in TEMPLATES) + "]"
_STATE = "[" + ", ".join(q(s) for s in STATES) + "]"

define("ev", [], f"""
SELECT 's' || conv_id || '-' || turn AS event_id, 's' || conv_id AS session_id,
       'u' || (conv_id % 25) AS user_id, role,
       text || chr(10) || ({_TPL})[(conv_id * 7 + turn * 5) % {len(TEMPLATES)} + 1]
         || CASE WHEN turn % 3 = 0 THEN chr(10) || ({_TPL})[(conv_id * 7 + turn * 5) % {len(TEMPLATES)} + 1] ELSE '' END AS content,
       {NOW} - to_days(CAST((conv_id * 37 + turn * 11) % 160 AS INT)) AS created_at, conv_id, turn
FROM conversations""")

define("seg", ["ev"], f"""
SELECT event_id, session_id, user_id, role, created_at, conv_id, turn,
       generate_subscripts(parts, 1) - 1 AS segment_index, unnest(parts) AS content
FROM (SELECT *, list_filter(list_transform(string_split(
        regexp_replace({trim('content')}, '([.!?])[{WS}]+', '\\1' || chr(10), 'g'), chr(10)),
        lambda s: {trim('s')}), lambda s: s <> '') AS parts FROM ev)""")

define("cls", ["seg"], f"""
SELECT *, CASE WHEN n_factual > 0 AND n_factual >= n_episodic THEN 'factual'
               WHEN n_episodic > 0 THEN 'episodic' ELSE 'semantic' END AS memory_type
FROM (SELECT *, lower(content) AS lc, {tokens('content')} AS toks,
        {n_hits('lower(content)', lx.FACTUAL_PATTERNS)} AS n_factual,
        {n_hits('lower(content)', lx.EPISODIC_PATTERNS)} AS n_episodic,
        {n_hits('lower(content)', lx.SEMANTIC_PATTERNS)} AS n_semantic FROM seg)""")

_LOW = f"({trim('lc')} IN {in_list(lx.LOW_SIGNAL_PHRASES)} OR len({trim('lc')}) < 8)"
_STORABLE = f"""(NOT {_LOW}
  AND NOT ({' OR '.join(f"starts_with({trim('lc')}, {q(p)})" for p in lx.MEMORY_QUERY_PREFIXES)})
  AND CASE WHEN role = 'assistant' THEN NOT {hit(trim('lc'), lx.DEMO_REPLY_PATTERN)}
             AND NOT contains(lc, {q(lx.FALLBACK_REPLY_NOTICE)})
             AND {any_term(trim('lc'), lx.ASSISTANT_KEEP_TERMS)}
           WHEN memory_type = 'semantic' THEN len({trim('lc')}) > 24 ELSE true END)"""
STORABLE = _STORABLE

define("gated", ["cls"], f"SELECT * FROM cls WHERE {_STORABLE}")

_DOMAINS = "[" + ", ".join(
    f"{{'neg': -least(1e0, {d(w)} * {n_terms('lc', terms)}), 'rule': {i}, 'domain': {q(name)}}}"
    for i, (name, w, terms) in enumerate(lx.DOMAIN_RULES)) + "]"
_ENT = "list_concat(" + ", ".join(
    f"list_transform(regexp_extract_all(content, {rx(p, ci)}), lambda v: {q(k + ':')} || v)"
    for k, ci, p in lx.ENTITY_PATTERNS)
_ENT = _ENT + (f", list_transform(list_filter(regexp_extract_all(content, {rx(lx.PROPER_NAME_PATTERN)}), "
               f"lambda v: v NOT IN {in_list(lx.IGNORED_NAMES)}), lambda v: 'name_or_title:' || v))")
_TAGS = "list_filter([" + ", ".join(
    f"CASE WHEN {any_term('lc', terms)} THEN {q(tag)} END" for tag, terms in lx.TAG_RULES) + \
    "], lambda t: t IS NOT NULL)"


def annotation(source: str) -> dict[str, tuple[list[str], str]]:
    """CTE bodies that score the segments of ``source``; keys get its name as suffix."""
    s = source
    out = {}
    out[f"{s}_a"] = ([s], f"""
SELECT *, list_sort(list_filter({_DOMAINS}, lambda e: e.neg < 0)) AS dom, {_ENT} AS ent_all, {_TAGS} AS tags,
  {hit('lc', lx.IDENTITY_SHORTCUT)} AS is_identity, {hit('lc', lx.PREFERENCE_SHORTCUT)} AS is_preference,
  CASE WHEN memory_type = 'factual' THEN n_factual WHEN memory_type = 'episodic' THEN n_episodic ELSE n_semantic END AS n_best,
  greatest(1, n_factual + n_episodic + n_semantic - 1) AS n_others
FROM {s}""")
    out[f"{s}_b"] = ([f"{s}_a"], f"""
SELECT *, list_filter(ent_all, lambda v, i: list_position(ent_all, v) = i)[1:{lx.MAX_ENTITIES}] AS ents,
  CASE WHEN is_identity THEN 'identity' WHEN is_preference THEN 'preference' WHEN len(dom) > 0 THEN dom[1].domain ELSE 'general' END AS domain,
  CASE WHEN is_identity THEN 0.95e0 WHEN is_preference THEN 0.9e0 WHEN len(dom) > 0 THEN least(0.95e0, -dom[1].neg) ELSE 0.35e0 END AS dconf_raw,
  CASE WHEN is_identity THEN list_filter(dom, lambda e: e.domain <> 'identity')[1:3]
       WHEN is_preference THEN list_filter(dom, lambda e: e.domain <> 'preference')[1:3] ELSE dom[2:4] END AS alt_raw,
  least(1e0, n_best::DOUBLE / n_others + 0.3e0) AS ccr, len(toks) AS n_tok, len(tags) AS n_tag
FROM {s}_a""")
    bonus = lambda cond, v: f"(CASE WHEN {cond} THEN {d(v)} ELSE 0e0 END)"
    out[f"{s}_c"] = ([f"{s}_b"], f"""
SELECT *, {r2('dconf_raw')} AS domain_confidence, {r2('ccr')} AS classification_confidence,
  list_transform(alt_raw, lambda e: e.domain) AS alternate_domains,
  0.2e0 + {bonus('n_tok >= 6', .15)} + {bonus('n_tok >= 14', .12)} + {bonus('len(ents) > 0', .18)}
    + {bonus(hit('content', lx.NUMBER_PATTERN), .12)} + {bonus(hit('content', lx.REASON_PATTERN, True), .14)} AS spec_raw,
  (CASE memory_type WHEN 'factual' THEN 0.68e0 WHEN 'semantic' THEN 0.54e0 ELSE 0.42e0 END)
    + {bonus(any_term('lc', lx.STABLE_TERMS), .18)} - {bonus(any_term('lc', lx.TEMPORAL_TERMS), .14)}
    + {bonus(any_term('lc', lx.LASTING_TERMS), .08)} AS perm_raw,
  0.15e0 + {bonus(any_term('lc', lx.ACTION_TERMS), .35)} + {bonus(any_term('lc', lx.PLANNING_TERMS), .2)}
    - {bonus("contains(lc, '?')", .1)} AS act_raw,
  CASE WHEN {n_terms('lc', lx.POSITIVE_TERMS)} > {n_terms('lc', lx.NEGATIVE_TERMS)} THEN 'positive'
       WHEN {n_terms('lc', lx.NEGATIVE_TERMS)} > {n_terms('lc', lx.POSITIVE_TERMS)} THEN 'negative' ELSE 'neutral' END AS sentiment,
  0.25e0 + (CASE memory_type WHEN 'factual' THEN 0.2e0 WHEN 'episodic' THEN 0.14e0 ELSE 0.08e0 END)
    + least(0.16e0, n_tok * 0.01e0) + least(0.16e0, n_tag * 0.04e0) - {bonus(_LOW, .3)}
    - {bonus(hit('content', lx.HEDGE_PATTERN, True), .08)} AS sig_raw,
  CASE WHEN len(content) <= 140 THEN content ELSE substr(content, 1, 137) || '...' END AS summary
FROM {s}_b""")
    out[f"{s}_d"] = ([f"{s}_c"], f"""
SELECT *, {r2('spec_raw')} AS specificity, {r2('perm_raw')} AS permanence, {r2('act_raw')} AS actionability,
  {r2('sig_raw')} AS signal_strength FROM {s}_c""")
    out[f"{s}_e"] = ([f"{s}_d"], f"""
SELECT *, (CASE WHEN role = 'user' THEN 0.58e0 ELSE 0.44e0 END) + specificity * 0.18e0 + domain_confidence * 0.12e0
   + least(0.08e0, n_tag * 0.02e0) + {bonus("memory_type = 'factual'", .08)}
   + least(0.12e0, {n_terms('lc', lx.FACT_TERMS)} * 0.05e0) - {bonus("contains(lc, '?')", .16)}
   - least(0.2e0, {n_terms('lc', lx.UNCERTAIN_TERMS)} * 0.08e0)
   - {bonus(f"role = 'assistant' AND NOT {hit('lc', lx.DECISION_PATTERN, True)}", .08)} AS conf_raw
FROM {s}_d""")
    out[f"{s}_f"] = ([f"{s}_e"], f"SELECT *, {r2('conf_raw')} AS confidence FROM {s}_e")
    out[f"{s}_g"] = ([f"{s}_f"], f"""
SELECT *, (signal_strength * 0.28e0 + confidence * 0.2e0 + specificity * 0.16e0 + permanence * 0.16e0
   + actionability * 0.12e0 + domain_confidence * 0.08e0 + {bonus("role = 'user'", .06)}
   + {bonus("memory_type = 'factual'", .08)} + {bonus("memory_type = 'episodic'", .04)}
   + {bonus(hit('content', lx.KEY_WORD_PATTERN, True), .08)} + {bonus('len(content) > 220', .03)}
   - {bonus(f"ends_with({trim('content')}, '?')", .08)})
   * CASE WHEN memory_type = 'episodic' THEN exp(-0.015e0 * least({hours('created_at', NOW)}, 720e0)) ELSE 1e0 END AS imp_raw
FROM {s}_f""")
    recency = (f"CASE WHEN memory_type = 'factual' THEN 1e0 ELSE exp(-(ln(2e0) / 72e0) * "
               f"least(greatest(0e0, {hours('created_at', NOW)}), 720e0)) END")
    out[f"{s}_h"] = ([f"{s}_g"], f"SELECT *, {r2('imp_raw')} AS extraction_importance, {recency} AS recency_raw FROM {s}_g")
    out[f"{s}_i"] = ([f"{s}_h"], f"""
SELECT *, extraction_importance * 0.6e0 + recency_raw * 0.15e0 + 0e0 * 0.1e0 + 0e0 + 0e0 * 0.08e0
   + least(1e0, len(content) / 400e0) * 0.05e0 AS comp_raw FROM {s}_h""")
    out[f"{s}_scored"] = ([f"{s}_i"], f"""
SELECT *, {r2('comp_raw')} AS importance, sha256(event_id || ':' || segment_index) AS id,
   array_to_string(list_sort(toks), ' ') AS fingerprint FROM {s}_i""")
    return out


for _source in ("gated", "cls"):
    for _name, (_deps, _body) in annotation(_source).items():
        define(_name, _deps, _body)

define("mem", ["gated_scored"], "SELECT * FROM gated_scored")


def keyword_cte(source: str) -> str:
    return f"""
SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY score DESC, c DESC, pos) - 1 AS position FROM (
  SELECT id, term, c, pos, (c / n) * ln(1e0 + 1e0 / c) * (1e0 - ((c / n) * ln(c / n + 1e0)) * 0.1e0) AS score FROM (
    SELECT id, term, count(*)::DOUBLE AS c, min(pos) AS pos, any_value(n)::DOUBLE AS n FROM (
      SELECT id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos, len(toks) AS n FROM {source})
    WHERE len(term) >= 3 GROUP BY id, term))
QUALIFY position < 8"""


define("kw", ["mem"], keyword_cte("mem"))

# stored memories: first of each (session, fingerprint), with usage columns
define("stored", ["mem"], f"""
SELECT *, conv_id % 2 AS odd,
  CASE WHEN conv_id % 2 <> 0 THEN least({NOW}, created_at + to_days(CAST((conv_id * 13) % 40 AS INT))) END AS last_accessed_at,
  CAST((conv_id * 3 + turn) % 25 AS INT) AS access_count, conv_id % 11 = 0 AS saved,
  ({_STATE})[(conv_id + turn) % {len(STATES)} + 1] AS lifecycle_state, (conv_id * 8 + turn) % 500 AS vec_id
FROM (SELECT *, row_number() OVER (PARTITION BY session_id, fingerprint ORDER BY created_at, id) AS rn FROM mem)
WHERE rn = 1""")
define("gm", ["stored"], "SELECT * FROM stored WHERE importance >= 0.45e0 AND confidence >= 0.55e0")
define("skw", ["gm"], keyword_cte("gm"))
LN2 = math.log(2)
