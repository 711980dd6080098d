"""Tiers, ageing, state transitions and contradicting memories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.config import LifecycleConfig
from memlake.functions import lexicon as lx
from memlake.functions.text import (
    as_timestamp, conflict_tokens, hours_between, matches, normalize_text, tokenize,
    with_rounded, with_similarity,
)
from memlake.operators.dedup import token_parities, tokens_apart
from memlake.session import materialize

DEFAULTS = LifecycleConfig()


# -- tiers -------------------------------------------------------------------

def tier_of(as_of, importance="importance", created="created_at", accessed="last_accessed_at") -> Column:
    """hot: used within 7 days; cold: older than 90 days and unimportant; else warm."""
    now = as_timestamp(as_of)
    last = F.coalesce(F.col(accessed), F.col(created))
    return (F.when(hours_between(last, now) <= 7 * 24, "hot")
            .when((hours_between(F.col(created), now) > 90 * 24)
                  & (F.coalesce(F.col(importance), F.lit(0.0)) < 0.4), "cold")
            .otherwise("warm"))


def assign_tier(df: DataFrame, as_of) -> DataFrame:
    return df.withColumn("tier", tier_of(as_of))


def tier_moves(df: DataFrame, as_of) -> DataFrame:
    """Rows whose stored ``tier`` differs from the one they belong to."""
    return (df.withColumn("to_tier", tier_of(as_of)).where(F.col("tier") != F.col("to_tier"))
            .select("id", "user_id", F.col("tier").alias("from_tier"), "to_tier"))


def rebalance_counts(df: DataFrame, as_of) -> DataFrame:
    """Per user: rows looked at and rows moved, by direction."""
    moved = df.withColumn("to_tier", tier_of(as_of))
    changed = F.col("tier") != F.col("to_tier")
    return moved.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(changed).alias("moved"),
        *[F.count_if(changed & (F.col("to_tier") == t)).alias(f"to_{t}")
          for t in ("hot", "warm", "cold")])


def promote(df: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Rows named in ``ids`` become hot and count as accessed now."""
    chosen = df.join(ids.select("id").distinct(), "id", "left_semi")
    return chosen.withColumns({"tier": F.lit("hot"), "last_accessed_at": as_timestamp(as_of)})


def demote(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows named in ``targets (id, tier)`` move to that tier."""
    return df.drop("tier").join(targets.select("id", "tier"), "id")


# -- ageing --------------------------------------------------------------------

def _decay(age: Column, half_life: float) -> Column:
    return F.when(age <= 0, 1.0).otherwise(
        F.exp(F.lit(-(math.log(2) / half_life)) * F.least(age, F.lit(half_life * 10.0))))


def lifecycle_signals(df: DataFrame, as_of) -> DataFrame:
    """Add ``age_hours, last_access_hours, age_score, access_score, freshness``."""
    now = as_timestamp(as_of)
    age = F.greatest(F.lit(0.0), hours_between(F.col("created_at"), now))
    last = F.coalesce("last_accessed_at", "created_at")
    df = df.withColumns({
        "age_hours": F.coalesce(age, F.lit(0.0)),
        "__last": F.greatest(F.lit(0.0), hours_between(last, now))})
    df = df.withColumn("last_access_hours", F.coalesce("__last", "age_hours"))
    df = with_rounded(
        df,
        age_score=F.when(F.col("created_at").isNull(), 0.5).otherwise(_decay(F.col("age_hours"), 1440)),
        access_score=F.when(F.col("__last").isNull(), 0.5).otherwise(_decay(F.col("__last"), 504)))
    return with_rounded(df, freshness=F.col("age_score") * 0.35 + F.col("access_score") * 0.65).drop("__last")


def _importance() -> Column:
    return F.coalesce("importance", F.lit(0.5))


def stale_mask(config: LifecycleConfig = DEFAULTS) -> Column:
    """Unused for long and unimportant; confident facts get twice the time."""
    hours = F.lit(config.stale_access_days * 24.0)
    firm = (F.col("memory_type") == "factual") & (F.coalesce("confidence", F.lit(0.0)) >= 0.75)
    limit = F.when(firm, hours * 2).otherwise(hours)
    return (F.col("last_access_hours") >= limit) & (_importance() < config.stale_importance_min)


def archive_mask(config: LifecycleConfig = DEFAULTS) -> Column:
    return (F.col("lifecycle_state").isin("stale", "conflicted")
            & (F.col("last_access_hours") >= config.archive_access_days * 24.0)
            & (_importance() < config.archive_importance_max))


def transition(df: DataFrame, as_of, config: LifecycleConfig = DEFAULTS) -> DataFrame:
    """Add ``next_state`` by age and use."""
    df = df.withColumn("lifecycle_state", F.coalesce("lifecycle_state", F.lit("active")))
    state = F.col("lifecycle_state")
    following = (F.when(state == "archived", "archived")
                 .when(state.isin("stale", "conflicted"),
                       F.when(archive_mask(config), "archived").otherwise(state))
                 .when(stale_mask(config), "stale").otherwise("active"))
    return lifecycle_signals(df, as_of).withColumn("next_state", following)


def _stamp(df: DataFrame, state: str, tier: Column, as_of) -> DataFrame:
    return df.withColumns({"lifecycle_state": F.lit(state), "tier": tier,
                           "updated_at": as_timestamp(as_of)})


def _chosen(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def mark_stale(df: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    return _stamp(_chosen(df, ids), "stale", F.lit("warm"), as_of)


def archive(df: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    return _stamp(_chosen(df, ids), "archived", F.lit("cold"), as_of)


def mark_conflicted(df: DataFrame, conflicts: DataFrame, as_of) -> DataFrame:
    """Stamp rows with the records of ``conflicts (id, conflicts)``.

    Stored records are kept unless a new one names the same memory.
    """
    fresh = conflicts.select("id", F.col("conflicts").alias("__new"))
    joined = df.join(fresh, "id")
    kind = dict(joined.dtypes)["__new"]
    old = F.coalesce(F.col("conflicts"), F.array().cast(kind)) if "conflicts" in df.columns \
        else F.array().cast(kind)
    replaced = F.transform(old, lambda c: F.coalesce(
        F.get(F.filter("__new", lambda n: n["conflicting_id"] == c["conflicting_id"]), F.lit(0)), c))
    known = F.transform(old, lambda c: c["conflicting_id"])
    added = F.filter("__new", lambda n: ~F.array_contains(known, n["conflicting_id"]))
    return _stamp(joined.withColumn("conflicts", F.concat(replaced, added)).drop("__new"),
                  "conflicted", F.lit("warm"), as_of)


def mark_conflict_counts(df: DataFrame, counts: DataFrame, as_of) -> DataFrame:
    """Stamp rows with the totals of ``counts (id, conflict_count)``, as :func:`conflict_counts` gives them.

    Copies that contradict copies need no record for each pair of them;
    :func:`factored_conflicts` holds the links themselves.
    """
    return _stamp(df.join(counts, "id"), "conflicted", F.lit("warm"), as_of)


def revive(df: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Back to active, conflicts cleared, tier recomputed."""
    out = _stamp(_chosen(df, ids), "active", tier_of(as_of), as_of)
    if "conflicts" in df.columns:
        out = out.withColumn("conflicts", F.array().cast(dict(df.dtypes)["conflicts"]))
    return out


# -- contradictions -------------------------------------------------------------

def conflict_topics(norm: Column) -> Column:
    """Topics a normalized text makes a claim about."""
    return F.array_compact(F.array(*[
        F.when(matches(norm, pattern), F.lit(topic)) for topic, pattern in lx.CONFLICT_TOPICS]))


def claim_id() -> Column:
    """256-bit name of a user's statement."""
    return F.sha2(F.to_json(F.struct("user_id", F.coalesce("memory_type", F.lit("")).alias("t"),
                                     F.coalesce("category", F.lit("")).alias("c"), "content")), 256)


def _claims(df: DataFrame) -> DataFrame:
    """Distinct statements of a user: copies of a text share one row."""
    keys = ["user_id", "memory_type", "category", "content"]
    claims = df.select(*keys).distinct()
    claims = claims.withColumns({
        "claim": claim_id(),
        "norm": normalize_text(F.col("content")), "words": conflict_tokens(F.col("content"))})
    return claims.withColumns({
        "tokens": F.array_distinct(tokenize(F.col("norm"))), "topics": conflict_topics(F.col("norm"))})


def with_category(df: DataFrame) -> DataFrame:
    return df if "category" in df.columns else df.withColumn("category", F.lit(None).cast("string"))


def _types_fit(a: str, b: str) -> Column:
    """May a row of type ``a`` be contradicted by one of type ``b``?"""
    left, right = F.col(a), F.col(b)
    known = left.isin("factual", "episodic", "semantic") & right.isNotNull()
    return ~F.coalesce(known, F.lit(False)) | (left == right) | (
        (left == "semantic") & (right == "factual"))


def _block_pairs(left: DataFrame, right: DataFrame, keys: str, lowest: float, few: str) -> DataFrame:
    """Claim pairs of one user that share an entry of the array column ``keys``.

    A pair sharing several entries is produced once, at its first shared entry.
    The side ``few`` (``a`` is left) has few claims: it is written with its keys
    first, so that Spark knows its size and can leave the other side, a row for
    each key of every claim, where it is.
    """
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))

    def keyed(side: DataFrame) -> DataFrame:
        slim = side.select("user_id", "claim", "memory_type", "category",
                           hashed("tokens").alias("tokens"), hashed(keys).alias("keys"))
        return slim.withColumn("key", F.explode("keys"))

    sides = {"a": keyed(left), "b": keyed(right)}
    sides[few] = materialize(sides[few], "claim-keys")
    a, b = sides["a"].alias("a"), sides["b"].alias("b")
    categories = F.coalesce(F.col("a.category") == F.col("b.category"), F.lit(True))
    shared = F.size(F.array_intersect("a.tokens", "b.tokens"))
    union = F.size("a.tokens") + F.size("b.tokens") - shared
    # outside the band whatever the character part adds
    short = (F.size("a.tokens") < 3) | (F.size("b.tokens") < 3)
    small, large = F.least(F.size("a.tokens"), F.size("b.tokens")), F.greatest(
        F.size("a.tokens"), F.size("b.tokens"))
    reachable = short | ((small >= large * (lowest - 0.005)) & (shared >= union * (lowest - 0.005)))
    condition = (
        (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.claim") != F.col("b.claim")) & categories
        & _types_fit("a.memory_type", "b.memory_type")
        & (F.element_at(F.array_intersect("a.keys", "b.keys"), 1) == F.col("a.key")) & reachable)
    return a.join(b, condition).select(
        F.col("a.user_id").alias("user_id"), F.col("a.claim").alias("claim"),
        F.col("b.claim").alias("other_claim"))


def _overlapping_pairs(claims: DataFrame, lowest: float) -> DataFrame:
    """Pairs of claims of three tokens or more that share a content word and enough tokens for the band.

    Tokens of a claim are ordered by how rare they are among the user's claims.
    A pair with a token overlap of ``j`` shares one of the first
    ``n - ceil(j n) + 1`` tokens of either, so the most frequent tokens open no
    block; of what meets, the places of the first shared token and the parities of
    both token sets bound the overlap before any tokens are compared.
    Token counts and ordered claims are written before they are joined, so that
    Spark can split the rows of a frequent token.
    """
    j = lowest - 0.005
    keep = ["user_id", "claim", "memory_type", "category", "words"]
    each = claims.select("user_id", "claim", F.explode("tokens").alias("token"))
    counts = materialize(each.groupBy("user_id", "token").agg(F.count("*").alias("f")), "claim-token-counts")
    ordered = each.join(counts, ["user_id", "token"]).groupBy("claim").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("f", "token"))), lambda e: F.xxhash64(e["token"])).alias("tokens"))
    sides = claims.select(*keep).join(ordered, "claim").withColumns({
        "n": F.size("tokens"), "words": F.transform("words", lambda w: F.xxhash64(w))})
    sides = sides.withColumn("prefix", F.expr(f"slice(tokens, 1, n - int(ceil({j} * n - 1e-9)) + 1)"))
    sides = materialize(sides.withColumn("parity", token_parities("tokens")), "claim-prefixes")
    keyed = sides.select("*", F.posexplode("prefix").alias("spot", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    shared = F.size(F.array_intersect("a.tokens", "b.tokens"))
    ahead = F.lit(1) + F.least(F.col("a.n") - F.col("a.spot"), F.col("b.n") - F.col("b.spot")) - 1
    both = F.col("a.n") + F.col("b.n")
    condition = (
        (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.claim") != F.col("b.claim"))
        & F.coalesce(F.col("a.category") == F.col("b.category"), F.lit(True)) & _types_fit("a.memory_type", "b.memory_type")
        & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * j)
        & (ahead >= both * (j / (1 + j)) - 1e-9)
        & (both - tokens_apart("a.parity", "b.parity") >= both * (2 * j / (1 + j)) - 1e-9)
        & (F.element_at(F.array_intersect("a.prefix", "b.prefix"), 1) == F.col("a.key"))
        & (shared >= (F.col("a.n") + F.col("b.n") - shared) * j) & F.arrays_overlap("a.words", "b.words"))
    return a.join(b, condition).select(
        F.col("a.user_id").alias("user_id"), F.col("a.claim").alias("claim"), F.col("b.claim").alias("other_claim"))


def worded_candidates(df: DataFrame, config: LifecycleConfig = DEFAULTS, claims: DataFrame | None = None) -> DataFrame:
    """The pairs of :func:`conflict_candidates` that share a content word."""
    lowest = config.conflict_similarity
    claims = materialize(_claims(with_category(df)), "claims") if claims is None else claims
    worded = claims.where(F.size("words") > 0)
    long_, short = worded.where(F.size("tokens") >= 3), worded.where(F.size("tokens") < 3)
    return _overlapping_pairs(long_, lowest).unionByName(_block_pairs(short, worded, "words", lowest, "a")).unionByName(
        _block_pairs(long_, short, "words", lowest, "b"))


def conflict_candidates(df: DataFrame, config: LifecycleConfig = DEFAULTS,
                        claims: DataFrame | None = None) -> DataFrame:
    """Pairs of claims worth comparing: ``user_id, claim, other_claim``.

    Same user, fitting types, equal category where both have one, a shared
    content word and, from three tokens on, the overlap that the band needs.  A claim without content words is compared with every other
    one in the definition; only partners sharing a token or a run of
    characters can reach the similarity band, so those are found through
    tokens and character trigrams instead of a cross join.
    """
    lowest = config.conflict_similarity
    if lowest < 0.21:
        raise ValueError("trigram blocking needs a similarity band that starts at 0.21 or above")
    claims = materialize(_claims(with_category(df)), "claims") if claims is None else claims
    pairs = worded_candidates(df, config, claims)
    wordless = claims.where(F.size("words") == 0)
    users = materialize(wordless.select("user_id").distinct(), "wordless-users")
    peers = claims.join(users, "user_id", "left_semi")

    def with_grams(side: DataFrame) -> DataFrame:
        spots = F.sequence(F.lit(1), F.greatest(F.length("norm") - 2, F.lit(1)))
        grams = F.transform(spots, lambda i: F.concat(F.lit("#"), F.substring(F.col("norm"), i, F.lit(3))))
        small = F.transform(F.sequence(F.lit(1), F.greatest(F.length("norm"), F.lit(1))),
                            lambda i: F.concat(F.lit("##"), F.substring(F.col("norm"), i, F.lit(1))))
        # texts of at most five characters also meet on single characters
        return side.withColumn("grams", F.array_distinct(F.concat(
            F.col("tokens"), grams,
            F.when(F.length("norm") <= 5, small).otherwise(F.array().cast("array<string>")))))

    one_way = _block_pairs(with_grams(wordless), with_grams(peers), "grams", lowest, "a")
    other_way = _block_pairs(with_grams(peers.where(F.size("words") > 0)), with_grams(wordless),
                             "grams", lowest, "b")
    return pairs.unionByName(one_way).unionByName(other_way)


def claim_conflicts(df: DataFrame, config: LifecycleConfig = DEFAULTS) -> DataFrame:
    """Claim pairs in the similarity band, with similarity and shared topics.

    Claims and scored pairs are written once; everything that follows reads them.
    """
    claims = materialize(_claims(with_category(df)), "claims")
    pairs = conflict_candidates(df, config, claims)
    for side, key in (("a", "claim"), ("b", "other_claim")):
        pairs = pairs.join(claims.select(
            F.col("claim").alias(key), F.col("norm").alias(f"norm_{side}"),
            F.col("tokens").alias(f"tokens_{side}"), F.col("topics").alias(f"topics_{side}")), key)
    scored = with_similarity(pairs, "norm_a", "norm_b", "tokens_a", "tokens_b")
    scored = scored.where((F.col("similarity") < config.duplicate_similarity)
                          & (F.col("similarity") >= config.conflict_similarity))
    shared = F.filter("topics_a", lambda t: F.array_contains(F.col("topics_b"), t))
    scored = scored.withColumn("shared_topics", shared)
    scored = scored.withColumn("topic_match", (F.size("shared_topics") > 0) & (F.col("similarity") < 0.88))
    scored = with_rounded(scored, band=(F.col("similarity") - 0.35) / F.lit(0.88 - 0.35))
    return materialize(scored.select("user_id", "claim", "other_claim", "similarity", "shared_topics",
                                     "topic_match", "band"), "claim-pairs")


def _conflict_score(best_confidence: Column, times_differ: Column) -> Column:
    return (F.when(F.col("topic_match"), 0.5).otherwise(0.0) + F.col("band") * 0.25
            + best_confidence * 0.15 + F.when(times_differ, 0.10).otherwise(0.0))


def _members(df: DataFrame) -> DataFrame:
    return with_category(df).select(
        "id", "user_id", claim_id().alias("claim"),
        F.coalesce("confidence", F.lit(0.5)).alias("conf"),
        F.coalesce("confidence", F.lit(0.0)).alias("conf0"), F.col("created_at").alias("at"))


def conflict_records(pairs: DataFrame, df: DataFrame, others: DataFrame, as_of,
                     config: LifecycleConfig = DEFAULTS) -> DataFrame:
    """Records ``(id, conflicting_id, similarity, confidence, reason, prefer_other)``.

    One record per contradicting pair of memories, which is the result itself;
    use :func:`conflict_counts` where only totals are needed, or pass the rows
    of interest as ``df``.
    """
    mine = _members(df).alias("m")
    peer = _members(others).alias("p")
    rows = (pairs.alias("c").join(mine, F.col("m.claim") == F.col("c.claim"))
            .join(peer, F.col("p.claim") == F.col("c.other_claim"))
            .where(F.col("m.id") != F.col("p.id")))
    differ = F.coalesce(F.col("m.at") != F.col("p.at"), F.lit(False))
    rows = with_rounded(
        rows.select("m.id", F.col("p.id").alias("conflicting_id"), "c.similarity", "c.topic_match",
                    "c.shared_topics", "c.band", F.greatest("m.conf", "p.conf").alias("best"),
                    differ.alias("differ"), F.col("m.conf0").alias("mc"), F.col("p.conf0").alias("pc"),
                    F.col("m.at").alias("mt"), F.col("p.at").alias("pt")),
        confidence=_conflict_score(F.col("best"), F.col("differ")))
    rows = rows.where(F.col("confidence") >= config.conflict_confidence_min)
    clear = F.abs(F.col("pc") - F.col("mc")) > 0.05
    epoch = F.lit("1970-01-01").cast("timestamp")
    prefer = F.when(clear, F.col("pc") > F.col("mc")).otherwise(
        F.coalesce("pt", epoch) >= F.coalesce("mt", epoch))
    shown = F.format_string("%.2f", F.col("similarity"))
    label = F.when(F.size("shared_topics") > 0, F.array_join("shared_topics", ", ")).otherwise(
        "overlapping content")
    reason = F.when(F.col("topic_match"), F.concat(
        F.lit("Conflicting "), label, F.lit(" claim detected (similarity "), shown, F.lit(")"))).otherwise(
        F.concat(F.lit("Potentially contradictory content on overlapping topic (similarity "),
                 shown, F.lit(")")))
    return rows.select("id", "conflicting_id", "similarity", "confidence", reason.alias("reason"),
                       prefer.alias("prefer_other"), as_timestamp(as_of).alias("detected_at"))


def factored_conflicts(df: DataFrame, config: LifecycleConfig = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(claim pairs in the band, ``claim, id`` of all members): every link without a row for each pair of copies."""
    return claim_conflicts(df, config), _members(df).select("claim", "id")


def detect_conflicts(df: DataFrame, as_of, config: LifecycleConfig = DEFAULTS) -> DataFrame:
    """All conflict records of a table."""
    return conflict_records(claim_conflicts(df, config), df, df, as_of, config)


def conflict_counts(df: DataFrame, config: LifecycleConfig = DEFAULTS) -> DataFrame:
    """``id, conflict_count`` of rows with conflicts, without listing pairs.

    Members of a claim are summarized by confidence (two decimals, so at most
    101 values); a pair of claims is settled on these histograms.  Only where
    the time bonus decides are members of equal time looked at, through an
    equi-join on the time.
    """
    members = _members(df)
    by_conf = members.groupBy("claim", "conf").agg(F.count("*").alias("n"))
    by_time = members.where(F.col("at").isNotNull()).groupBy("claim", "conf", "at").agg(
        F.count("*").alias("n"))
    timeless = members.where(F.col("at").isNull()).groupBy("claim", "conf").agg(
        F.count("*").alias("n_timeless"))
    pairs = claim_conflicts(df, config).select("claim", "other_claim", "topic_match", "band")
    a, b = by_conf.alias("a"), by_conf.alias("b")
    grid = (pairs.alias("c").join(a, F.col("a.claim") == F.col("c.claim"))
            .join(b, F.col("b.claim") == F.col("c.other_claim"))
            .select("c.claim", "c.other_claim", "c.topic_match", "c.band", F.col("a.conf").alias("conf"),
                    F.col("b.conf").alias("other_conf"), F.col("b.n").alias("n")))
    best = F.greatest("conf", "other_conf")
    grid = with_rounded(grid, apart=_conflict_score(best, F.lit(True)),
                        together=_conflict_score(best, F.lit(False)))
    limit = config.conflict_confidence_min
    grid = materialize(grid.where(F.col("apart") >= limit).withColumn("timed_only", F.col("together") < limit),
                       "conflict-grid")
    # every member of the other claim counts …
    full = grid.groupBy("claim", "conf").agg(F.sum("n").alias("n_all"))
    # … but where the time bonus decides, those of the same time or without one do not
    timed = grid.where("timed_only").select("claim", "other_claim", "conf", "other_conf")
    same = (timed.alias("g").join(by_time.alias("a"), (F.col("a.claim") == F.col("g.claim"))
                                  & (F.col("a.conf") == F.col("g.conf")))
            .join(by_time.alias("b"), (F.col("b.claim") == F.col("g.other_claim"))
                  & (F.col("b.conf") == F.col("g.other_conf")) & (F.col("a.at") == F.col("b.at")))
            .groupBy("g.claim", "g.conf", "a.at").agg(F.sum("b.n").alias("n_same")))
    missing = (timed.join(timeless.select(F.col("claim").alias("other_claim"),
                                          F.col("conf").alias("other_conf"), "n_timeless"),
                          ["other_claim", "other_conf"])
               .groupBy("claim", "conf").agg(F.sum("n_timeless").alias("n_missing")))
    untimed = (timed.join(by_conf.select(F.col("claim").alias("other_claim"),
                                         F.col("conf").alias("other_conf"), "n"),
                          ["other_claim", "other_conf"])
               .groupBy("claim", "conf").agg(F.sum("n").alias("n_timed_only")))
    out = (members.join(full, ["claim", "conf"])
           .join(same, ["claim", "conf", "at"], "left")
           .join(missing, ["claim", "conf"], "left").join(untimed, ["claim", "conf"], "left"))
    zero = F.lit(0).cast("bigint")
    dropped = F.when(F.col("at").isNull(), F.coalesce("n_timed_only", zero)).otherwise(
        F.coalesce("n_same", zero) + F.coalesce("n_missing", zero))
    return out.select("id", (F.col("n_all") - dropped).alias("conflict_count")).where(
        F.col("conflict_count") > 0)


# -- sweep ------------------------------------------------------------------------

def lifecycle_sweep(df: DataFrame, as_of, config: LifecycleConfig = DEFAULTS) -> DataFrame:
    """State changes of one sweep: ``id, user_id, from_state, to_state, tier, conflict_count``.

    Every row is compared with the table as it stood before the sweep.
    """
    moved = transition(df, as_of, config)
    counts = conflict_counts(df, config)
    aged = moved.join(counts, "id", "left")
    open_row = ~F.col("next_state").isin("archived", "conflicted")
    clashes = open_row & (F.coalesce("conflict_count", F.lit(0)) > 0)
    final = F.when(clashes, "conflicted").otherwise(F.col("next_state"))
    out = aged.select("id", "user_id", F.col("lifecycle_state").alias("from_state"),
                      final.alias("to_state"),
                      F.when(clashes, F.col("conflict_count")).otherwise(0).alias("conflict_count"))
    tier = F.when(F.col("to_state") == "archived", "cold").otherwise("warm")
    return out.where(F.col("from_state") != F.col("to_state")).withColumn("tier", tier)


def apply_sweep(df: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """The table after a sweep."""
    new = changes.select("id", "to_state", F.col("tier").alias("__tier"))
    joined = df.join(new, "id", "left")
    changed = F.col("to_state").isNotNull()
    tier = F.col("tier") if "tier" in df.columns else F.lit(None).cast("string")
    updated = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp")
    return joined.withColumns({
        "lifecycle_state": F.coalesce("to_state", "lifecycle_state"),
        "tier": F.coalesce(F.col("__tier"), tier),
        "updated_at": F.when(changed, as_timestamp(as_of)).otherwise(updated),
    }).drop("to_state", "__tier")


def fan_out_lifecycle(changes: DataFrame, targets: dict[str, DataFrame], as_of) -> dict[str, DataFrame]:
    """Apply the same state changes to several tables; one result per target."""
    return {name: apply_sweep(table, changes, as_of) for name, table in targets.items()}


def fan_out_report(changes: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Per target, how many changes found their row (``ok``) and how many did not."""
    report = None
    for name, table in targets.items():
        found = changes.select("id").join(
            table.select("id", F.lit(1).alias("hit")).dropDuplicates(["id"]), "id", "left")
        line = found.agg(F.count("hit").alias("ok"),
                         (F.count("*") - F.count("hit")).alias("skipped")).select(
            F.lit(name).alias("target"), "ok", "skipped")
        report = line if report is None else report.unionByName(line)
    return report
