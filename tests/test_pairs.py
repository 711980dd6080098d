"""Pair finding, merging and grouping against brute force, with skewed inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.config import ConsolidationConfig
from memlake.functions import text as tx
from memlake.operators import consolidate, dedup, graph, grouping, lifecycle, monitor, ordered
from memlake.operators.vector_search import nearest

NOW = "2024-06-01 00:00:00"
WORDS = ("redis mongo tea coffee plan sprint deploy api bug test travel mumbai paris alice bob music "
         "garden paint river stone cloud").split()


def random_texts(n, seed, low=2, high=7):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(low, high))) for _ in range(n)]


def memories(spark, rows):
    """rows: (id, user, type, content, confidence, importance, day)"""
    return spark.createDataFrame(
        [(i, f"s-{u}", u, t, c, c[:140], conf, imp, f"2024-05-{day:02d} 00:00:00") for i, u, t, c, conf, imp, day in rows],
        "id string, session_id string, user_id string, memory_type string, content string, summary string, "
        "confidence double, importance double, created_at string").withColumns({
            "created_at": F.col("created_at").cast("timestamp"),
            "last_accessed_at": F.lit(None).cast("timestamp"), "lifecycle_state": F.lit("active"),
            "domain": F.lit("general"), "tags": F.array(F.lit("t"))})


def similarity(a, b):
    return tx.pair_similarity(a, b, tx.distinct_tokens(a), tx.distinct_tokens(b))


@pytest.mark.parametrize("threshold", [0.92, 0.7, 0.5])
def test_near_dup_pairs_match_brute_force(spark, threshold):
    texts = random_texts(120, 7, 1, 8) + ["tea the coffee", "tea coffee", "a tea coffee", "the"]
    rows = [(f"m{i:03d}", "u1", t) for i, t in enumerate(texts)] + [("zcopy", "u1", texts[0])]
    df = spark.createDataFrame(rows, "id string, user_id string, content string")
    found = dedup.near_dup_pairs(df, ["user_id"], threshold).collect()
    reps = {}
    for i, _, t in rows:
        reps.setdefault(t, i)
    expected = {(reps[a], reps[b]) if reps[a] < reps[b] else (reps[b], reps[a])
                for a, b in itertools.combinations(reps, 2) if similarity(a, b) >= threshold}
    assert {(r.id_a, r.id_b) for r in found if r.kind == "similar"} == expected
    assert ("m000", "zcopy") in {(r.id_a, r.id_b) for r in found if r.kind == "copy"}
    assert sum(r.kind == "copy" for r in found) == len(rows) - len(reps)


@pytest.mark.parametrize("threshold", [0.915, 0.858, 0.845, 0.695])
def test_size_classes_hold_every_pair_over_the_threshold(threshold):
    starts, parts = dedup._size_classes(threshold, 600)
    of = lambda n: max(i for i, s in enumerate(starts) if s <= n)
    for small in range(1, 300):
        for large in range(small, int(small / threshold + 1e-9) + 1):
            shared = next(s for s in range(small + 1) if s / (small + large - s) >= threshold - 1e-9)
            assert of(large) - of(small) in (0, 1)
            assert small + large - 2 * shared < parts[of(small)]


def test_near_dup_sets_meet_by_parts_and_not_by_words(spark, monkeypatch):
    written, write = {}, dedup.materialize

    def counted(df, name):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(dedup, "materialize", counted)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    sets = [set(rng.sample(words, rng.randint(3, 120))) for _ in range(600)]
    for base in sets[:200]:  # near ones on both sides of the threshold, in the same and the next size class
        changed, moves = set(base), max(1, round(len(base) * rng.uniform(0.01, 0.12)))
        for _ in range(moves):
            kind = rng.randint(0, 2)
            if kind < 2 and len(changed) > 3:
                changed.discard(rng.choice(sorted(changed)))
            if kind > 0:
                changed.add(rng.choice(words))
        sets.append(changed)
    rows = [(i, "u", " ".join(rng.sample(sorted(s), len(s)))) for i, s in enumerate(sets)]
    found = dedup.near_dup_pairs(spark.createDataFrame(rows, "id long, user_id string, content string"), ["user_id"]).where("kind = 'similar'").collect()
    want = {(a, b): tx.round2_value(len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in itertools.combinations(range(len(sets)), 2)
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.9}
    assert len(want) > 100 and min(want.values()) < 0.92
    same = {(r.id_a, r.id_b): r.similarity for r in found}
    kept = {k: v for k, v in want.items() if v >= 0.92 and rows[k[0]][2] != rows[k[1]][2]}
    assert same == kept
    assert written["near-dup-met"] < 4 * len(want)  # of 319,600 pairs, most of which share a word


def test_merged_confidence_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [("hot", i, f"id{i:05d}", rng.randint(0, 100) / 100) for i in range(3000)]
    rows += [(f"k{i}", i, f"x{i}", rng.randint(0, 100) / 100) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, n int, id string, confidence double").withColumn(
        "created_at", F.timestamp_seconds(F.col("n")))
    got = {r.k: r.confidence for r in dedup.merged_confidence(df, ["k"]).collect()}
    expected = {}
    for k, _, _, c in rows:
        expected[k] = c if k not in expected else tx.round2_value(expected[k] * (2 / 3) + c * (1 / 3))
    assert got == expected


def test_copies_of_a_vector_are_searched_once(spark, monkeypatch):
    from memlake.operators import vector_search

    sizes, write = {}, vector_search.materialize

    def counted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(vector_search, "materialize", counted)
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    shape = "id string, user_id string, embedding array<float>"
    items = spark.createDataFrame([(f"m{i:03d}", "u", vectors[i % 3]) for i in range(300)], shape)
    queries = spark.createDataFrame([(f"q{i:03d}", "u", vectors[i % 2]) for i in range(200)], shape)
    found = nearest(queries, items, 4, scope=["user_id"], query_id="id", block_items=5, block_queries=1).collect()
    assert sizes["search-items"] == 3 * 4 and sizes["search-query-vectors"] == 2
    # the smallest ids of the query's own vector, which has 100 copies
    expected = {(f"q{i:03d}", f"m{3 * r + i % 2:03d}", 1.0, r + 1) for i in range(200) for r in range(4)}
    assert {tuple(r) for r in found} == expected and len(found) == 800


def test_nearest_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(5)
    items = [(f"m{i:03d}", "hot" if i % 3 else f"u{i % 5}", rng.normal(size=8).round(3).tolist()) for i in range(300)]
    items += [("dup1", "hot", items[1][2]), ("short", "hot", [1.0, 2.0]), ("zero", "hot", [0.0] * 8)]
    queries = [(f"q{i}", "hot", rng.normal(size=8).round(3).tolist()) for i in range(20)] + [("qd", "hot", items[1][2])]
    m = spark.createDataFrame(items, "id string, user_id string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id string, user_id string, embedding array<double>")
    plain = nearest(q, m, 5, scope=["user_id"]).collect()
    split = nearest(q, m, 5, scope=["user_id"], block_items=17, block_queries=4).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, split))
    best = {r.query_id: r for r in plain if r["rank"] == 1}
    assert best["qd"].item_id == "dup1" and best["qd"].cosine == 1.0
    for name, user, vector in queries[:5]:
        sims = sorted(((-np.dot(vector, v) / np.linalg.norm(vector) / np.linalg.norm(v), i) for i, u, v in items
                       if u == "hot" and len(v) == 8 and any(v)))[:5]
        assert [r.item_id for r in sorted(plain, key=lambda r: r["rank"]) if r.query_id == name] == [i for _, i in sims]


def conflict_rows(seed=11, n=90):
    rng = random.Random(seed)
    openers = ["I live in {}", "We use {} for our backend", "I prefer {} tea", "go to {}", "is it {}", "it {}"]
    rows = []
    for i in range(n):
        text = rng.choice(openers).format(rng.choice(["mumbai", "paris", "redis", "mongo", "ox", "it", "up"]))
        rows.append((f"m{i:03d}", rng.choice(["u1", "u1", "u2"]), rng.choice(["factual", "semantic", "episodic"]),
                     text, rng.randint(40, 95) / 100, rng.randint(0, 90) / 100, rng.randint(1, 4)))
    return rows


def brute_conflicts(spark, rows):
    df = memories(spark, rows)
    info = {r.id: r for r in df.select(
        "*", tx.normalize_text(F.col("content")).alias("norm"), tx.conflict_tokens(F.col("content")).alias("words"),
        lifecycle.conflict_topics(tx.normalize_text(F.col("content"))).alias("topics")).collect()}
    out = {}
    for a, b in itertools.permutations(info.values(), 2):
        fits = a.memory_type == b.memory_type or (a.memory_type, b.memory_type) == ("semantic", "factual")
        if a.user_id != b.user_id or not fits:
            continue
        if a.words and b.words and not set(a.words) & set(b.words):
            continue
        sim = similarity(a.norm, b.norm)
        if not 0.25 <= sim < 0.92:
            continue
        match = bool(set(a.topics) & set(b.topics)) and sim < 0.88
        score = (0.5 if match else 0.0) + tx.round2_value(min(1, max(0, (sim - 0.35) / (0.88 - 0.35)))) * 0.25
        score += max(a.confidence, b.confidence) * 0.15 + (0.10 if a.created_at != b.created_at else 0.0)
        if tx.round2_value(min(1, score)) >= 0.5:
            out.setdefault(a.id, set()).add(b.id)
    return df, out


def test_conflicts_match_brute_force(spark):
    df, expected = brute_conflicts(spark, conflict_rows())
    got = {}
    for r in lifecycle.detect_conflicts(df, NOW).collect():
        got.setdefault(r.id, set()).add(r.conflicting_id)
    assert got == expected and expected
    counts = {r.id: r.conflict_count for r in lifecycle.conflict_counts(df).collect()}
    assert counts == {k: len(v) for k, v in expected.items()}


def test_location_conflict_and_sweep_fixpoint(spark):
    df = memories(spark, [
        ("a", "u", "factual", "I live in Mumbai.", 0.8, 0.6, 1), ("b", "u", "factual", "I live in Bangalore.", 0.8, 0.6, 2),
        ("c", "u", "factual", "I live in Mumbai!", 0.8, 0.6, 1), ("d", "u", "episodic", "Completely unrelated remark", 0.5, 0.1, 3)])
    changes = lifecycle.lifecycle_sweep(df, "2024-06-20 00:00:00")
    got = {r.id: (r.to_state, r.conflict_count) for r in changes.collect()}
    assert got == {"a": ("conflicted", 1), "b": ("conflicted", 2), "c": ("conflicted", 1), "d": ("stale", 0)}
    after = lifecycle.apply_sweep(df, changes, NOW)
    assert lifecycle.lifecycle_sweep(after, "2024-06-20 00:00:00").count() == 0
    records = lifecycle.detect_conflicts(df, NOW).where("id = 'a'").collect()
    assert records[0].reason.startswith("Conflicting location claim") and records[0].prefer_other


def naive_groups(rows, cap):
    """All pairs in order, union unless the cap is exceeded."""
    tokens = [set(t) for t in rows]
    group = {i: {i} for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if tokens[i] & tokens[j] and group[i] is not group[j] and len(group[i]) + len(group[j]) <= cap:
                merged = group[i] | group[j]
                for m in merged:
                    group[m] = merged
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("seed", range(6))
def test_greedy_groups_match_all_pairs(seed):
    rows = [set(t.split()) for t in random_texts(60, seed, 1, 3)]
    heads = grouping.greedy_groups([sorted(r) for r in rows], 6)
    got = {}
    for i, h in enumerate(heads):
        got.setdefault(h, set()).add(i)
    assert {frozenset(g) for g in got.values()} == naive_groups(rows, 6)


@pytest.mark.parametrize("window_rows, ahead", [(1, 5), (7, 5), (20, 16), (500, None)])
def test_groups_do_not_depend_on_windows(spark, window_rows, ahead):
    """Two words are in half of the rows each, so groups fill across windows; two buckets end at different rounds."""
    texts = [t + (" common" if i % 2 else " usual") for i, t in enumerate(random_texts(45, 9, 1, 2))]
    rows = [("b", i + 1, sorted(set(t.split()))) for i, t in enumerate(texts)] + [
        ("c", i + 1, [f"w{i % 5}"]) for i in range(12)] + [("d", 1, [])]
    df = spark.createDataFrame(rows, "bucket string, position long, words array<string>")
    got = {}
    for r in grouping.token_groups(df, 4, window_rows, ahead).collect():
        got.setdefault((r.bucket, r.head), set()).add(r.position - 1)
    for bucket in "bcd":
        own = [set(w) for b, _, w in rows if b == bucket]
        assert {frozenset(g) for (b, _), g in got.items() if b == bucket} == naive_groups(own, 4)


def test_groups_do_not_depend_on_partitions(spark):
    rows = [(f"m{i:03d}", "u", "semantic", f"shared word{i}", 0.5, i / 1000, 1) for i in range(200)]
    found = []
    for partitions, window_rows in ((4, 50), (7, 64), (7, 50_000)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        out = consolidate.group_candidates(memories(spark, rows), ConsolidationConfig(window_rows=window_rows)).collect()
        found.append({r.id: r.group_id for r in out})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    order = [f"m{i:03d}" for i in range(199, -1, -1)]  # importance falls with the number
    assert found[0] == found[1] == found[2] == {m: order[i - i % 20] for i, m in enumerate(order)}


def test_positions_of_a_key_over_many_ranges(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 5 else f"k{i % 3}", (i * 37) % 400) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v long")
    want = {}
    for k in {k for k, _ in rows}:
        for at, v in enumerate(sorted(v for x, v in rows if x == k), 1):
            want[(k, v)] = (at, sum(w for x, w in rows if x == k and w <= v))
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    placed = ordered.with_position(df, ["k"], ["v"]).collect()
    summed = ordered.with_running(df, ["k"], ["v"], total=F.col("v")).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {(r.k, r.v): r.position for r in placed} == {x: p for x, (p, _) in want.items()}
    assert {(r.k, r.v): r.total for r in summed} == {x: t for x, (_, t) in want.items()}


def test_conflict_candidates_equal_all_pairs(spark):
    """A word that all claims have, claims of one to eight words, copies and two users."""
    texts = [t + " service" for t in random_texts(70, 21, 0, 7)] + random_texts(20, 22, 1, 2)
    rows = [(f"m{i:03d}", f"u{i % 5 // 4}", ("semantic", "factual")[i % 7 == 0], t, 0.5, 0.5, 1) for i, t in enumerate(texts + texts[:9])]
    df = memories(spark, rows)
    claims = {r.claim: r for r in lifecycle._claims(lifecycle.with_category(df)).collect()}
    fits = lambda a, b: a == b or (a, b) == ("semantic", "factual")
    want = set()
    for a, b in itertools.permutations(claims.values(), 2):
        x, y = set(a.tokens), set(b.tokens)
        if a.user_id == b.user_id and fits(a.memory_type, b.memory_type) and set(a.words) & set(b.words) and (
                min(len(x), len(y)) < 3 or len(x & y) >= 0.245 * len(x | y)):
            want.add((a.user_id, a.claim, b.claim))
    found = [tuple(r) for r in lifecycle.conflict_candidates(df).collect()]
    assert sorted(found) == sorted(want) and len(want) > 200


def test_few_claims_without_words_leave_the_others_in_place(spark):
    texts = [*random_texts(600, 8, 5, 9), "the then", "of that ha the is nt of on an"]
    df = memories(spark, [(f"m{i}", "u", "factual", t, 0.5, 0.5, 1) for i, t in enumerate(texts)])
    claims = lifecycle.materialize(lifecycle._claims(lifecycle.with_category(df)), "claims")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16384")
    try:
        pairs = lifecycle.conflict_candidates(df, claims=claims)
        plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # only statements of three tokens or more meet each other through a shuffle
        assert plan.count("SortMergeJoin") == 1, plan
        assert pairs.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_one_user_with_many_claims_that_share_a_word(spark):
    rng = random.Random(5)
    word = lambda: f"word{rng.randrange(20_000)}"
    texts = ["service " + " ".join(word() for _ in range(6)) for _ in range(15_000)]
    pairs = [(f"{t} first", f"{t} second") for t in texts[:40]]
    texts = texts[40:] + [t for p in pairs for t in p]
    df = memories(spark, [(f"m{i}", "u", "semantic", t, 0.5, 0.5, 1) for i, t in enumerate(texts)])
    name = {r.content: r.claim for r in lifecycle.with_category(df).select("content", lifecycle.claim_id().alias("claim")).collect()}
    found = {(r.claim, r.other_claim) for r in lifecycle.conflict_candidates(df).collect()}
    assert all((name[a], name[b]) in found and (name[b], name[a]) in found for a, b in pairs)
    assert len(found) < 15_000  # of 225 million ordered pairs that share the word


def test_domain_links_hold_every_pair(spark):
    rows = [(f"m{i}", None if i % 11 == 0 else f"d{i % 3}") for i in range(40)] + [("lone", "alone")]
    links = graph.domain_links(spark.createDataFrame(rows, "id string, domain string"))
    want = {(a, b) for (a, x), (b, y) in itertools.product(rows, rows) if a != b and x is not None and x == y}
    ids = spark.createDataFrame([(i,) for i, _ in rows], "id string")
    assert {tuple(r) for r in graph.expand_domains(links, ids).collect()} == want
    assert {r.id: r.links for r in links.collect()} == {i: sum(a == i for a, _ in want) for i, x in rows if x is not None}


def test_domain_links_in_blocks_take_little_disk(spark, tmp_path):
    rows = [(f"m{i}", f"d{i % 3}") for i in range(60)] + [("m1", "d5"), ("lone", "alone")]
    links = graph.domain_links(spark.createDataFrame(rows, "id string, domain string"))
    asked = [i for i, _ in rows[::4]] + ["m1", "lone", "none"]
    want = sorted((a, b) for (a, x), (b, y) in itertools.product(rows, rows) if a != b and x == y and a in asked)
    ids = spark.createDataFrame([(i,) for i in asked], "id string")
    assert sorted(tuple(r) for r in graph.expand_domains(links, ids, block_ids=7, run_ids=3).collect()) == want
    assert graph.expand_domains(links, ids.where("id = 'none'")).count() == 0
    # one domain with more ids than a dictionary page of a Parquet file holds
    many = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("d").alias("domain"), (F.col("id") < 20).alias("saved"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of more than a few MB
    try:
        graph.expand_domains(graph.domain_links(many), many.where("saved")).write.parquet(f"{tmp_path}/links")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = spark.read.parquet(f"{tmp_path}/links")
    assert found.count() == found.distinct().count() == 20 * 19_999
    assert sum(f.stat().st_size for f in (tmp_path / "links").glob("*.parquet")) < 20 * 19_999 * 10


def test_summaries_of_one_long_session(spark):
    rows = [("s", "u", f"e{i:05d}", i, "assistant" if i % 2 else "user", f"t{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "session_id string, user_id string, event_id string, at long, role string, content string").withColumn(
        "created_at", F.timestamp_seconds("at"))
    got = {r.event_id: (r.assistant_turn, r.turns, r.transcript) for r in monitor.summary_batches(df, every=20).collect()}
    line = lambda i: ("Assistant: " if i % 2 else "User: ") + f"t{i}"
    assert got == {f"e{40 * n - 1:05d}": (20 * n, 40, "\n".join(line(i) for i in range(40 * n - 40, 40 * n))) for n in range(1, 23)}


def test_similar_memories_with_a_hot_signature(spark):
    keywords = {f"m{i:03d}": (["redis", "queue"] if i % 2 else ["redis", "queue", WORDS[i % 7]]) for i in range(40)}
    bridge = spark.createDataFrame([(i, "s", k) for i, ks in keywords.items() for k in ks], "id string, session_id string, keyword string")
    m = spark.createDataFrame([(i, (j * 7 % 11) / 10, "2024-01-01") for j, i in enumerate(keywords)],
                              "id string, importance double, created_at string")
    members, edges = graph.similar_by_keywords(bridge)
    got = {}
    for r in graph.similar_memories(members, edges, m, limit=3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour_id)
    importance = {r.id: r.importance for r in m.collect()}
    for i, ks in keywords.items():
        near = [o for o, os in keywords.items() if o != i and len(set(ks) & set(os)) >= 2]
        assert got[i] == sorted(near, key=lambda o: (-importance[o], o))[:3]


def test_a_scorer_sees_texts_without_tokens_and_bytes(spark, tmp_path):
    """Stop terms only, and letters of two bytes; the threshold is 0.3."""
    df = memories(spark, [("a", "u", "semantic", "the of and", 0.5, 0.5, 1), ("b", "u", "semantic", "the of an", 0.5, 0.5, 1)])
    score = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    found = dedup.near_dup_pairs(df, ["user_id"], 0.3, scorer=score, keys=lambda t: F.array(F.substring(t, 1, 4))).collect()
    assert [(r.id_a, r.id_b, r.kind) for r in found] == [("a", "b", "similar")]


def test_edits_are_counted_in_bytes(spark, monkeypatch):
    from memlake.plans import dedup_queries

    df = memories(spark, [("a", "u", "semantic", "begin äöüäöüäöü", 0.5, 0.5, 1), ("b", "u", "semantic", "begin xyzxyzxyz", 0.5, 0.5, 1),
                          ("c", "u", "semantic", "begin xyzxyzxyü", 0.5, 0.5, 1)])
    monkeypatch.setattr(dedup_queries.inputs, "stored", lambda *_: df)
    found = {(r.id_a, r.id_b): r.similarity for r in dedup_queries.u01_custom_scorer(spark, "").collect()}
    assert found == {("b", "c"): 0.8666}


def test_statements_without_content_words_are_no_l06_pairs(spark, monkeypatch):
    from memlake.plans import dedup_queries

    df = memories(spark, [("a", "u", "semantic", "At that.", 0.5, 0.5, 1), ("b", "u", "semantic", "Use redis at that.", 0.5, 0.5, 1),
                          ("c", "u", "semantic", "Use redis now.", 0.5, 0.5, 1)])
    monkeypatch.setattr(dedup_queries.inputs, "stored", lambda *_: df)
    found = {(r.content[-6:], r.other_content[-6:]) for r in dedup_queries.l06_conflict_candidates(spark, "").collect()}
    assert found == {(" that.", "s now."), ("s now.", " that.")}
    assert lifecycle.conflict_candidates(df).count() > 2


def test_parities_and_places_leave_few_pairs_to_check(spark, monkeypatch):
    """Sixty texts of 100 of the same 200 words share rare words in their prefixes; only one is a near copy."""
    rng = random.Random(3)
    pool = [f"word{i}" for i in range(200)]
    texts = [" ".join(rng.sample(pool, 100)) for _ in range(60)]
    texts.append(texts[0] + " extra")
    df = memories(spark, [(f"m{i:02d}", "u", "semantic", t, 0.5, 0.5, 1) for i, t in enumerate(texts)])
    met, plain = [], dedup.with_similarity

    def counted(pairs, *columns):
        met.append(pairs.count())
        return plain(pairs, *columns)

    monkeypatch.setattr(dedup, "with_similarity", counted)
    monkeypatch.setattr(dedup, "jaccard", lambda a, b: F.lit(1.0))  # leaves all that meet
    found = dedup.near_dup_pairs(df, ["user_id"], 0.85)
    assert {(r.id_a, r.id_b) for r in found.collect()} == {("m00", "m60")} and met[0] < 50


def test_marks_of_copies_need_no_record_for_each_pair(spark, monkeypatch):
    from memlake.plans import dedup_queries

    said = ["We use PostgreSQL for our backend database.", "We use MongoDB for our backend database."]
    df = memories(spark, [(f"m{i:03d}", "u", "semantic", said[i % 2], 0.5, 0.9, i % 3 + 1) for i in range(60)])
    records = lifecycle.detect_conflicts(df, dedup_queries.inputs.AS_OF).groupBy("id").count().collect()
    monkeypatch.setattr(dedup_queries.inputs, "stored", lambda *_: df)
    monkeypatch.delattr(lifecycle, "conflict_records")
    found = dedup_queries.l04_mark_conflicted(spark, "").collect()
    assert {(r.id, r.n_conflicts) for r in found} == {(r.id, r["count"]) for r in records} and len(found) == 60
