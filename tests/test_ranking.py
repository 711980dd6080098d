"""Ranking scenarios on a fixed set of ten memories, and lifecycle and monitoring cases."""

import random

import pytest
from pyspark.sql import functions as F

from memlake.config import HybridWeights, RetrievalConfig, TopicalPenalty
from memlake.operators import lifecycle, monitor, retrieval
from memlake.sources import tables

NOW = "2024-06-01 00:00:00"
MEMORIES = [
    ("mem-f1", "A", "factual", 0.75, 1), ("mem-f2", "A", "factual", 0.85, 48), ("mem-e1", "A", "episodic", 0.70, 2),
    ("mem-e2", "A", "episodic", 0.80, 24), ("mem-e3", "B", "episodic", 0.60, 8), ("mem-s1", "A", "semantic", 0.55, 200),
    ("mem-s2", "B", "semantic", 0.50, 120), ("mem-s3", "A", "semantic", 0.65, 96), ("mem-noise1", "B", "factual", 0.45, 72),
    ("mem-noise2", "B", "factual", 0.30, 300)]


@pytest.fixture
def ten(spark):
    df = spark.createDataFrame(MEMORIES, "id string, session_id string, memory_type string, importance double, hours int")
    return df.withColumns({
        "created_at": F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(0), F.col("hours")),
        "query_id": F.lit("q"), "query_session_id": F.lit("A"), "fingerprint": F.col("id"), "arrival": F.lit(0),
        "vector_score": F.lit(0.0), "lexical_score": F.lit(0)})


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def scored(df, **vectors):
    expr = F.lit(0.0)
    for name, value in vectors.items():
        expr = F.when(F.col("id") == name.replace("_", "-"), value).otherwise(expr)
    return df.withColumn("vector_score", expr)


def test_vector_match_leads_and_k_is_exact(ten):
    ranked = retrieval.rerank(scored(ten, mem_s1=0.95, mem_f1=0.2), NOW, 5)
    rows = ranked.orderBy("rank").collect()
    assert rows[0].id == "mem-s1" and len(rows) == 5
    assert all(a.score >= b.score for a, b in zip(rows, rows[1:]))
    assert len({r.id for r in rows}) == 5


def test_top_k_is_a_prefix_of_the_next(ten):
    df = scored(ten, mem_e3=0.5, mem_f2=0.4)
    assert ids(retrieval.rerank(df, NOW, 4)) == ids(retrieval.rerank(df, NOW, 5))[:4]


def test_same_fingerprint_keeps_the_most_important(ten):
    df = ten.withColumn("fingerprint", F.when(F.col("id").isin("mem-f1", "mem-f2"), "same").otherwise(F.col("id")))
    kept = ids(retrieval.rerank(df, NOW, 10))
    assert "mem-f2" in kept and "mem-f1" not in kept and len(kept) == 9


def test_off_topic_memory_does_not_win_with_the_penalty(ten):
    df = ten.where("id in ('mem-f2', 'mem-noise2')").withColumns({
        "vector_score": F.when(F.col("id") == "mem-noise2", 0.3).otherwise(0.02),
        "session_id": F.lit("A")})
    assert ids(retrieval.rerank(df, NOW)) == ["mem-f2", "mem-noise2"]
    on = RetrievalConfig(penalty=TopicalPenalty(enabled=True))
    assert ids(retrieval.rerank(df, NOW, config=on)) == ["mem-noise2", "mem-f2"]


def test_weights_are_clamped_and_reason_lists_sources(ten):
    df = scored(ten, mem_e1=0.9).withColumns({
        "keyword_score": F.lit(0.5), "graph_score": F.lit(0.0), "access_count": F.lit(100),
        "sources": F.array(F.lit("vector"), F.lit("keyword"))})
    ranked = retrieval.rank_memories(df, NOW, 3, weights=HybridWeights(vector=7.0, recency=-1.0))
    first = ranked.where("rank = 1").first()
    assert first.id == "mem-e1" and first.final_score == 1.0
    assert first.reason == ("Selected via vector+keyword — strong vector similarity, keyword match, high importance, recent")


def test_lifecycle_rerank(ten):
    df = ten.withColumns({
        "final_score": F.col("importance"), "reason": F.lit("r"), "rank": F.lit(1),
        "lifecycle_state": F.when(F.col("id") == "mem-f2", "archived").when(F.col("id") == "mem-e2", "stale")
        .when(F.col("id") == "mem-f1", "conflicted").otherwise("active")})
    out = retrieval.lifecycle_rerank(df)
    assert ids(out)[0] == "mem-e1" and "mem-f2" not in ids(out)
    stale = out.where("id = 'mem-e2'").first()
    assert abs(stale.final_score - 0.48) < 1e-9 and "stale penalty ×0.6" in stale.reason
    assert "mem-f2" in ids(retrieval.lifecycle_rerank(df, include_archived=True))


@pytest.mark.parametrize("days, importance, accessed, expected", [
    (7, 0.1, None, "hot"), (89, 0.1, None, "warm"), (90, 0.1, None, "warm"), (91, 0.39, None, "cold"),
    (91, 0.4, None, "warm"), (200, 0.1, 3, "hot"), (200, 0.7, None, "warm")])
def test_tiers(spark, days, importance, accessed, expected):
    df = spark.createDataFrame([(importance, days, accessed)], "importance double, d int, a int").select(
        "importance", (F.lit(NOW).cast("timestamp") - F.make_dt_interval("d")).alias("created_at"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval("a")).alias("last_accessed_at"))
    assert lifecycle.assign_tier(df, NOW).first().tier == expected


@pytest.mark.parametrize("name, code, status, message, expected", [
    (None, "ECONNRESET", None, "x", "transient"), (None, "ETIMEDOUT", None, "x", "transient"),
    (None, None, 429, "x", "transient"), (None, None, 500, "x", "transient"), (None, None, 503, "x", "transient"),
    (None, None, None, "Timeout waiting", "transient"), (None, None, None, "rate limit hit", "transient"),
    ("TypeError", None, None, "x", "permanent"), ("SyntaxError", None, None, "x", "permanent"),
    (None, None, 404, "x", "permanent"), (None, None, None, "hm", "unknown")])
def test_error_categories(spark, name, code, status, message, expected):
    df = spark.createDataFrame([(name, code, status, message)], "n string, c string, s int, m string")
    assert df.select(monitor.error_category(F.col("n"), F.col("c"), F.col("s"), F.col("m"))).first()[0] == expected


def test_summary_due_every_n_assistant_turns(spark):
    rows = [("s", "u", f"e{i:02d}", "assistant" if i % 2 else "user", f"text {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "session_id string, user_id string, event_id string, role string, content string")
    df = df.withColumn("created_at", F.timestamp_seconds(F.substring("event_id", 2, 2).cast("int")))
    due = monitor.summary_batches(df, every=3).orderBy("assistant_turn").collect()
    assert [(r.assistant_turn, r.turns) for r in due] == [(3, 6), (6, 12)]
    assert due[0].transcript.splitlines()[1] == "Assistant: text 1"


def test_purge_is_guarded(spark):
    df = spark.createDataFrame([("demo-1",), ("s1",)], "session_id string")
    assert [r.session_id for r in tables.purge_sessions(df, "demo-").collect()] == ["s1"]
    with pytest.raises(ValueError):
        tables.purge_sessions(df, "s")


def test_upsert_is_idempotent_and_keeps_greatest_importance(spark, tmp_path):
    old = spark.sql("select 'a' id, 's' session_id, 'f' fingerprint, 'e1' event_id, 'old' content, 'old' summary, "
                    "0.9D importance, timestamp'2024-01-01' created_at")
    new = spark.sql("select 'b' id, 's' session_id, 'f' fingerprint, 'e2' event_id, 'new' content, 'new' summary, "
                    "0.4D importance, timestamp'2024-02-01' created_at")
    path = str(tmp_path / "memories")
    for batch in (old, new, new):
        tables.write_upsert(batch, path, 4)
    rows = tables.read_memories(spark, path, "s", buckets=4).collect()
    assert rows == tables.read_memories(spark, path, "s").collect()
    assert len(rows) == 1 and (rows[0].id, rows[0].content, rows[0].importance, rows[0].event_id) == ("a", "new", 0.9, "e2")


def test_tiered_writes_merge_and_move(spark, tmp_path):
    def rows(*items):
        return spark.createDataFrame(items, "id string, importance double, created_at string, last_accessed_at string").withColumns(
            {c: F.col(c).cast("timestamp") for c in ("created_at", "last_accessed_at")})

    path, day = str(tmp_path / "tiers"), "2024-01-01"
    five = [(f"m{i}", 0.1 * i, day, day) for i in range(5)]
    tables.write_tiered(rows(*five), path, "2024-01-02", 4)
    tables.write_tiered(rows(("m9", 0.9, day, day), ("m9", 0.8, "2024-01-02", day)), path, "2024-01-02", 4)
    assert tables.read_all_tiers(spark, path).count() == 6 and {r.tier for r in tables.read_all_tiers(spark, path).collect()} == {"hot"}
    tables.write_tiered(rows(*five), path, "2024-09-01", 4)
    out = {r.id: r.tier for r in tables.read_all_tiers(spark, path).collect()}
    assert out == {"m0": "cold", "m1": "cold", "m2": "cold", "m3": "cold", "m4": "warm", "m9": "hot"}
    assert [r.importance for r in tables.read_all_tiers(spark, path).collect() if r.id == "m9"] == [0.8]
    tables.remove_tiered(spark, path, rows(("m9", None, None, None), ("m0", None, None, None)), 4)
    assert sorted(r.id for r in tables.read_all_tiers(spark, path).collect()) == ["m1", "m2", "m3", "m4"]


def test_access_times_do_not_move_back(spark):
    memories = spark.sql("select 'a' id, 3L access_count, timestamp'2024-05-01' last_accessed_at")
    hits = spark.sql("select 'a' memory_id, timestamp'2024-04-01' ts")
    row = tables.record_access(memories, hits).first()
    assert row.access_count == 4 and str(row.last_accessed_at).startswith("2024-05-01")


def test_scratch_folder_must_be_shared(spark):
    from memlake.session import scratch_dir

    class Bare:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError):
        scratch_dir(Bare, "x")
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_working_sets_carry_over_turns(spark):
    """Five channels over the turns of two sessions against a plain loop."""
    rng = random.Random(8)
    ids = [f"m{i:02d}" for i in range(14)]
    memory = {i: (f"f{n % 11}", round(rng.random(), 2), f"s{n % 2}") for n, i in enumerate(ids)}
    turns = [(f"s{s}-{t}", f"s{s}", "thanks" if (s, t) == (0, 3) else f"tell me about item {t}", t) for s in range(2) for t in range(7)]
    rows = {a: [] for a in (0, 2, 3, 4)}
    for q, session, *_ in turns:
        for arrival in rows:
            for i in rng.sample(ids, rng.randint(0, 3)):
                scores = (None, None) if arrival == 0 else (round(rng.random(), 2), float(rng.randint(0, 5)))
                rows[arrival].append((q, session, i, memory[i][2], memory[i][0], memory[i][1], *scores))
    schema = ("query_id string, query_session_id string, id string, session_id string, fingerprint string, importance double, "
              "vector_score double, lexical_score double")
    frames = {a: spark.createDataFrame(r, schema).withColumn("created_at", F.lit(NOW).cast("timestamp")) for a, r in rows.items()}
    queries = spark.createDataFrame(turns, "query_id string, session_id string, query_text string, t int").withColumn(
        "query_at", F.timestamp_seconds(F.col("t") * 60))
    got = {}
    for r in retrieval.carried_working_sets(queries.repartition(5), frames, NOW, 4).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, round(r.score, 6), r.arrival)

    held, want = {}, {}
    for q, session, text, _ in turns:
        if text == "thanks":
            held[session] = []
            continue
        mine = [(a, r) for a in rows for r in rows[a] if r[0] == q]
        latest = {}
        for a, r in sorted(mine, key=lambda x: x[0]):
            if r[6] is not None:
                latest[r[2]] = (r[6], r[7])

        def score(i, v, x):
            return min(1.0, v * 0.5 + min(1.0, x / 5) * 0.2 + memory[i][1] * 0.2 + 0.1 + (0.04 if memory[i][2] == session else 0))

        found = [(memory[i][0], -memory[i][1], 1, i, score(i, *latest[i]) if i in latest else old) for i, old in held.get(session, [])]
        found += [(r[4], -r[5], a, r[2], score(r[2], *latest.get(r[2], (0.0, 0.0)))) for a, r in mine]
        best = {}
        for r in sorted(found):
            best.setdefault(r[0], r)
        kept = sorted(best.values(), key=lambda r: (-r[4], r[2], r[3]))[:4]
        held[session] = [(r[3], r[4]) for r in kept]
        if kept:
            want[q] = {n: (r[3], round(r[4], 6), r[2]) for n, r in enumerate(kept, 1)}
    assert got == want and any(x[2] == 1 for r in want.values() for x in r.values())
