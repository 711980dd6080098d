"""Streams in several micro-batches against plain Python."""

import random

from pyspark.sql import functions as F

from memlake.operators import monitor
from memlake.plans.streaming_queries import run_to_end
from memlake.streaming import jobs, state


def in_files(spark, df, path, parts):
    """The rows of ``df`` in time order, one file per micro-batch."""
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/p={i}")
    schema = df.drop("part").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/p=*")


def test_every_request_over_the_limit_has_a_row(spark, tmp_path):
    """Many requests share a second, and seconds and windows are cut by micro-batches."""
    rng = random.Random(1)
    rows, clock = [], 1_700_000_000_000_000
    for n in range(600):
        clock += rng.choice([0, 0, 1_000, 300_000, 900_000, 9_000_000])
        rows.append((rng.choice(["hot", "hot", "hot", "c1", "c2"]), clock, n))
    expected, windows = [], {}
    for client, at, _ in rows:
        start, n = windows.get(client, (None, 0))
        if start is None or at >= start + 60_000_000:
            start, n = at, 0
        windows[client] = (start, n + 1)
        if n + 1 > 5:
            expected.append((client, at, n + 1))
    base = spark.createDataFrame(rows, "client_id string, at bigint, n int")
    for parts in (1, 4):
        df = base.select("client_id", F.timestamp_micros("at").alias("ts"), F.floor(F.col("n") * parts / 600).cast("int").alias("part"))
        stream = in_files(spark, df, str(tmp_path / f"in{parts}"), parts)
        got = run_to_end(state.rate_violations(stream, 5, 60)).select("client_id", F.unix_micros("ts"), "request_count").collect()
        assert sorted(map(tuple, got)) == sorted(expected)
    batch = monitor.rate_violations(df, 5, 60).select("client_id", F.unix_micros("ts"), "request_count").collect()
    assert sorted(map(tuple, batch)) == sorted(expected)


def test_session_state_counts_turns(spark, tmp_path):
    rows = [("s1", f"e{i:02d}", "user" if i % 2 == 0 else "assistant", f"please fix item number{i}", i, i // 5)
            for i in range(10)]
    df = spark.createDataFrame(rows, "session_id string, event_id string, role string, content string, n int, part int")
    df = df.select("session_id", "event_id", "role", "content", F.timestamp_seconds(F.col("n") * 60).alias("created_at"), "part")
    stream = in_files(spark, df, str(tmp_path / "in"), 2)
    seen = []
    query = state.session_state(stream, turns=4).writeStream.outputMode("update").option(
        "checkpointLocation", str(tmp_path / "cp")).foreachBatch(
        lambda batch, _: seen.extend(batch.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen[-1].assistant_turns == 5 and seen[-1].mode == "implementation"
    assert len(seen[-1].recent) == 4 and seen[-1].recent[-1] == "assistant: please fix item number9"
    assert seen[-1].current_topic == "please item number8"


def test_late_turns_do_not_turn_a_session_back(spark, tmp_path):
    rows = [("s1", "e5", "user", "please discuss newest thing", 1000, 0), ("s1", "e2", "user", "earlier matter entirely", 400, 1),
            ("s1", "e3", "assistant", "a reply between", 700, 1)]
    df = spark.createDataFrame(rows, "session_id string, event_id string, role string, content string, n int, part int")
    df = df.select("session_id", "event_id", "role", "content", F.timestamp_seconds("n").alias("created_at"), "part")
    out = run_to_end(state.session_state(in_files(spark, df, str(tmp_path / "in"), 2)), "update")
    row = max(out.collect(), key=lambda r: r.batch)
    assert row.last_activity_ms == 1_000_000 and row.current_topic == "please discuss newest thing" and row.assistant_turns == 1
    assert row.recent == ["user: earlier matter entirely", "assistant: a reply between", "user: please discuss newest thing"]


def test_only_completed_jobs_block_their_key(spark, tmp_path):
    day = 86_400
    rows = [("k1", 1, "timeout", 0, 0), ("k1", 2, None, 60, 1), ("k1", 3, None, 120, 1), ("k1", 4, None, 180, 2),
            ("k2", 1, None, 5, 0), ("k2", 2, None, 6, 1), ("k3", 1, "a", 7, 1), ("k3", 2, "b", 8, 2), ("k2", 3, None, 5 + 7 * day, 2)]
    df = spark.createDataFrame(rows, "idempotency_key string, attempt int, error_message string, n int, part int")
    df = df.select("idempotency_key", "attempt", "error_message", F.timestamp_seconds(F.col("n") + 1_700_000_000).alias("ts"), "part")
    got = run_to_end(jobs.drop_duplicate_jobs(in_files(spark, df, str(tmp_path / "in"), 3))).collect()
    assert {(r.idempotency_key, r.attempt) for r in got} == {("k1", 1), ("k1", 2), ("k2", 1), ("k2", 3), ("k3", 1), ("k3", 2)}


def test_sweeps_keep_numeric_looking_users_apart_in_several_batches(spark, tmp_path):
    from memlake.plans import inputs
    from memlake.sources import tables

    m = inputs.stored(spark, "/root/testdata/sf0.001").withColumn("user_id", F.concat(F.lit("00"), F.substr("user_id", F.lit(2))))
    table, facts = str(tmp_path / "memories"), str(tmp_path / "facts")
    tables.write_upsert(m, table, 4)
    for part in range(2):
        m.select("id", "user_id").coalesce(1).write.mode("append").parquet(str(tmp_path / f"new/p={part}"))
    stream = spark.readStream.schema("id string, user_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "new/p=*"))
    jobs.stream_sweeps(stream, table, facts, str(tmp_path / "cp"), inputs.AS_OF, buckets=4, available_now=True).awaitTermination()
    out = spark.read.parquet(facts).collect()
    assert out and len({r.id for r in out}) == len(out) and all(r.user_id.startswith("00") for r in out)


def test_repeated_batches_into_a_filled_table_change_nothing(spark, tmp_path):
    """A table of early memories, then two batches of later ones, with and without the first batch again at the end."""
    from memlake.plans import inputs
    from memlake.sources import corpus, tables

    sf_dir = "/root/testdata/sf0.001"
    rows = corpus.with_embeddings(spark, sf_dir, corpus.with_usage(inputs.candidates(spark, sf_dir)))
    day = F.dayofyear("created_at") % 3
    rows = spark.createDataFrame(rows.withColumn("part", day.cast("int")).collect(), rows.withColumn("part", day.cast("int")).schema)
    found = []
    for n, order in enumerate(([1, 2], [1, 2, 1])):
        table, source = str(tmp_path / f"table{n}"), str(tmp_path / f"in{n}")
        tables.write_upsert(rows.where("part = 0").drop("part"), table, 4)
        before = {(r.session_id, r.fingerprint) for r in spark.read.parquet(table).collect()}
        for i, part in enumerate(order):
            rows.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(f"{source}/p={i}")
        stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/p=*")
        jobs.stream_dedup_upsert(stream, table, str(tmp_path / f"cp{n}"), buckets=4, available_now=True).awaitTermination()
        kept = spark.read.parquet(table).select("session_id", "fingerprint", "id", "content", "importance").collect()
        assert before <= {(r.session_id, r.fingerprint) for r in kept} and len(kept) > len(before)
        found.append(sorted(map(tuple, kept)))
    assert found[0] == found[1]


def test_a_table_in_several_files_is_streamed_whole(spark, tmp_path):
    from memlake.plans import streaming_queries

    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    for source in (str(tmp_path), "/root/testdata/sf0.001"):
        rows = streaming_queries.x05_stream_session_state(spark, source).collect()
        assert {r.session_id for r in rows} == {f"s{i}" for i in range(20)}


def test_extraction_from_several_files_equals_a_single_file(spark, tmp_path):
    from memlake.plans import streaming_queries

    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    split, single = (sorted(map(tuple, streaming_queries.x01_stream_extract(spark, d).collect())) for d in (str(tmp_path), source))
    assert split == single and single


def test_keys_of_one_bucket_expire_apart_and_times_stay_exact(spark, tmp_path):
    day = 86_400_000_000
    rows = [(f"k{i}", 1, None, i * 7 + 1, 0) for i in range(40)] + [(f"k{i}", 2, None, 6 * day + i, 1) for i in range(40)] + [
        ("late", 1, None, 20 * day, 2)] + [(f"k{i}", 3, None, 20 * day + i, 3) for i in range(40)] + [(None, 1, None, 20 * day + 50, 3)]
    df = spark.createDataFrame(rows, "idempotency_key string, attempt int, error_message string, n long, part int")
    df = df.select("idempotency_key", "attempt", "error_message", F.timestamp_micros(F.col("n") + 1_700_000_000_000_000).alias("ts"), "part")
    failed = F.col("error_message").isNotNull()
    got = run_to_end(state.skip_completed(in_files(spark, df, str(tmp_path / "in"), 4), failed, "idempotency_key", "ts", 7, buckets=2))
    found = {(r.idempotency_key, r.attempt, r.at) for r in got.withColumn("at", F.unix_micros("ts")).collect()}
    assert found == {(k, a, n + 1_700_000_000_000_000) for k, a, _, n, _ in rows if a != 2}
