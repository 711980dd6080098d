"""Reading and writing event logs, memory tables and consolidated facts.

Tables are parquet folders.  Updates rewrite only the partitions they touch
(dynamic partition overwrite); a rewrite of data that is being read goes
through the shared scratch folder first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.lifecycle import tier_of
from memlake.session import materialize

EVENT_SCHEMA = ("event_id string, session_id string, user_id string, role string, content string, "
                "created_at timestamp")
TABLE_BUCKETS = 64


# -- events ----------------------------------------------------------------------

def read_events(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The event log in time order; with ``limit`` only the latest events."""
    events = spark.read.parquet(path)
    if limit is None:
        return events.orderBy("created_at", "event_id")
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit).orderBy("created_at", "event_id")


def stream_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append to the log, one folder per day."""
    (df.withColumn("event_date", F.to_date("created_at"))
     .write.mode("append").partitionBy("event_date").parquet(path))


# -- memories --------------------------------------------------------------------

def read_memories(spark: SparkSession, path: str, session: str | None = None,
                  buckets: int | None = None) -> DataFrame:
    """A memory table, or one session of it.

    With the table's number of buckets only the session's folder is read.
    """
    df = spark.read.parquet(path)
    if session is None:
        return df
    if buckets is not None:
        df = df.where(F.col("session_bucket") == session_bucket(F.lit(session), buckets))
    return df.where(F.col("session_id") == session)


def session_bucket(session: Column, buckets: int = TABLE_BUCKETS) -> Column:
    return F.pmod(F.hash(session), buckets)


#: columns that an upsert never changes
FIRST_COLUMNS = ["id", "user_id", "memory_type", "role", "created_at"]


def upsert_memories(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge on (session_id, fingerprint).

    Id, owner, type and creation time of the first row stay; everything else
    comes from the latest row, and importance is the greatest.  A table with
    ``updated_at`` gets the time of the latest row there.
    """
    keys = ["session_id", "fingerprint"]
    columns = existing.columns
    both = existing.withColumn("__new", F.lit(0)).unionByName(
        incoming.select(*columns).withColumn("__new", F.lit(1)))
    first = [c for c in columns if c in FIRST_COLUMNS]
    rest = [c for c in columns if c not in {*keys, *first, "importance"}]
    arrival = F.struct("__new", F.col("updated_at" if "updated_at" in columns else "created_at"), "id")
    merged = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), arrival).alias("l"), F.min_by(F.struct(*first), arrival).alias("r"),
        F.max(F.coalesce("importance", F.lit(0.0))).alias("importance"))
    return merged.select(*keys, "l.*", "r.*", "importance").select(*columns)


def stamped(df: DataFrame) -> DataFrame:
    """With ``updated_at``, the creation time where it is not set."""
    if "updated_at" in df.columns:
        return df.withColumn("updated_at", F.coalesce("updated_at", "created_at"))
    return df.withColumn("updated_at", F.col("created_at"))


def write_upsert(incoming: DataFrame, path: str, buckets: int = TABLE_BUCKETS) -> None:
    """Upsert into a table partitioned by session bucket, rewriting touched buckets only.

    Rows of one batch that share a key are merged as well, also in the first
    write.  A hot session makes its bucket large but never funnels through one
    task: rows are merged by (session, fingerprint).
    """
    spark = incoming.sparkSession
    fresh = stamped(incoming).withColumn("session_bucket", session_bucket(F.col("session_id"), buckets))
    if not _complete(spark, path):
        upsert_memories(fresh.where(F.lit(False)), fresh).write.mode("overwrite").partitionBy("session_bucket").parquet(path)
        return
    fresh = materialize(fresh, "upsert-in")
    touched = fresh.select("session_bucket").distinct()
    stored = spark.read.parquet(path).join(touched, "session_bucket", "left_semi")
    merged = upsert_memories(stored, fresh.select(*stored.columns))
    overwrite_partitions(materialize(merged, "upsert-out"), path, ["session_bucket"])


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def _location(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    location, store = _location(spark, path)
    return store.exists(location)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end; a first write that failed is not one."""
    return _exists(spark, f"{path}/_SUCCESS")


def _replace(stored: DataFrame, rows: DataFrame, path: str, by: list[str]) -> None:
    """Put ``rows`` in place of ``stored``, which holds whole partitions of the table at ``path``.

    Partitions that come out empty are removed after the others are written.
    ``stored`` has few partitions, and only their names reach the driver.
    """
    spark = stored.sparkSession
    rows = materialize(rows, "rewrite")
    emptied = stored.select(*by).distinct().join(rows.select(*by).distinct(), by, "left_anti").collect()
    overwrite_partitions(rows, path, by)
    for r in emptied:
        location, store = _location(spark, "/".join([path, *[f"{c}={r[c]}" for c in by]]))
        store.delete(location, True)


# -- routes and tiers ------------------------------------------------------------

def route_of() -> Column:
    """Facts go to the relational store, everything else to the vector store."""
    return F.when(F.col("memory_type") == "factual", "relational").otherwise("vector")


def route_memories(df: DataFrame) -> DataFrame:
    return df.withColumn("route", route_of())


def route_counts(df: DataFrame) -> DataFrame:
    return route_memories(df).groupBy("route", "memory_type").agg(F.count("*").alias("memories"))


def write_routed(df: DataFrame, path: str) -> None:
    route_memories(df).write.mode("append").partitionBy("route").parquet(path)


TIER_KEYS = ["tier", "id_bucket"]


def _id_bucket(buckets: int) -> Column:
    return F.pmod(F.hash("id"), F.lit(buckets))


def write_tiered(df: DataFrame, path: str, as_of, buckets: int = TABLE_BUCKETS) -> None:
    """Save into the tier each row belongs to, whatever tier it came with.

    Rows replace stored rows of the same id in any tier, so nothing is kept
    twice when a row moves; of rows alike in id the latest counts.  The table is
    partitioned by tier and bucket of the id, and touched buckets are rewritten.
    """
    spark = df.sparkSession
    placed = df.withColumns({"tier": tier_of(as_of), "id_bucket": _id_bucket(buckets)})
    columns = placed.columns
    latest = placed.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("created_at", F.xxhash64(*columns))).alias("r"))
    fresh = latest.select("r.*")
    if not _complete(spark, path):
        fresh.write.mode("overwrite").partitionBy(*TIER_KEYS).parquet(path)
        return
    fresh = materialize(fresh, "tiers-in")
    stored = spark.read.parquet(path).join(fresh.select("id_bucket").distinct(), "id_bucket", "left_semi")
    kept = stored.join(fresh.select("id"), "id", "left_anti")
    _replace(stored, kept.select(*columns).unionByName(fresh.select(*columns)), path, TIER_KEYS)


def remove_tiered(spark: SparkSession, path: str, ids: DataFrame, buckets: int = TABLE_BUCKETS) -> None:
    """Delete rows by id from whatever tier holds them."""
    gone = ids.select("id").distinct()
    touched = gone.select(_id_bucket(buckets).alias("id_bucket")).distinct()
    stored = spark.read.parquet(path).join(touched, "id_bucket", "left_semi")
    _replace(stored, stored.join(gone, "id", "left_anti"), path, TIER_KEYS)


def remove_sessions(spark: SparkSession, path: str, sessions: DataFrame, buckets: int = TABLE_BUCKETS) -> None:
    """Delete all memories of the given sessions from a table written by ``write_upsert``."""
    gone = sessions.select("session_id").distinct()
    touched = gone.select(session_bucket(F.col("session_id"), buckets).alias("session_bucket")).distinct()
    stored = spark.read.parquet(path).join(touched, "session_bucket", "left_semi")
    _replace(stored, stored.join(gone, "session_id", "left_anti"), path, ["session_bucket"])


def read_all_tiers(spark: SparkSession, path: str, user: str | None = None) -> DataFrame:
    """All tiers, most important first."""
    df = spark.read.parquet(path).drop("id_bucket")
    if user is not None:
        df = df.where(F.col("user_id") == user)
    return df.orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), F.asc("id"))


# -- patches and deletes -----------------------------------------------------------

PATCH_COLUMNS = ["lifecycle_state", "tier", "updated_at", "importance", "last_accessed_at", "access_count"]


def patch_memories(table: DataFrame, patches: DataFrame) -> DataFrame:
    """Overlay the non-null columns of ``patches`` (keyed by id) on the table.

    Only lifecycle columns can be patched.
    """
    names = [c for c in PATCH_COLUMNS if c in patches.columns and c in table.columns]
    slim = patches.select("id", *[F.col(c).alias(f"__{c}") for c in names])
    joined = table.join(slim, "id", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in names}).select(*table.columns)


def delete_rows(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


#: sessions that may be purged by prefix
PURGE_PREFIXES = ("demo-", "test-", "all-db-")


def purge_sessions(table: DataFrame, prefix: str, allowed: tuple[str, ...] = PURGE_PREFIXES) -> DataFrame:
    """Drop all sessions starting with ``prefix``; only demo and test prefixes are accepted."""
    if not any(prefix.startswith(p) for p in allowed):
        raise ValueError(f"sessions starting with {prefix!r} may not be purged")
    return table.where(~F.startswith("session_id", F.lit(prefix)))


def reset_sessions(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """Drop everything stored for the given sessions."""
    return table.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


# -- usage ---------------------------------------------------------------------------

def usage_rows(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """Per memory: hits, first and last use, with its importance and type."""
    used = hits.groupBy(F.col("memory_id").alias("id")).agg(
        F.count("*").alias("hits"), F.min("ts").alias("first_used_at"), F.max("ts").alias("last_used_at"))
    return used.join(memories.select("id", F.col("importance").alias("last_importance"), "memory_type"), "id", "left")


def record_access(memories: DataFrame, hits: DataFrame) -> DataFrame:
    """Add the hits to ``access_count`` and move ``last_accessed_at`` forward."""
    used = hits.groupBy(F.col("memory_id").alias("id")).agg(
        F.count("*").alias("__hits"), F.max("ts").alias("__last"))
    joined = memories.join(used, "id", "left")
    return joined.withColumns({
        "access_count": (F.coalesce("access_count", F.lit(0)) + F.coalesce("__hits", F.lit(0))).cast("bigint"),
        "last_accessed_at": F.greatest("__last", "last_accessed_at")}).drop("__hits", "__last")


# -- consolidated facts ----------------------------------------------------------------

def upsert_consolidated(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace by id; the first ``created_at`` is kept."""
    columns = existing.columns
    old = existing.select("id", F.struct(*columns).alias("o"))
    new = incoming.select("id", F.struct(*columns).alias("n"))
    both = old.join(new, "id", "full")
    row = F.coalesce("n", "o")
    return both.select(*[
        (F.coalesce(F.col("o.created_at"), F.col("n.created_at")) if c == "created_at" else row[c]).alias(c)
        for c in columns])


def find_consolidated(df: DataFrame, *, user: str | None = None, topic: str | None = None,
                      status: str | None = None, source_id: str | None = None) -> DataFrame:
    """Filtered facts, most important first; by source id, newest first."""
    for column, value in (("user_id", user), ("topic", topic), ("status", status)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if source_id is not None:
        return df.where(F.array_contains("source_ids", source_id)).orderBy(F.desc("updated_at"), F.asc("id"))
    return df.orderBy(F.desc("importance"), F.desc("updated_at"), F.asc("id"))

