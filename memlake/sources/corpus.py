"""Chat events derived from the ``conversations`` table.

The prose of that table matches few of the rule vocabularies, so every turn
gets one or two template sentences picked from its key; times, users and
states follow from the key as well (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-01 00:00:00"

TEMPLATES = [
    "My name is Alice Johnson and I prefer TypeScript for backend work.",
    "I live in Mumbai.",
    "I live in Bangalore.",
    "We use PostgreSQL for our backend database.",
    "We use MongoDB for our backend database.",
    "Yesterday I finished the sprint review and deployed the new API endpoint to production.",
    "We decided to use Redis for the job queue.",
    "I prefer spicy Thai food especially pad thai noodles.",
    "Generally the algorithm is a good approach because the database is indexed.",
    "We should plan the next step for the project roadmap before the deadline.",
    "Alice is working on Project Alpha with Acme Corp.",
    "Please fix the login bug and add a test for version v2.1.3 of the client.",
    "Contact bob@example.com or visit https://example.com/docs today.",
    "Call 415-555-0132 about #launch with @carol and `deploy.sh` in /srv/app.",
    "What do you remember about me?",
    "ok",
    "thanks",
    "I think maybe the pricing plan might change?",
    "I dislike long meetings.",
    "I am a senior software engineer working on distributed systems.",
    "Customer revenue is the main market metric for our startup product.",
    "I study at the college and the exam is on Monday.",
    "My family lives at home and my birthday is 12/05/1990.",
    "My name is Alice Johnson and I prefer TypeScript for backend work!",
]

STATES = ["active"] * 7 + ["stale", "conflicted", "archived"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a table sits in fewer file splits than there are cores.

    The text rules cost far more per row than moving it once; tables with
    enough splits are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: one row per conversation turn."""
    return events_of_turns(spread(read_table(spark, sf_dir, "conversations")))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The same for any (batch or streaming) table of turns."""
    conv, turn = F.col("conv_id"), F.col("turn")
    sentence = F.get(F.array(*[F.lit(t) for t in TEMPLATES]),
                     ((conv * 7 + turn * 5) % len(TEMPLATES)).cast("int"))
    content = F.concat(F.col("text"), F.lit("\n"), sentence,
                       F.when(turn % 3 == 0, F.concat(F.lit("\n"), sentence)).otherwise(""))
    age_days = ((conv * 37 + turn * 11) % 160).cast("int")
    return turns.select(
        F.concat(F.lit("s"), conv, F.lit("-"), turn).alias("event_id"),
        F.concat(F.lit("s"), conv).alias("session_id"),
        F.concat(F.lit("u"), conv % 25).alias("user_id"),
        F.col("role"), content.alias("content"),
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(age_days)).alias("created_at"),
        conv.alias("conv_id"), turn.alias("turn"))


def with_usage(memories: DataFrame) -> DataFrame:
    """Access, saved-by-user and lifecycle columns derived from session and turn."""
    conv = F.substr("session_id", F.lit(2)).cast("long")
    turn = F.substring_index("event_id", "-", -1).cast("long")
    accessed = F.least(F.lit(AS_OF).cast("timestamp"),
                       F.col("created_at") + F.make_dt_interval(((conv * 13) % 40).cast("int")))
    return memories.withColumns({
        "last_accessed_at": F.when(conv % 2 != 0, accessed),
        "access_count": ((conv * 3 + turn) % 25).cast("int"),
        "saved": conv % 11 == 0,
        "lifecycle_state": F.get(F.array(*[F.lit(s) for s in STATES]),
                                 ((conv + turn) % len(STATES)).cast("int")),
        "vec_id": (conv * 8 + turn) % 500,
    })


def with_embeddings(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Attach the vector named by ``vec_id``."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return df.join(vectors, "vec_id", "left")
