"""Operator 8: benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

A seed is a fixed mask laid over consecutive words: words under a 1 are hashed,
words under a 0 may differ.  Every position of every document and of every
benchmark item is hashed under each mask, equal hashes are joined, and each hit
names a diagonal, the item laid over the document at one offset.  Around the hit
the words are compared one by one along the diagonal.  An item counts as leaked
where at least ``share`` of some ``window`` of its words (13 of 16) agree, so
substituted words do not hide a passage; items with fewer than 13 words count
where all their words agree.

The masks are complete for this rule: whichever 3 of 16, 2 of 15 or 1 of 14 words
differ, some mask meets equal words only (a test goes through all placements).
Items of fewer than 13 words have a seed of all their words, and the documents
one of each such length.

Seeds carry a row's key and text hash but not its words.  The benchmark's seeds
are broadcast where their counted rows are within ``broadcast_rows``; otherwise both
sides are shuffled by hash.  Words are fetched again for rows with a hit, and
only the pieces that the items lie over go on.

Defined results: null or empty texts have no hits; repeated rows of one id give
one row; null ids are one id; items of equal text are each reported; empty tables
give an empty result; extra columns are not read (and kept by ``without_leaks``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import bounded_broadcast, whole_text
from memlake.session import materialize

WORD = r"[\p{L}\p{N}]+"
#: masks of seven words; together they meet every placement of three substitutions in 16 words
MASKS = ("11011111", "111000100111", "1110001101001", "1010010110011")
WINDOW = 16
SHARE = 0.8


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _hash(mask: str) -> Column:
    """Hash of the words under a mask at ``pos``."""
    return F.xxhash64(F.lit(mask), *[F.get("words", F.col("pos") + j) for j, on in enumerate(mask) if on == "1"])


def _seeds(rows: DataFrame, keep: list[str], masks) -> DataFrame:
    """``keep``, position and hash of every mask that fits there, for rows with an array ``words``."""
    at = rows.select(*keep, "words", F.posexplode("words").alias("pos", "word"))
    fitting = [F.when(F.col("pos") + len(mask) <= F.size("words"), _hash(mask)) for mask in masks]
    return at.select(*keep, "pos", F.explode(F.array(*fitting)).alias("hash")).where(F.col("hash").isNotNull())


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: Column, text: str = "text", item_id: str = "item_id",
          item_text: str = "text", masks=MASKS, window: int = WINDOW, share: float = SHARE,
          broadcast_rows: int = 2_000_000) -> DataFrame:
    """``key, item_id, matched, best``: per document and item the most equal words on a diagonal and in a window."""
    enough = math.ceil(share * window)
    # rows are told apart by a number, as ids may be null or repeated
    items = materialize(benchmark.select(F.monotonically_increasing_id().alias("item_row"), F.col(item_id).alias("item_id"),
                                         words_of(whole_text(item_text)).alias("words")), "leak-items")
    lengths = [r[0] for r in items.where(F.size("words").between(1, enough - 1)).select(F.size("words")).distinct().collect()]
    whole = ["1" * n for n in sorted(lengths)]  # fewer than ``enough``
    long_ = _seeds(items.where(F.size("words") >= enough), ["item_row"], masks)
    seeds = long_.select("item_row", F.col("pos").alias("item_pos"), "hash")
    for mask in whole:
        short = items.where(F.size("words") == len(mask)).withColumn("pos", F.lit(0))
        seeds = seeds.unionByName(short.select("item_row", F.lit(0).alias("item_pos"), _hash(mask).alias("hash")))
    seeds = materialize(seeds, "leak-seeds")
    rows = docs.select(key.alias("key"), whole_text(text).alias("text")).withColumn("h", F.xxhash64("text"))
    tokens = rows.select("key", "h", words_of(F.col("text")).alias("words"))
    hits = materialize(_seeds(tokens, ["key", "h"], (*masks, *whole)).join(
        bounded_broadcast(seeds, seeds.count(), broadcast_rows), "hash").select(
            "key", "h", "item_row", (F.col("pos") - F.col("item_pos")).alias("start")).distinct(), "leak-hits")

    sized = items.select("item_row", "item_id", F.col("words").alias("item"))
    at = hits.withColumnsRenamed({"key": "hit_key", "h": "hit_h"})
    found = rows.join(bounded_broadcast(at, at.count(), broadcast_rows // 4),
                      F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("h") == F.col("hit_h")))
    laid = found.select("key", "item_row", "start", words_of(F.col("text")).alias("words")).join(
        bounded_broadcast(sized, sized.count(), broadcast_rows // 20), "item_row")
    first = F.greatest(F.col("start"), F.lit(0))
    n = F.least(F.col("start") + F.size("item"), F.size("words")) - first
    equal = F.zip_with(F.slice("words", first + 1, n), F.slice("item", first - F.col("start") + 1, n),
                       lambda a, b: F.when(a == b, 1).otherwise(0))
    laid = laid.select("key", "item_id", F.size("item").alias("words"), equal.alias("equal"))
    ends = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("equal") - window))
    judged = laid.withColumns({
        "matched": F.aggregate("equal", F.lit(0), lambda a, e: a + e),
        "best": F.array_max(F.transform(ends, lambda s: F.aggregate(
            F.slice("equal", s + 1, F.lit(window)), F.lit(0), lambda a, e: a + e)))})
    return (judged.where(F.col("best") >= F.least(F.lit(enough), "words")).groupBy("key", "item_id")
            .agg(F.max("matched").cast("long").alias("matched"), F.max("best").cast("long").alias("best")))


def find(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``doc_id, item_id, matched, best``, one row per leaked item of a document."""
    return leaks(docs, benchmark, key=F.col(doc_id), **options).withColumnRenamed("key", "doc_id")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", broadcast_rows: int = 2_000_000,
                  **options) -> DataFrame:
    """``docs`` without those that hold a leaked item; a text is judged by its digest, whatever its id."""
    digest = F.sha2(whole_text(text).cast("binary"), 256)
    bad = materialize(leaks(docs, benchmark, key=digest, text=text, **options).select("key").distinct(), "leaked")
    columns = docs.columns
    marked = docs.withColumn("__digest", digest)
    small = bounded_broadcast(bad.withColumnRenamed("key", "__digest"), bad.count(), broadcast_rows // 4)
    return marked.join(small, "__digest", "left_anti").select(*columns)
