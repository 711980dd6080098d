"""Operator 10: document fingerprints by winnowing.

All k-grams of code points get a rolling hash; of every window of ``w``
consecutive k-grams the smallest hash is kept, the rightmost of equals, with
its position.  Any passage of at least ``w + k - 1`` code points that two texts
share leaves the same hash in both fingerprints, at positions inside the
passage.

Defined results: a null text is empty; a text shorter than ``k`` has one hash
of itself, an empty one none; a text with fewer than ``w`` k-grams has one
window.  The likeness of two fingerprints is the Jaccard similarity of their
hash sets, 1 if both are empty.  Documents are ordered by id, then by text, with
null ids first; a lone document is its own next one.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import whole_text

BASE = np.uint64(0x9E3779B97F4A7C15)
_U32 = np.uint64(32)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit rolling hashes of all k-grams; widths double, then the rest is appended."""
    one = codes.astype(np.uint64) + np.uint64(1)
    if not len(one):
        return one
    k = min(k, len(one))
    have, width, base = None, 0, BASE
    power, block, span = base, one, 1
    with np.errstate(over="ignore"):
        while True:
            if k & span:
                if have is None:
                    have, width = block, span
                else:
                    n = len(one) - width - span + 1
                    have, width = have[:n] * power + block[width:width + n], width + span
            if width == k:
                break
            n = len(block) - span
            block = block[:n] * power + block[span:span + n]
            power, span = power * power, span * 2
        h = have
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def winnow(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 32-bit hashes) of the kept k-grams, by position."""
    h = kgram_hashes(codes, k) >> _U32
    n = len(h)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    # smaller hash first, then the larger position
    key = (h << _U32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    w, low, span = min(w, n), key, 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[:len(low) - (w - span)], low[w - span:])
    kept = low[np.concatenate(([True], low[1:] != low[:-1]))]
    positions = (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return positions, (kept >> _U32).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 24, w: int = 48) -> DataFrame:
    """``doc_id, positions array<long>, hashes array<long>`` of every document."""
    def run(batches):
        for batch in batches:
            marks = [winnow(points(t), k, w) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["id"], "positions": [m[0] for m in marks],
                                "hashes": [m[1].astype(np.int64) for m in marks]})
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), whole_text(text).alias("text"))
    return rows.mapInPandas(run, "doc_id string, positions array<long>, hashes array<long>").withColumn(
        "doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def packed(mark: tuple[np.ndarray, np.ndarray]) -> str:
    """Hex of (position, hash) pairs, 32 bits each, big end first."""
    return np.stack([mark[0].astype(np.uint32), mark[1]], axis=1).astype(">u4").tobytes().hex()


def _compared(doc_id, text: str, mark, after: str, after_mark, k: int, w: int) -> tuple:
    n = len(text)
    edited = text[:n - n // 2] + after[:n // 2]
    edited_mark = winnow(points(edited), k, w)
    return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(mark),
            packed(edited_mark), likeness(mark[1], edited_mark[1]), likeness(mark[1], after_mark[1]))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_RESULT = ("doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _key(doc_id, tie: int) -> tuple:
    """Sorts null ids first."""
    return (False, tie) if doc_id is None else (True, doc_id, tie)


def _placed(bounds: list[tuple]):
    """Per (id, tie): its bucket, and the bucket before if the row opens its own, else null."""
    def place(ids: pa.Array, ties: pa.Array) -> pa.Array:
        keys = [_key(i, t) for i, t in zip(ids.to_pylist(), ties.to_pylist())]
        at = [max(0, bisect.bisect_right(bounds, k) - 1) for k in keys]
        before = [(b - 1) % len(bounds) if bounds[b] == k else None for b, k in zip(at, keys)]
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(before, pa.int32())], ["own", "before"])
    return F.arrow_udf(place, "own int, before int")


def _walk(k: int, w: int, rows_out: int = 512):
    """Rows by (bucket, guest, id): each is compared with the one after it, the last of a bucket with its guest."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, out = None, []
        for batch in batches:
            for bucket, guest, doc_id, text in zip(batch["bucket"], batch["guest"], batch["id"], batch["text"]):
                if guest and (held is None or held[0] != bucket):
                    continue
                mark = winnow(points(text), k, w)
                if held is not None:
                    out.append(_compared(*held[1:], text, mark, k, w))
                    if len(out) == rows_out:
                        yield pd.DataFrame(out, columns=_NAMES)
                        out = []
                held = None if guest else (bucket, doc_id, text, mark)
        if out:
            yield pd.DataFrame(out, columns=_NAMES)
    return walk


def compare_with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 24, w: int = 48,
                      buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document, of its text edited with the next document, and their likeness.

    Ids are cut into ranges first, whose lower bounds, one a range, are all that
    reaches the driver.  Then each text moves once to its range, and the first
    text of a range also to the range before it, where it follows the last one.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["id"].dataType
    ranges = rows.select("id", "tie").repartitionByRange(buckets, F.col("id").asc_nulls_first(), "tie")
    lowest = ranges.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")).alias("low")).collect()
    bounds = sorted(_key(r["low"]["id"], r["low"]["tie"]) for r in lowest)
    if not bounds:
        return spark.createDataFrame([], _RESULT).withColumn("doc_id", F.col("doc_id").cast(kind))
    placed = rows.withColumn("at", _placed(bounds)("id", "tie"))
    visits = F.array_compact(F.array(
        F.struct(F.col("at.own").alias("bucket"), F.lit(False).alias("guest")),
        F.when(F.col("at.before").isNotNull(), F.struct(F.col("at.before").alias("bucket"), F.lit(True).alias("guest")))))
    dealt = placed.select("id", "tie", "text", F.explode(visits).alias("v")).select("v.bucket", "v.guest", "id", "tie", "text")
    walked = (dealt.repartition("bucket")
              .sortWithinPartitions("bucket", "guest", F.col("id").asc_nulls_first(), "tie", "text")
              .select("bucket", "guest", F.col("id").cast("string").alias("id"), "text").mapInPandas(_walk(k, w), _RESULT))
    return walked.withColumn("doc_id", F.col("doc_id").cast(kind))
