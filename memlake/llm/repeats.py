"""Operator 9: repeated passages, by interval refinement of suffix classes.

Every byte that lies in a string of ``length`` bytes which also starts anywhere
else is found.  Suffixes are not sorted one by one: as when the transforms of
shards are merged by refining their interleave, suffixes of all documents are
put into classes by a common prefix, classes of one member leave, and what is
left is refined by longer content until each class is decided.

A string starting at ``i`` is named by its anchor, the smallest of its first
``reach`` rolling hashes (the rightmost of equals), so equal strings have equal
anchors at an equal offset; the strings of an anchor start side by side.  A
piece is a block of such starts.  Its *core* is what all of them share, its
*range* is all they cover.  Pieces whose core is unique leave.  If the range is
shared too, all its strings repeat and its interval is settled.  Otherwise it
is cut into smaller blocks, down to single strings, whose core is their range.
A settled class sends one member along, so that opened pieces find it.

Rows of a level are counted by hash with a partial aggregation before the
shuffle, so a passage in a third of the corpus adds as few rows as any other.
Core and range hashes are independent, 64 bits each, and compared together.

Defined results: a null text is empty; texts shorter than ``length`` have no
span; rows with the same id and text are two documents that repeat each other;
null ids are kept apart by their text; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import bounded_broadcast, whole_text
from memlake.llm.winnowing import kgram_hashes
from memlake.session import materialize

LENGTH = 400
REACH = 192
BLOCKS = (REACH, 16, 1)
_GRAM = 16
_U32, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_PIECES = "a array<int>, low array<int>, high array<int>, core array<long>, whole array<long>"


class _Rolling:
    """Hashes of any substring from prefix sums of value times power, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.base, self.inverse = base % (1 << 64), pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            m = len(self.powers)
            with np.errstate(over="ignore"):
                self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, m, 1 << 64))])
                self.inverses = np.concatenate([self.inverses, self.inverses * np.uint64(pow(self.inverse, m, 1 << 64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[data] * self.powers[:len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Mixed hashes of ``data[start:end]``; lengths and ``salt`` count as content."""
        with np.errstate(over="ignore"):
            h = (prefix[end] - prefix[start]) * self.inverses[start]
            h = (h ^ (salt.astype(np.uint64) << np.uint64(40)) ^ (end - start).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


_CORE, _WHOLE = _Rolling(21), _Rolling(22)


def anchors(data: np.ndarray, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with the smallest and greatest offset of the strings that they name."""
    starts = len(data) - length + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 3
    h = kgram_hashes(data, _GRAM)
    low = (h >> _U32 << _U32) | (_LOW - np.arange(len(h), dtype=np.uint64))
    span = 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[:len(low) - (reach - span)], low[reach - span:])
    at = (_LOW - (low[:starts] & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:] - 1, starts - 1)
    a = at[first]
    return a, a - last, a - first


def pieces(data: np.ndarray, a, low, high, block: int, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Blocks of offsets of the given anchors, with their core and range hashes."""
    first, last = low // block, high // block
    count = last - first + 1
    owner = np.repeat(np.arange(len(a)), count)
    number = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    a, low, high = a[owner], np.maximum(low[owner], number * block), np.minimum(high[owner], number * block + block - 1)
    core, whole = _CORE.prefix(data), _WHOLE.prefix(data)
    return {"a": a, "low": low, "high": high,
            "core": _CORE.of(core, a - number * block, a + length - (number * block + block - 1), number),
            "whole": _WHOLE.of(whole, a - high, a + length - low, high * 1024 + low)}


def _data(column: pa.Array) -> list[np.ndarray]:
    """Views of the values of a binary column."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset:column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return [values[s:e] for s, e in zip(offsets[:-1], offsets[1:])]


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return [values[s:e] for s, e in zip(offsets[:-1], offsets[1:])]


def _packed(keys: pa.RecordBatch, rows: list[int], found: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0] + [len(f["a"]) for f in found]), pa.int32())
    kinds = {"a": np.int32, "low": np.int32, "high": np.int32, "core": np.int64, "whole": np.int64}
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[c] for f in found]).astype(kind)))
             for c, kind in kinds.items()]
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([keys.column("id").take(at), keys.column("h").take(at), *lists], names=["id", "h", *kinds])


def _rows(block: int, opened: bool, length: int, reach: int, held: int = 200_000):
    """One row a text with its pieces in lists; a batch goes out once it holds ``held`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, size = [], [], 0
            named = [_lists(batch.column(c)) for c in ("a", "low", "high")] if opened else None
            for i, data in enumerate(_data(batch.column("data"))):
                own = [c[i] for c in named] if opened else anchors(data, length, reach)
                if not len(own[0]):
                    continue
                rows.append(i)
                out.append(pieces(data, *own, block, length))
                size += len(out[-1]["a"])
                if size >= held:
                    yield _packed(batch, rows, out)
                    rows, out, size = [], [], 0
            if out:
                yield _packed(batch, rows, out)
    return run


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH,
             blocks=BLOCKS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``id, h, spans``: maximal repeated byte runs of every text that has any; ``h`` is the hash of the text."""
    kind = docs.schema[doc_id].dataType
    texts = docs.select(F.col(doc_id).cast("string").alias("id"), whole_text(text).alias("text")).withColumn(
        "h", F.xxhash64("text")).where(F.octet_length("text") >= length)
    data = texts.select("id", "h", F.col("text").cast("binary").alias("data"))
    settled, opened = None, None
    for block in blocks:
        source = data
        if opened is not None:
            keys = opened.select("id", "h").distinct()
            if block == blocks[1]:  # the texts that are still open, once for all further levels
                keys = materialize(keys, "repeat-keys")
                small = bounded_broadcast(keys, keys.count(), broadcast_rows)
                data = materialize(data.join(small, _same(data, small), "left_semi"), "repeat-open")
            per = opened.groupBy("id", "h").agg(F.collect_list(F.struct("a", "low", "high")).alias("p"))
            source = data.join(per, _same(data, per)).select(
                data["id"], data["h"], "data", *[F.col(f"p.{c}").alias(c) for c in ("a", "low", "high")])
        found = source.mapInArrow(_rows(block, opened is not None, length, reach), f"id string, h long, {_PIECES}")
        rows = materialize(found.select("id", "h", F.inline(F.arrays_zip("a", "low", "high", "core", "whole"))), "repeat-rows")
        shared = materialize(rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "repeat-cores")
        left = materialize(rows.join(bounded_broadcast(shared, shared.count(), broadcast_rows), "core"), "repeat-left")
        one = F.xxhash64("id", "h", "a", "low")
        # written before the join, so that Spark can split the rows of a frequent class over tasks
        kinds = materialize(left.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(one).alias("first")), "repeat-kinds")
        undecided = materialize(kinds.groupBy("core").agg(F.max(F.col("n") == 1).alias("open")), "repeat-undecided")
        judged = materialize(left.join(kinds, ["core", "whole"]).join(undecided, "core").select(
            "id", "h", "a", "low", "high", (F.col("n") > 1).alias("settled"),
            (F.col("open") & ((F.col("n") == 1) | (F.col("first") == one))).alias("open")), "repeat-judged")
        ranges = judged.where("settled").select("id", "h", (F.col("a") - F.col("high")).alias("start"),
                                                (F.col("a") - F.col("low") + length).alias("end"))
        settled = ranges if settled is None else settled.unionByName(ranges)
        opened = judged.where("open").select("id", "h", "a", "low", "high").distinct()
    runs = settled.repartition("id", "h").sortWithinPartitions("id", "h", "start").mapInPandas(
        _merge, "id string, h long, start int, end int")
    return runs.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")).withColumn(
        "id", F.col("id").cast(kind))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["h"] == b["h"]) & a["id"].eqNullSafe(b["id"])


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Overlapping and touching intervals of each text joined, as they pass by in order."""
    key, start, end = None, 0, 0
    for batch in batches:
        out = []
        ids = batch["id"].astype(object).where(batch["id"].notna(), None)
        for k, s, e in zip(zip(ids, batch["h"]), batch["start"], batch["end"]):
            if k == key and s <= end:
                end = max(end, e)
                continue
            if key is not None:
                out.append((*key, start, end))
            key, start, end = k, s, e
        yield pd.DataFrame(out, columns=["id", "h", "start", "end"])
    if key is not None:
        yield pd.DataFrame([(*key, start, end)], columns=["id", "h", "start", "end"])


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000,
                    **options) -> DataFrame:
    """``doc_id, bytes, spans, kept``: each text in UTF-8, its repeated runs, and what is left of it."""
    runs = materialize(repeated(docs, doc_id=doc_id, text=text, broadcast_rows=broadcast_rows, **options), "repeat-runs")
    all_ = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    small = bounded_broadcast(runs, runs.count(), broadcast_rows)
    joined = all_.join(small, (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    data = F.col("text").cast("binary")
    start = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    done = F.aggregate("spans", start, lambda held, s: F.struct(
        s["end"].alias("at"), F.concat(held["out"], F.substring(data, held["at"] + 1, s["start"] - held["at"])).alias("out")))
    kept = F.when(F.col("spans").isNull(), data).otherwise(
        F.concat(done["out"], F.substring(data, done["at"] + 1, F.octet_length("text"))))
    none = F.array().cast(runs.schema["spans"].dataType)
    return joined.select("doc_id", F.octet_length("text").cast("long").alias("bytes"),
                         F.coalesce("spans", none).alias("spans"), kept.alias("kept"))
