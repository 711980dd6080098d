"""Operator 2: mixing sources to target weights by balanced (cube) sampling.

Every document of a source gets the same expected number of copies, target
words over source words, at most ``max_repeat``.  The whole part is taken for
certain.  The fractional part is an inclusion probability: the flight phase of
the cube method moves probabilities along the null space of two constraints,
the number of documents and their words, until each document but a few is
decided.  Blocks of ``block_rows`` documents fly on their own:

* of a source with several blocks, documents with more than ``4 / block_rows`` of all its
  words (at most ``block_rows / 4``) are decided first, and what they take more or less
  than expected shifts the probability of all others of the source;
* in a block, documents that hold more than one ``heavy``-th of its words are decided
  first, each against all others of the block at once, as three at a time would
  leave them to the landing; where the bounds leave no room for both constraints,
  the words are kept;
* then three documents fly at a time, the longest first, so that the at most two
  that stay undecided are short.

These fly again in the next level, so that at the end of all levels two short documents
a source remain.  They land by giving up the document count first and the words
last.  The last level is drawn up to ``attempts`` times, until its words are within
``tolerance``, and the nearest draw stays, for sources of a few documents.

Only (id, source, size) moves.  Blocks are cut by the place of a row in its source,
by hash, id and size, so none holds more than ``block_rows`` rows, repeated rows
included, and reruns agree whatever the partitioning.

Defined results: a null or empty text has size 0 and takes nothing; null is a
source of its own, ordered last; rows repeated with the same id are documents
of their own; a source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import bounded_broadcast, whole_text
from memlake.operators.ordered import with_position
from memlake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
_EPS = 1e-9
_FLOWN = "id string, source string, size long, block long, whole int, p double"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def size_in_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """``source, documents, source_size, target`` from ``source, size``.

    Targets share ``share`` times all words by weight; what would exceed
    ``max_repeat`` times a source goes back to the others by weight until none
    is above, which is the level at which capped sources fill up one by one in
    the order of capacity over weight.  The windows run over sources, one row each.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    capacity = F.col("source_size") * F.lit(float(max_repeat))
    fill = Window.partitionBy(F.lit(0)).orderBy("ratio", "weight", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    row = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place))
    row = row.withColumns({"ratio": capacity / F.col("weight"), "cap": capacity,
                           "goal": F.sum("source_size").over(every) * F.lit(float(share))})
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    row = row.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left)
    open_level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    return row.withColumn("target", F.when(
        (F.col("ratio") <= F.col("level")) | open_level.isNull(), F.col("cap")).otherwise(
            F.least("cap", F.col("weight") * open_level))).select(
                "source", "documents", "source_size", F.col("target").cast("double"))


def decide_heavy(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, heavy: int = 64) -> None:
    """Decide in place, longest first, the documents with over a ``heavy``-th of the undecided words."""
    open_ = (p > 0) & (p < 1)
    limit = size[open_].sum() / heavy
    for i in sorted(np.flatnonzero(open_ & (size > limit)), key=lambda i: (-size[i], i)):
        while 0 < p[i] < 1:
            others = np.flatnonzero((p > 0) & (p < 1) & (size > 0))
            others = others[others != i]
            if not len(others):
                break
            s, best = size[others], None
            ways = [np.full(len(s), -size[i] / s.sum())]
            moments = np.array([[len(s), s.sum()], [s.sum(), s @ s]])
            if np.linalg.cond(moments) < 1e12:
                a, b = np.linalg.solve(moments, [-1.0, -size[i]])
                ways.insert(0, a + b * s)
            for u in ways:
                with np.errstate(divide="ignore", invalid="ignore"):
                    up = np.where(u > 0, (1 - p[others]) / u, np.where(u < 0, -p[others] / u, np.inf)).min()
                    down = np.where(u > 0, p[others] / u, np.where(u < 0, (p[others] - 1) / u, np.inf)).min()
                best = u, min(up, 1 - p[i]), min(down, p[i])
                if up >= 1 - p[i] and down >= p[i]:
                    break
            u, up, down = best
            step = up if rng.random() * (up + down) < down else -down
            for at, move in ((others, u), (np.array([i]), np.ones(1))):
                moved = p[at] + step * move
                p[at] = np.where(moved < _EPS, 0.0, np.where(moved > 1 - _EPS, 1.0, moved))


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Cube method on one block: balanced on count and size, in the given order.

    Returns the probabilities after the flight, at most two of them fractional,
    or with ``land`` none.
    """
    p = p.astype(float).copy()
    p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
    decide_heavy(p, size, rng)
    waiting = np.flatnonzero((p > 0) & (p < 1)).tolist()[::-1]
    draws = rng.random(len(waiting) + 8).tolist()
    active: list[int] = []

    def move(ids: list[int], u: list[float]) -> None:
        up = min(((1 - p[i]) / d if d > 0 else -p[i] / d) for i, d in zip(ids, u) if d)
        down = min((p[i] / d if d > 0 else (p[i] - 1) / d) for i, d in zip(ids, u) if d)
        step = up if draws.pop() * (up + down) < down else -down
        for i, d in zip(ids, u):
            v = p[i] + step * d
            p[i] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v

    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            break
        a, b, c = (float(size[i]) for i in active)
        u = [b - c, c - a, a - b]
        if a == b == c:
            u = [1.0, -1.0, 0.0]
        top = max(map(abs, u))
        move(active, [d / top for d in u])
        active = [i for i in active if 0 < p[i] < 1]
    if land:
        if len(active) == 2:
            a, b = (float(size[i]) for i in active)
            move(active, [b / (a + b), -a / (a + b)] if a and b else [1.0, -1.0])
            active = [i for i in active if 0 < p[i] < 1]
        for i in active:
            p[i] = 1.0 if draws.pop() < p[i] else 0.0
    return p


def _flight(seed: int, level: int, land: bool, attempts: int, tolerance: float):
    def flight(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        name = f"{seed}/{level}/{rows['source'].iloc[0]!r}/{rows['block'].iloc[0]}"
        rng = np.random.default_rng(zlib.crc32(name.encode()))
        p, size = rows["p"].to_numpy(), rows["size"].to_numpy().astype(float)
        if not land:
            return rows.assign(p=fly(p, size, rng))
        wanted, best = float(p @ size), None
        for _ in range(attempts):
            landed = fly(p, size, rng, land=True)
            off = abs(float(landed @ size) - wanted)
            if best is None or off < best[0]:
                best = (off, landed)
            if off <= tolerance * wanted:
                break
        return rows.assign(p=best[1])
    return flight


def _heavy_flight(seed: int, attempts: int):
    """Long documents of a source; the others, with ``rest`` words, take up what they leave."""
    def flight(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}/heavy/{rows['source'].iloc[0]!r}".encode()))
        p, size, rest = rows["p"].to_numpy(), rows["size"].to_numpy().astype(float), max(1.0, float(rows["rest"].iloc[0]))
        best = None
        for _ in range(attempts):
            landed = fly(p, size, rng, land=True)
            left = p[0] - float((landed - p) @ size) / rest
            beyond = max(0.0, -left, left - 1)
            if best is None or beyond < best[0]:
                best = beyond, landed
            if not beyond:
                break
        return rows.drop(columns="rest").assign(shift=float((best[1] - p) @ size) / rest, p=best[1])
    return flight


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = 1.5, max_repeat: float = 2.0, block_rows: int = 4_096, seed: int = 7,
        attempts: int = 64, tolerance: float = 0.001) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies, taken``."""
    spark = docs.sparkSession
    slim = materialize(docs.select(
        F.col(doc_id).cast("string").alias("id"), F.col(source).cast("string").alias("source"),
        size_in_words(whole_text(text)).alias("size")), "mix-sizes")
    targets = materialize(source_targets(slim, weights=weights, share=share, max_repeat=max_repeat), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ready = targets.select(
        F.col("source").alias("s"), F.floor(rate + _EPS).cast("int").alias("whole"),
        F.greatest(F.lit(0.0), rate - F.floor(rate + _EPS)).alias("p"),
        F.ceil(F.col("documents") / block_rows).cast("long").alias("blocks"), "source_size")
    placed = with_position(slim.withColumn("mixed", F.xxhash64("id", "size")), ["source"], ["mixed", "id", "size"], "place")
    rows = placed.join(ready, F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "source", "size", F.pmod(F.col("place"), F.col("blocks")).alias("block"), "whole", "p", "source_size",
        ((F.col("blocks") > 1) & (F.col("size") * block_rows > 4 * F.col("source_size"))).alias("heavy"))
    rows = materialize(rows, "mix-placed")
    long_ = rows.where("heavy")
    rest = long_.groupBy(F.col("source").alias("s")).agg((F.max("source_size") - F.sum("size")).alias("rest"))
    fixed = materialize(long_.join(rest, F.col("source").eqNullSafe(F.col("s"))).select(*_columns(_FLOWN), "rest").groupBy(
        "source").applyInPandas(_heavy_flight(seed, attempts), _FLOWN + ", shift double"), "mix-heavy")
    shifts = fixed.groupBy(F.col("source").alias("s")).agg(F.max("shift").alias("shift"))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") - F.coalesce("shift", F.lit(0.0))))
    rows = rows.where("NOT heavy").join(shifts, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("p", moved).select(
        *_columns(_FLOWN))
    widest = targets.agg(F.max("documents")).first()[0] or 0
    blocks, level, decided = math.ceil(widest / block_rows), 0, [fixed.select(*_columns(_FLOWN))]
    while True:
        last = blocks <= 1
        flown = rows.groupBy("source", "block").applyInPandas(_flight(seed, level, last, attempts, tolerance), _FLOWN)
        rows = materialize(flown, "mix-flown")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(rows.where(~undecided))
        if last:
            break
        blocks, level = math.ceil(blocks / (block_rows // 2)), level + 1
        rows = rows.where(undecided).withColumn("block", F.pmod("block", F.lit(blocks)))
    done = decided[0]
    for part in decided[1:]:
        done = done.unionByName(part)
    copies = F.col("whole") + F.col("p").cast("int")
    known = targets.select(F.col("source").alias("s"), "source_size", "target")
    return done.join(known, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "source", "size", "source_size", "target",
        copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` that the mix takes, with ``copies`` and ``taken`` words in place of columns of these names.

    Rows alike in id and text each keep a decision of their own.
    """
    columns = [c for c in docs.columns if c not in ("copies", "taken")]
    key = F.to_json(F.struct(F.col(doc_id).alias("i"), F.xxhash64(whole_text(text)).alias("h")))
    keyed = docs.select(F.struct(*columns).alias("row"), key.alias("key"))
    sized = docs.select(key.alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    chosen = materialize(mix(sized, doc_id="key", **options).select(F.col("doc_id").alias("of"), "copies", "taken"), "mix-chosen")
    per = chosen.groupBy("of", "copies").agg(F.count("*").alias("n"))
    if per.groupBy("of").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("n > 1").limit(1).count():
        # repeated rows: in the order of their content the first get the most copies
        by_copies = F.array_sort(F.collect_list(F.struct((-F.col("copies")).alias("fewer"), "n")))
        repeated = materialize(per.groupBy("of").agg(by_copies.alias("per")).select("of", F.aggregate(
            "per", F.array().cast("array<struct<upto: bigint, copies: int>>"), lambda held, e: F.concat(held, F.array(F.struct(
                (F.coalesce(F.get(held, F.size(held) - 1)["upto"], F.lit(0)) + e["n"]).alias("upto"),
                (-e["fewer"]).cast("int").alias("copies"))))).alias("per")), "mix-repeated")
        placed = with_position(keyed.withColumn("content", F.to_json("row")), ["key"], ["content"], "place")
        joined = placed.join(repeated, F.col("key") == F.col("of")).withColumn("copies", F.get(F.filter(
            "per", lambda e: F.col("place") <= e["upto"]), 0)["copies"])
        words = (size_in_words(whole_text(f"row.{text}")) * F.col("copies")).alias("taken")
        return joined.where("copies > 0").select("row.*", "copies", words)
    taken = chosen.where("copies > 0")
    small = bounded_broadcast(taken, taken.count(), broadcast_rows)
    return keyed.join(small, F.col("key") == F.col("of")).select("row.*", "copies", "taken")
