"""Operator 13: hard negatives by exact scores from subset-sum tables.

Scoring is that of the Four Russians: for every eight dimensions an anchor has a
table of the sums of all 256 subsets of its components.  Candidates are packed
as bit planes, so that a byte of a plane names the subset of dimensions whose bit
is set there.  A score is the sum over planes, each shifted by its weight (the sign
plane counts negative), of the table entries named by its bytes: an exact integer
inner product for components of any size, since a block has the planes it needs.

1. Rows are packed in blocks of ``data_rows``, anchors in blocks of ``anchor_rows``.
2. Anchor blocks are dealt to every slice of the data blocks and joined there by
   slice, so data move once and a task keeps the running best of one anchor block.
3. A first pass finds the positives, a second the negatives of every anchor and
   positive, each scoring all rows.

Blocks are cut by count, so equal vectors, labels or scores of any number are
spread like others; results do not depend on slices or the order of tasks.

Defined results: null labels, null vectors, vectors with a null, NaN or infinite
component and rows without an id take no part; rows equal in id, vector and label are
one; rows that share an id never score each other; vectors meet only those of
their own length; empty vectors score 0; a positive with a score under 0 has no
negatives; components saturate at a long and sums wrap; anchors without a
positive or negative give no row; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.integer_vectors import Best, packed, rows_of, top_cells, unpacked
from memlake.session import materialize

DATA_ROWS, ANCHOR_ROWS = 4_096, 256
LOW, HIGH = 80, 100  # a negative scores 80 to 100 percent of its positive


def bit_planes(v: np.ndarray) -> np.ndarray:
    """Planes x groups x rows of bytes; bit j of a byte is that of dimension 8 g + j, the last plane is the sign."""
    n, dim = v.shape
    top = int(max(v.max(initial=0), ~v.min(initial=0)))
    groups = -(-dim // 8)
    out = np.zeros((top.bit_length() + 1, groups, n), np.uint8)
    for plane in range(len(out)):
        out[plane] = np.packbits(((v >> min(plane, 63)) & 1).astype(np.uint8), axis=1, bitorder="little").reshape(n, groups).T
    return out


def subset_sums(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """Groups x 256 x anchors: sums of every subset of each eight components."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    padded = np.zeros((n, groups * 8), kind)
    padded[:, :dim] = anchors
    out = np.zeros((groups, 256, n), kind)
    for g in range(groups):
        for j in range(8):
            out[g, 1 << j:2 << j] = out[g, :1 << j] + padded[:, 8 * g + j]
    return out


def table_scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Rows x anchors: looked-up sums, shifted and added from the sign plane down."""
    score = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    looked_up = np.empty_like(score)
    for plane in range(len(planes) - 1, -1, -1):
        score += score
        for g in range(len(tables)):
            np.take(tables[g], planes[plane, g], axis=0, out=looked_up, mode="clip")
            if plane == len(planes) - 1:
                score -= looked_up
            else:
                score += looked_up
    return score


_BLOCKS = "dim int, number long, n int, planes int, ids array<long>, labels array<long>, v binary, width int"


def _pack(rows: int, as_planes: bool):
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def block(part: list[tuple]) -> pd.DataFrame:
        ids, labels = (np.array([r[c] for r in part], np.int64) for c in (0, 1))
        dim = len(part[0][2])
        v = np.array([r[2] for r in part], np.int64).reshape(len(part), dim)
        order = np.argsort(ids, kind="stable")
        ids, labels, v = ids[order], labels[order], v[order]
        if as_planes:
            planes = bit_planes(v)
            return pd.DataFrame([(dim, part[0][3], len(part), len(planes), ids, labels, planes.tobytes(), 1)], columns=names)
        data, width = packed(v)
        return pd.DataFrame([(dim, part[0][3], len(part), 0, ids, labels, data, width)], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for r in zip(*(batch[c] for c in ("id", "label", "v", "number"))):
                own = held.setdefault(len(r[2]), [])
                own.append(r)
                if len(own) == rows:
                    yield block(held.pop(len(r[2])))
        for part in held.values():
            yield block(part)
    return run


def _scored(pair) -> np.ndarray:
    """Anchors x rows of a joined pair of blocks."""
    anchors = unpacked(pair.v, pair.width, pair.n, pair.dim)
    planes = np.frombuffer(pair.d_v, np.uint8).reshape(pair.d_planes, -(-pair.dim // 8), pair.d_n)
    most = np.abs(anchors.astype(np.float64)).max(initial=0) * 2.0 ** pair.d_planes * max(pair.dim, 1)
    with np.errstate(over="ignore"):
        return table_scores(subset_sums(anchors, np.int32 if most < 2 ** 31 else np.int64), planes).T.astype(np.int64)


def _positives(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best, ids = None, None, None
        for batch in batches:
            for pair in batch.itertuples(index=False):
                if pair.number != at:
                    if best is not None:
                        yield _rows(at, ids, best)
                    at, ids, best = pair.number, np.asarray(pair.ids), Best(pair.n, k)
                s, others = _scored(pair), np.asarray(pair.d_ids)
                same = (np.asarray(pair.labels)[:, None] == np.asarray(pair.d_labels)[None, :]) & (ids[:, None] != others[None, :])
                r, c = top_cells(s, same, k)
                best.offer(r, s[r, c], others[c])
        if best is not None:
            yield _rows(at, ids, best)
    return run


def _rows(at: int, ids: np.ndarray, best: Best) -> pd.DataFrame:
    return pd.DataFrame({"number": at, "pos": best.key.astype(np.int32), "anchor_id": ids[best.key], "found_id": best.ident,
                         "score": best.score})


def _negatives(k: int, per: int):
    """``per``: most positives of an anchor; key ``pos * per + nth`` stands for an anchor and its nth positive."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best = None, None
        for batch in batches:
            for pair in batch.itertuples(index=False):
                if pair.number != at:
                    if best is not None:
                        yield _picked(at, best, per)
                    at, best = pair.number, Best(pair.n * per, k)
                    ids, labels = np.asarray(pair.ids), np.asarray(pair.labels)
                    limit = np.full((pair.n, per), -1, np.int64)  # no row scores under 0 and passes
                    for p in pair.positives:
                        limit[p["pos"], p["nth"] - 1] = p["score"]
                s, others = _scored(pair), np.asarray(pair.d_ids)
                other = (labels[:, None] != np.asarray(pair.d_labels)[None, :]) & (ids[:, None] != others[None, :])
                for nth in range(per):
                    top = limit[:, nth][:, None]
                    inside = other & (top >= 0) & (s <= top) & (s >= -(-(LOW * top) // HIGH))
                    rows = np.flatnonzero(inside.any(axis=1))
                    r, c = top_cells(s[rows], inside[rows], k)
                    best.offer(rows[r] * per + nth, s[rows[r], c], others[c])
        if best is not None:
            yield _picked(at, best, per)
    return run


def _picked(at: int, best: Best, per: int) -> pd.DataFrame:
    return pd.DataFrame({"number": at, "pos": (best.key // per).astype(np.int32), "nth": (best.key % per + 1).astype(np.int32),
                         "negative_id": best.ident, "negative_score": best.score})


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, *, positives: int = 5, negatives: int = 5,
                   vec_id: str = "vec_id", vector: str = "embedding", data_rows: int = DATA_ROWS,
                   anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says which rows are anchors, ``label`` is the label that counts.
    """
    spark = vectors.sparkSession
    rows = rows_of(vectors.where(label.isNotNull()), vec_id, vector, label=label.cast("long"),
                   anchor=F.coalesce(anchors, F.lit(False)))
    rows = materialize(rows.withColumn("number", F.monotonically_increasing_id()), "mining-rows")
    columns = ["id", "label", "v", "number"]
    cores = spark.sparkContext.defaultParallelism

    def dealt(part: DataFrame, size: int, as_planes: bool, name: str) -> DataFrame:
        tasks = max(1, -(-part.count() // size))
        return materialize(part.select(columns).repartition(tasks).mapInPandas(_pack(size, as_planes), _BLOCKS), name)

    data = dealt(rows, data_rows, True, "mining-data")
    slices = max(1, min(data.count(), 4 * cores))
    data = data.select("dim", F.pmod(F.xxhash64("number"), F.lit(slices)).cast("int").alias("slice"),
                       *[F.col(c).alias(f"d_{c}") for c in ("n", "planes", "ids", "labels", "v")])
    own = dealt(rows.where("anchor"), anchor_rows, False, "mining-anchors").drop("planes").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    found = own.join(data, ["dim", "slice"]).mapInPandas(
        _positives(positives), "number long, pos int, anchor_id long, found_id long, score long")
    first = Window.partitionBy("number", "pos").orderBy(F.desc("score"), "found_id")
    chosen = materialize(found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives), "mining-positives")
    limits = chosen.groupBy("number").agg(F.collect_list(F.struct("pos", "nth", "score")).alias("positives"))
    picked = own.join(limits, "number").join(data, ["dim", "slice"]).mapInPandas(
        _negatives(negatives, positives), "number long, pos int, nth int, negative_id long, negative_score long")
    last = Window.partitionBy("number", "pos", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = picked.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["number", "pos", "nth"]).select(
        "anchor_id", F.col("found_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("score").alias("positive_score"), "negative_score")
