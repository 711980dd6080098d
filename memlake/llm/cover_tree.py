"""Operator 11: exact top-k inner products by dual-tree search over a cover tree.

1. A bounded sample (the first ``sample_rows`` by hash) gives the upper levels of
   the tree: each node is split into children by a farthest-first net, which ends
   when it covers the node at half its radius or has ``fan`` members.  Nodes that
   stand for at most ``data_rows`` rows are not split; they are the *cells*.  Only
   this skeleton comes from a sample; every row is indexed.
2. All rows, queries and data together, go to the cell of the nearest centre
   and are ordered by their distance from it.  Consecutive rows form blocks: the
   lower nodes, each a shell of its cell with its own leaves, centres and covering
   radii.  Of rows with equal vectors the ``k + 1`` smallest ids are data, as no
   query can return more of them.
3. A query group first meets its own cell, which with the sample gives the
   worst kth score of each query.  A pair of group and cell, then of group and
   block, then of query and leaf is pruned when its greatest possible inner product
   lies under that score.  The bound of a pair of nodes with centres g and c, radii
   s and r is the smaller of ``g.c + |g|r + |c|s + rs`` and, with greatest norms m
   and n, ``(m^2 + n^2 - max(0, |g - c| - r - s)^2) / 2``.
4. What is left is scored exactly and merged by query.

The result does not depend on the sample, the number of partitions or the order
of tasks.  Pairs are formed by an equi-join on the cell; a block or group has a
bounded number of rows, so a cell of any size is spread over tasks.

Defined results: null vectors, vectors with a null, NaN or infinite component
and rows without an id take no part; rows equal in id and vector are one; rows
that share an id are never each other's candidates; vectors meet only those of
their own length; empty vectors score 0; components saturate at a long and sums
wrap; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.integer_vectors import Best, inner_products, packed, rows_of, top_cells, unpacked
from memlake.session import materialize

SAMPLE_ROWS, FAN = 2_048, 16
DATA_ROWS, QUERY_ROWS, BLOCK_LEAVES = 4_096, 1_024, 16
_NONE = int(np.iinfo(np.int64).min)
_SAFE = 2.0 ** 62  # products beyond it may wrap, so nothing is pruned there


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    p, c = points.astype(np.float64), centres.astype(np.float64)
    return np.sqrt(np.maximum((p * p).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (p @ c.T), 0))


def slack(radius):
    """A radius with room for the rounding of distances."""
    return radius * (1 + 1e-9) + 1e-3


def net(points: np.ndarray, first: int, most: int, cover: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first centres with the nearest of them and its distance for every point."""
    chosen, near = [first], np.zeros(len(points), int)
    d = distances(points, points[[first]])[:, 0]
    while len(chosen) < most and d.max(initial=0) > cover:
        far = int(d.argmax())
        e = distances(points, points[[far]])[:, 0]
        near[e < d] = len(chosen)
        d = np.minimum(d, e)
        near[far], d[far] = len(chosen), 0
        chosen.append(far)
    return chosen, near, d


def cells_of(points: np.ndarray, leaf: float, fan: int = FAN) -> np.ndarray:
    """Centres of the lowest nodes of the skeleton (rows of ``points``)."""
    if not len(points):
        return points
    root = int(distances(points, points.mean(axis=0, keepdims=True))[:, 0].argmin())
    out, open_ = [], [(np.arange(len(points)), root)]
    while open_:
        members, centre = open_.pop()
        own = points[members]
        radius = distances(own, points[[centre]]).max(initial=0)
        if len(members) <= leaf or radius <= slack(0):
            out.append(centre)
            continue
        chosen, near, _ = net(own, int(np.flatnonzero(members == centre)[0]), fan, radius / 2)
        open_ += [(members[near == j], int(members[c])) for j, c in enumerate(chosen)]
    return points[sorted(out)]


class Skeleton:
    """Centres of all cells by vector length, and the sample rows that bound the kth scores."""

    def __init__(self, sample: list[tuple[int, list[int]]], k: int, leaf: float):
        self.k, self.ids, self.points, self.centres, self.base = k, {}, {}, {}, {}
        cells = 0
        for dim in sorted({len(v) for _, v in sample}):
            own = [(i, v) for i, v in sample if len(v) == dim]
            self.ids[dim] = np.array([i for i, _ in own], np.int64)
            self.points[dim] = np.array([v for _, v in own], np.int64).reshape(len(own), dim)
            self.centres[dim] = cells_of(self.points[dim], leaf)
            self.base[dim] = cells
            cells += len(self.centres[dim])

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance from its centre of rows of one length; -1 and 0 where the sample has no such row."""
        centres = self.centres.get(v.shape[1])
        if centres is None:
            return np.full(len(v), -1), np.zeros(len(v))
        d = distances(v, centres)
        near = d.argmin(axis=1)
        return near + self.base[v.shape[1]], d[np.arange(len(v)), near]

    def centre(self, cell: int, dim: int) -> np.ndarray:
        return self.centres[dim][cell - self.base[dim]]

    def worst(self, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Kth scores of the rows over the sample: lower bounds of the final ones."""
        best = Best(len(ids), self.k)
        _offer(best, ids, v, np.full(len(ids), _NONE), self.ids.get(v.shape[1], np.empty(0, np.int64)),
               self.points.get(v.shape[1], np.empty((0, v.shape[1]), np.int64)))
        return best.worst()


def _offer(best: Best, ids, v, least, data_ids, data, rows=None) -> None:
    """Scores of the query rows against ``data`` from ``least`` upwards, without the rows of a query's own id."""
    rows = np.arange(len(ids)) if rows is None else rows
    if not len(rows) or not len(data_ids):
        return
    s = inner_products(v[rows], data)
    allowed = s >= least[rows][:, None]
    for i in np.flatnonzero(np.isin(ids[rows], data_ids)):
        allowed[i, data_ids == ids[rows[i]]] = False
    r, c = top_cells(s, allowed, best.k)
    best.offer(rows[r], s[r, c], data_ids[c])


def _matrix(batch: pd.DataFrame, dim: int) -> np.ndarray:
    return np.array(list(batch["v"]), dtype=np.int64).reshape(len(batch), dim)


def _assign(skeleton: Skeleton):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby(batch["v"].map(len)):
                v = _matrix(own, dim)
                cell, dist = skeleton.cells(v)
                bits = [row.astype("<i8").tobytes() for row in v]
                yield pd.DataFrame({"id": own["id"], "query": own["query"], "dim": dim, "cell": cell, "dist": dist, "v": bits})
    return run


_BLOCKS = ("query boolean, cell int, dim int, block string, n int, width int, ids array<long>, v binary, centre binary, "
           "radius double, norm double, low double, high double, starts array<int>, heads array<int>, radii array<double>, "
           "norms array<double>, worst array<long>")


def _block(key: tuple, ids: list, dist: list, raw: list, skeleton: Skeleton) -> tuple:
    query, cell, dim = key
    v = np.frombuffer(b"".join(raw), dtype="<i8").reshape(len(ids), dim).astype(np.int64)
    ids, dist = np.array(ids, np.int64), np.array(dist)
    middle = v[int(distances(v, v.mean(axis=0, keepdims=True))[:, 0].argmin())]
    radius = float(distances(v, middle[None, :]).max())
    leaves = 1 if query or len(ids) < 4 * BLOCK_LEAVES else BLOCK_LEAVES
    chosen, near, d = net(v, int(distances(v, middle[None, :])[:, 0].argmin()), leaves, radius / 2)
    order = np.argsort(near, kind="stable")
    v, ids, d, near = v[order], ids[order], d[order], near[order]
    starts = np.searchsorted(near, np.arange(len(chosen)))
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    data, width = packed(v)
    return (query, cell, dim, f"{cell}:{dim}:{ids[0]}:{dist[0]!r}:{len(ids)}", len(ids), width, ids, data,
            middle.astype("<i8").tobytes(), radius, float(norm.max()), float(dist.min()), float(dist.max()), starts,
            place[chosen], np.maximum.reduceat(d, starts), np.maximum.reduceat(norm, starts),
            skeleton.worst(ids, v) if query else None)


def _pack(skeleton: Skeleton, data_rows: int, query_rows: int):
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, dist, raw = None, [], [], []
        for batch in batches:
            for query, cell, dim, i, d, v in zip(*(batch[c] for c in ("query", "cell", "dim", "id", "dist", "v"))):
                if key != (query, cell, dim) or len(ids) == (query_rows if query else data_rows):
                    if ids:
                        yield pd.DataFrame([_block(key, ids, dist, raw, skeleton)], columns=names)
                    key, ids, dist, raw = (query, cell, dim), [], [], []
                ids.append(i)
                dist.append(d)
                raw.append(v)
        if ids:
            yield pd.DataFrame([_block(key, ids, dist, raw, skeleton)], columns=names)
    return run


def pair_bound(g, g_norm, s, m, c, c_norm, r, n, gap):
    """Greatest inner product that a pair of nodes allows (arrays broadcast); ``gap`` is the distance of the centres."""
    r, s = slack(r), slack(s)
    by_centre = g + g_norm * r + c_norm * s + r * s
    by_gap = (m * m + n * n - np.maximum(0, gap * (1 - 1e-9) - r - s) ** 2) / 2
    return np.where(m * n >= _SAFE, np.inf, np.minimum(by_centre, by_gap) * (1 + 1e-12) + 1)


def _wanted(skeleton: Skeleton, cells: dict[int, tuple[int, float, float]]):
    """Cells that a query group still has to visit, with the distance of the two centres.

    ``cells``: length, greatest distance and greatest norm of the data of each cell.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, q in batch.iterrows():
                g = np.frombuffer(q["centre"], dtype="<i8").astype(np.float64)
                least, visits = float(np.min(q["worst"])), []
                for cell, (dim, far, norm) in cells.items():
                    if dim != q["dim"] or cell == q["cell"]:
                        continue
                    gap = 0.0
                    if cell >= 0:
                        c = skeleton.centre(cell, dim).astype(np.float64)
                        gap = float(np.linalg.norm(g - c))
                        top = pair_bound(g @ c, np.linalg.norm(g), q["radius"], q["norm"], c, np.linalg.norm(c), far, norm, gap)
                        if top < least:
                            continue
                    visits.append({"cell": cell, "gap": gap})
                yield pd.DataFrame({"block": [q["block"]], "least": [least], "visits": [visits]})
    return run


def _search(k: int, held: int = 64):
    """Scores of pairs of query group and data block; states of at most ``held`` groups are kept."""
    def flushed(states: dict) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"block": b, "pos": s.key.astype(np.int32), "query_id": ids[s.key], "vec_id": s.ident,
                                        "score": s.score}) for b, (s, ids, *_) in states.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[str, tuple] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.block not in states:
                    if len(states) == held:
                        yield flushed(states)
                        states = {}
                    v = unpacked(row.v, row.width, row.n, row.dim)
                    ids = np.asarray(row.ids)
                    states[row.block] = (Best(len(ids), k), ids, v, np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)),
                                         np.asarray(row.worst, dtype=np.int64))
                best, ids, v, norm, least = states[row.block]
                least = np.maximum(least, best.worst())
                data, data_ids = unpacked(row.d_v, row.d_width, row.d_n, row.dim), np.asarray(row.d_ids)
                starts, ends = np.asarray(row.d_starts), np.append(np.asarray(row.d_starts)[1:], row.d_n)
                heads = data[np.asarray(row.d_heads)].astype(np.float64)
                top = pair_bound(v.astype(np.float64) @ heads.T, norm[:, None], 0.0, norm[:, None], heads,
                                 np.sqrt((heads ** 2).sum(axis=1))[None, :], np.asarray(row.d_radii)[None, :],
                                 np.asarray(row.d_norms)[None, :], distances(v, heads))
                first = int(top.max(axis=0).argmax())
                for leaves in ([first], [j for j in range(len(starts)) if j != first]):
                    open_ = top[:, leaves] >= least[:, None]
                    rows = np.flatnonzero(open_.any(axis=1))
                    some = [j for j, any_ in zip(leaves, open_.any(axis=0)) if any_]
                    at = np.concatenate([np.arange(starts[j], ends[j]) for j in some]) if some else np.empty(0, int)
                    _offer(best, ids, v, least, data_ids[at], data[at], rows)
                    least = np.maximum(least, best.worst())
        if states:
            yield flushed(states)
    return run


_PAIR = ["block", "dim", "n", "width", "ids", "v", "worst", "d_n", "d_width", "d_ids", "d_v", "d_starts", "d_heads", "d_radii",
         "d_norms"]
_FOUND = "block string, pos int, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          sample_rows: int = SAMPLE_ROWS, data_rows: int = DATA_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each row for which ``queries`` holds."""
    spark = vectors.sparkSession
    rows = materialize(rows_of(vectors, vec_id, vector, query=F.coalesce(queries, F.lit(False))), "cover-rows")
    copies = Window.partitionBy("v").orderBy("id")
    data = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).select(
        "id", "v", F.lit(False).alias("query"))
    members = materialize(data.unionByName(rows.where("query").select("id", "v", "query")), "cover-members")
    sample = members.where("NOT query").select("id", "v").orderBy(F.xxhash64("v"), "id").limit(sample_rows).collect()
    total = members.count()
    skeleton = Skeleton([(r["id"], r["v"]) for r in sample], k, data_rows * len(sample) / max(1, total))

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (4 * data_rows)))
    placed = materialize(members.mapInPandas(
        _assign(skeleton), "id long, query boolean, dim int, cell int, dist double, v binary"), "cover-placed")
    blocks = materialize(placed.repartitionByRange(tasks, "cell", "dim", "dist", "id").sortWithinPartitions(
        "query", "cell", "dim", "dist", "id").mapInPandas(_pack(skeleton, data_rows, query_rows), _BLOCKS), "cover-blocks")
    cells = {r["cell"]: (r["dim"], r["far"], r["norm"]) for r in blocks.where("NOT query AND cell >= 0").groupBy("cell", "dim").agg(
        F.max("high").alias("far"), F.max("norm").alias("norm")).collect()}

    groups = blocks.where("query").select("block", "cell", "dim", "n", "width", "ids", "v", "worst", "centre", "radius", "norm")
    # rows of a length that the sample lacks have no cell; they meet all blocks of their length
    key = F.when(F.col("cell") < 0, -F.col("dim") - 1).otherwise(F.col("cell"))
    shells = blocks.where("NOT query").select(
        key.alias("key"), F.col("dim").alias("d_dim"), "low", "high",
        *[F.col(c).alias(f"d_{c}") for c in ("n", "width", "ids", "v", "starts", "heads", "radii", "norms", "norm")])
    own = groups.withColumn("key", key).join(shells, "key").where("dim = d_dim").select(_PAIR).mapInPandas(_search(k), _FOUND)
    own = materialize(own, "cover-own")

    ranked = Window.partitionBy("block", "pos").orderBy(F.desc("score"), "vec_id")
    reached = own.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k).where(F.col("nth") == k).groupBy(
        "block").agg(F.map_from_entries(F.collect_list(F.struct("pos", "score"))).alias("reached"))
    better = F.transform("worst", lambda w, i: F.greatest(w, F.coalesce(F.element_at("reached", i), F.lit(_NONE).cast("long"))))
    groups = materialize(groups.where("cell >= 0").join(reached, "block", "left").withColumn(
        "worst", F.when(F.col("reached").isNull(), F.col("worst")).otherwise(better)).drop("reached"), "cover-groups")
    visits = groups.select("block", "cell", "dim", "centre", "radius", "norm", "worst").mapInPandas(
        _wanted(skeleton, cells), "block string, least double, visits array<struct<cell: int, gap: double>>")
    # a pair of group and shell goes where the distance of the centres alone puts it out of reach
    gap = F.greatest(F.lit(0.0), F.col("gap") - F.col("radius") - F.col("high"), F.col("low") - F.col("gap") - F.col("radius"))
    gap = F.greatest(F.lit(0.0), gap * (1 - 1e-9) - 1e-2)
    reach = (F.col("norm") * F.col("norm") + F.col("d_norm") * F.col("d_norm") - gap * gap) / 2 + 1
    near = (reach >= F.col("least")) | (F.col("norm") * F.col("d_norm") >= _SAFE)
    others = groups.join(visits.select("block", "least", F.inline("visits").alias("key", "gap")), "block").join(
        shells, "key").where(near).select(_PAIR).mapInPandas(_search(k), _FOUND)
    final = own.unionByName(others).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
