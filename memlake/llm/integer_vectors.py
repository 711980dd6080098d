"""Integer vectors and ordered selections shared by the exact search operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
_NONE = np.iinfo(np.int64).min


def usable(vector: str) -> Column:
    """True where the vector and all its components are there and finite (NaN sorts above infinity in Spark)."""
    every = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(every, F.lit(False))


def quantised(vector: str) -> Column:
    """floor(256 * x) of every component; values beyond a long saturate."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def rows_of(vectors: DataFrame, vec_id: str, vector: str, **more: Column) -> DataFrame:
    """``id, v`` and the named columns of every row that takes part, repeated rows once."""
    return vectors.where(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), quantised(vector).alias("v"),
        *[c.alias(name) for name, c in more.items()]).distinct()


def packed(values: np.ndarray) -> tuple[bytes, int]:
    """The bytes of an integer matrix in the narrowest width that holds it, and that width."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return values.astype(kind).tobytes(), np.dtype(kind).itemsize


def unpacked(data: bytes, width: int, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{width}").reshape(rows, columns).astype(np.int64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of two long matrices; sums beyond a long wrap, as long arithmetic does."""
    most = (np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    for kind, exact in ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53)):
        if most < exact:  # every partial sum is a whole number that the type holds exactly
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


def first_of_each(key: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of every key, by falling score, then rising id."""
    order = np.lexsort((ident, ~score, key))
    sorted_key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(order) else np.empty(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


class Best:
    """The first ``k`` of each of ``rows`` keys over all that was offered so far."""

    def __init__(self, rows: int, k: int):
        self.rows, self.k = rows, k
        self.key = np.empty(0, np.int64)
        self.score, self.ident = self.key, self.key

    def offer(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if len(key):
            key, score, ident = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.ident, ident)))
            at = first_of_each(key, score, ident, self.k)
            self.key, self.score, self.ident = key[at], score[at], ident[at]

    def worst(self) -> np.ndarray:
        """Of every key the lowest score held, where ``k`` are held; the smallest long elsewhere."""
        out = np.full(self.rows, _NONE)
        full = np.bincount(self.key, minlength=self.rows) >= self.k
        low = np.full(self.rows, np.iinfo(np.int64).max)
        np.minimum.at(low, self.key, self.score)
        out[full] = low[full]
        return out


def top_cells(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that can be among the first ``k`` allowed columns of their row; equal scores all stay."""
    if scores.shape[1] > k:
        held = np.where(allowed, scores, _NONE)
        line = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        allowed = allowed & (scores >= line[:, None])
    return np.nonzero(allowed)
