"""Small window helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list, rank: str = "rank") -> DataFrame:
    """Number the rows of each key from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: list[str], order: list, k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    Written as ``row_number() <= k`` so the optimizer keeps only ``k`` rows per
    key on each task before the shuffle (WindowGroupLimit).  ``k = None`` keeps
    all rows.
    """
    rows = numbered(df, keys, order, rank)
    return rows if k is None else rows.where(F.col(rank) <= k)
