"""Positions and running values over keys of any size, without one task per key.

Rows are range-sorted by key and order, so a large key is cut into consecutive
ranges.  Inside a range plain windows number the rows; what the ranges before
it hold is carried in.  Only the first key of a range can have rows in earlier
ranges, so what is carried has at most one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.session import materialize


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` written in ranges of ``keys`` and ``order`` (ascending), numbered by ``__range``."""
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return materialize(ranged.withColumn("__range", F.spark_partition_id()), "ranges")


def _carried(ranged: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Sums of ``values`` over the earlier ranges of a key, for the ranges that continue one."""
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    parts = ranged.groupBy(*keys, "__range").agg(*[v.alias(n) for n, v in values.items()]).select(*named, "__range", *values)
    by_key = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))])
    earlier = by_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    spread = parts.withColumn("__ranges", F.count("*").over(by_key)).where("__ranges > 1")
    return spread.select(*[f"__k{i}" for i in range(len(keys))], F.col("__range").alias("__at"),
                         *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in values])


def _joined(ranged: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)],
                  F.col("__range") == F.col("__at"))
    # at most two rows a range: the key it continues and the key it leaves to the next
    return ranged.join(F.broadcast(carried), same, "left").drop(*[f"__k{i}" for i in range(len(keys))], "__at")


def with_running(df: DataFrame, keys: list[str], order: list[str], **sums: Column) -> DataFrame:
    """``df`` with the named sums over the rows of the key up to and including each row, by ascending ``order``."""
    ranged = in_ranges(df.withColumns({f"__v_{n}": v for n, v in sums.items()}), keys, order)
    joined = _joined(ranged, _carried(ranged, keys, {n: F.sum(f"__v_{n}") for n in sums}), keys)
    so_far = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    return joined.withColumns({n: F.coalesce(f"__before_{n}", zero) + F.coalesce(F.sum(f"__v_{n}").over(so_far), zero) for n in sums}
                              ).drop("__range", *[f"__before_{n}" for n in sums], *[f"__v_{n}" for n in sums])


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``df`` with the place of each row among the rows of its key, from 1, by ascending ``order``."""
    return with_running(df, keys, order, **{name: F.lit(1).cast("long")})
