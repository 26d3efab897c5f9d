"""Numbers and running sums over all rows in an order, without a window over all rows.

Rows are dealt out by ranges of the order and written once, each with the number of its range and its place there. All
that follows reads this one table, so ranges' sizes and rows can't belong to different bounds; a row for each range, as
many as there are shuffle partitions, is all that one task sums up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.sources.shared import written

#: Fixed by Spark: monotonically_increasing_id has the partition above this bit and the row's place below.
_PLACE_BITS = 33


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, written in ranges of the order, with ``_p``, the number of its range, and ``_k``, its place there from 0."""
    held = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return written(held).withColumns({"_p": F.shiftright("_at", _PLACE_BITS), "_k": place}).drop("_at")


def before_range(sums: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """sums (keys, _p, value) with ``_before``, the sum of value over the ranges before."""
    own = W.partitionBy(*keys) if keys else W
    upto = F.sum(value).over(own.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    return sums.withColumn("_before", F.coalesce(upto, F.lit(0)))


def numbered(df: DataFrame, order: list[Column], out: str = "rank", first: int = 1) -> DataFrame:
    """df with the rows' numbers in the order; ties must be named by it, or are numbered in any order."""
    held = ranged(df, order)
    sizes = before_range(held.groupBy("_p").agg(F.count("*").alias("_n")), "_n").select("_p", "_before")
    return held.join(F.broadcast(sizes), "_p").withColumn(out, F.col("_before") + F.col("_k") + first).drop("_p", "_k", "_before")


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """df with the rows' numbers from 1 within their keys, whose rows lie in several ranges if they are many."""
    held = ranged(df, [*map(F.col, keys), *order])
    parts = before_range(held.groupBy(*keys, "_p").agg(F.count("*").alias("_n"), F.min("_k").alias("_first")), "_n", keys)
    h, p = held.alias("h"), parts.select(*keys, "_p", "_first", "_before").alias("p")
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    number = (F.col("p._before") + F.col("h._k") - F.col("p._first") + 1).alias(out)
    return h.join(p, [*same, F.col("h._p") == F.col("p._p")]).select(*[F.col(f"h.{c}") for c in df.columns if c != out], number)


def running(df: DataFrame, order: list[Column], value: str, out: str = "before", rank: str | None = None) -> DataFrame:
    """df with the sum of value over all rows before each in the order, and the rows' numbers from 1; null counts as 0."""
    held = ranged(df, order)
    sums = held.groupBy("_p").agg(F.count("*").alias("_n"), F.coalesce(F.sum(value), F.lit(0)).alias("_s"))
    sums = before_range(sums, "_n").withColumnRenamed("_before", "_first")
    sums = before_range(sums, "_s").select("_p", "_before", "_first")
    own = F.sum(value).over(W.partitionBy("_p").orderBy("_k").rowsBetween(W.unboundedPreceding, -1))
    held = held.join(F.broadcast(sums), "_p").withColumn(out, F.col("_before") + F.coalesce(own, F.lit(0)))
    if rank:
        held = held.withColumn(rank, F.col("_first") + F.col("_k") + 1)
    return held.drop("_p", "_k", "_before", "_first")


def quantiles(df: DataFrame, keys: list[str], column: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, and n, of each group; nulls are left out.

    Equal values are counted first, with a partial count in every task. The counts are dealt out by ranges of group and
    value; a group's ranges are summed, and of each group only the ranges that hold a wanted rank are read again, each by
    one task. So a group's distinct values, however many, never meet in one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    held = ranged(counts, [*map(F.col, keys), F.col("_v")])
    sums = held.groupBy(*keys, "_p").agg(F.sum("_c").alias("_n"))
    sums = before_range(sums, "_n", keys).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    place = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_all") - 1)).alias("at")) for name, p in points.items()]))
    at = F.col("_q.at")
    wanted = sums.withColumn("_q", place).where((F.ceil(at) >= F.col("_before")) & (F.floor(at) < F.col("_before") + F.col("_n")))
    wanted = written(wanted.select(*keys, "_p", "_before", "_all", "_q"))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    needed = wanted.select(*keys, "_p", "_before").distinct()
    near = held.alias("h").join(needed.alias("w"), [*same, F.col("h._p") == F.col("w._p")]).select(*[F.col(f"h.{k}") for k in keys], "h._p", "_v", "_c", "_before")
    upto = F.sum("_c").over(W.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")
    near = near.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c")).drop("_before")
    hit = lambda k: (F.col("_from") <= k) & (k < F.col("_upto"))
    found = near.alias("h").join(wanted.alias("w"), [*same, F.col("h._p") == F.col("w._p")]).where(hit(F.floor(at)) | hit(F.ceil(at)))
    value = lambda name, k: F.max(F.when((F.col("_q.name") == name) & hit(k), F.col("_v")))
    part = lambda name: F.max(F.when(F.col("_q.name") == name, at - F.floor(at)))
    low, high = (lambda n: value(n, F.floor(at))), (lambda n: value(n, F.ceil(at)))
    return found.groupBy(*[F.col(f"h.{k}") for k in keys]).agg(F.max("_all").alias("n"), *[(low(n) + (high(n) - low(n)) * part(n)).alias(n) for n in points])
