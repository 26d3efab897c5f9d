"""Points in intervals: pairs, through buckets of time as wide as the intervals are long, and counts, without any pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ranges import ranged
from lodestream.sources.shared import written

#: Moments, and pieces of intervals, that a task holds at once.
CELL = 1 << 16
_MOST = (1 << 63) - 1


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """points and intervals, each point with every interval that it lies in, ends included; all three are whole numbers.

    An interval of length up to width * 2**level goes into buckets of that size, of which it touches one or two, however
    long it is; a point goes into one bucket for each level that there is. So neither a long interval nor a wide spread of
    lengths multiplies rows, and what meets in a bucket lies near. Rows with a null end, or that end before they start,
    join nothing. Both sides are plain tables to the join, so Spark splits a bucket that very many rows are in.
    """
    # In doubles: rounding keeps the order, so a point between two ends is in a bucket between theirs.
    wide = lambda c: F.col(c).cast("double")
    level: Column = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((wide(end) - wide(start)) / F.lit(float(width)), F.lit(1.0))))).cast("int")
    bucket = lambda c, lv: F.floor(wide(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), lv))).cast("bigint")
    held = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    lv = F.col("_level")
    held = held.withColumn("_bucket", F.explode(F.sequence(bucket(start, lv), bucket(end, lv))))
    held = written(held)
    levels = [r[0] for r in held.select("_level").distinct().collect()]  # of the bits of a number, 64 at most
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    asked = asked.withColumn("_bucket", bucket(at, lv))
    return asked.join(held, ["_level", "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bucket")


def least_of(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x from low to before high, which is larger; from tables of the least of 1, 2, 4, ... numbers in a row."""
    tables = [x]
    while 2 << (len(tables) - 1) <= len(x):
        step, last = 1 << (len(tables) - 1), tables[-1]
        tables.append(np.minimum(last[:-step], last[step:]))
    level = np.frexp((high - low).astype(float))[1] - 1
    out = np.full(len(low), _MOST, np.int64)
    for k, t in enumerate(tables):
        own = level == k
        out[own] = np.minimum(t[low[own]], t[high[own] - (1 << k)])
    return out


def interval_counts(points: DataFrame, intervals: DataFrame, at: str, name: str, key: str, start: str, end: str) -> DataFrame:
    """(key, n, first, far) of the intervals of each key with a point, ends included: how many points lie in them, the least
    name among these, and the longest time from an interval's start to a point of it. All are whole numbers.

    No pair is made, so an interval may hold any number of points. Points are summed up by their moment; moments in order are
    dealt into cells of CELL. An interval's piece in its first and in its last cell are asked of these, and what lies between
    of the cells' sums, of which every task has one row a cell: a row for CELL moments.
    """
    held = points.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("bigint").alias("_when")).agg(F.count("*").alias("_n"), F.coalesce(F.min(F.col(name).cast("bigint")), F.lit(_MOST)).alias("_first"))
    held = ranged(held, [F.col("_when")]).withColumn("_c", F.floor(F.col("_k") / CELL))
    sums = held.groupBy("_p", "_c").agg(F.min("_when").alias("low"), F.max("_when").alias("high"), F.sum("_n").alias("n"), F.min("_first").alias("first")).orderBy("low").toArrow()
    low, high, n, first = (sums.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "n", "first"))
    spark = points.sparkSession
    names = spark.createDataFrame(pa.table({"_p": sums.column("_p"), "_c": sums.column("_c"), "_cell": pa.array(np.arange(len(low)))}))
    moments = held.join(F.broadcast(names), ["_p", "_c"]).select("_cell", "_when", "_n", "_first")
    sent = spark.sparkContext.broadcast((low, high, np.r_[0, np.cumsum(n)], first))
    kind = intervals.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, upto, first = sent.value
        for b in batches:
            a, e = b.column("_a").to_numpy(), b.column("_b").to_numpy()
            one, last = np.searchsorted(high, a, "left"), np.searchsorted(low, e, "right") - 1
            some = np.flatnonzero(one <= last)
            more = some[one[some] < last[some]]
            # The last piece of an interval has what lies in the cells between.
            between, least = np.zeros(len(a), np.int64), np.full(len(a), _MOST, np.int64)
            between[more] = upto[last[more]] - upto[one[more] + 1]
            inner = more[last[more] > one[more] + 1]
            least[inner] = least_of(first, one[inner] + 1, last[inner])
            rows = np.r_[some, more]
            cell = np.r_[last[some], one[more]]
            tail = np.arange(len(rows)) < len(some)
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(rows)), *[pa.array(x, pa.int64()) for x in (a[rows], e[rows], cell, np.where(tail, between[rows], 0), np.where(tail, least[rows], _MOST))]], ["_id", "_a", "_b", "_cell_", "_between", "_least"])

    asked = intervals.where(F.col(start) <= F.col(end)).select(F.col(key).alias("_id"), F.col(start).cast("bigint").alias("_a"), F.col(end).cast("bigint").alias("_b"))
    asked = written(asked.mapInArrow(pieces, f"_id {kind}, _a bigint, _b bigint, _cell_ bigint, _between bigint, _least bigint"))
    # A cell that very many pieces ask is sent to several tasks, each with a part of them.
    parts = written(asked.groupBy("_cell_").agg(F.ceil(F.count("*") / CELL).alias("_parts")))
    asked = asked.join(F.broadcast(parts), "_cell_").withColumn("_part_", F.pmod(F.xxhash64("_id", "_a", "_b"), F.col("_parts"))).drop("_parts")
    moments = moments.join(F.broadcast(parts.withColumnRenamed("_cell_", "_cell")), "_cell").select("_cell", "_when", "_n", "_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"))

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column("_when").to_numpy())
        at, n, first = (left.column(c).to_numpy()[order] for c in ("_when", "_n", "_first"))
        a, e, between, least = (right.column(c).to_numpy() for c in ("_a", "_b", "_between", "_least"))
        i, j = np.searchsorted(at, a, "left"), np.searchsorted(at, e, "right")
        rows = np.flatnonzero(i < j)
        upto = np.r_[0, np.cumsum(n)]
        i, j = i[rows], j[rows]
        out = upto[j] - upto[i] + between[rows], np.minimum(least_of(first, i, j), least[rows]), at[j - 1] - a[rows]
        return pa.table({"key": right.column("_id").take(pa.array(rows)), "n": out[0], "first": out[1], "far": out[2]})

    found = moments.groupBy("_cell", "_part").cogroup(asked.groupBy("_cell_", "_part_")).applyInArrow(counted, f"key {kind}, n bigint, first bigint, far bigint")
    return found.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("n"), F.nullif(F.min("first"), F.lit(_MOST)).alias("first"), F.max("far").alias("far"))
