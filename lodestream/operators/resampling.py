"""Bootstrap intervals of a mean by Poisson counts.

For each row and resample a count with mean 1 is drawn, by inverting the distribution at a number hashed from the row's
id and the resample's number. A task keeps the sums and counts of all resamples and adds a vector for each row, so one
row a task is all that is shuffled, and no row is repeated. Values are whole numbers (thousandths, say): sums are exact in
any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ranges import quantiles

#: The steps of a 64-bit mixing of counters (SplitMix64).
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def steps() -> list[int]:
    """The distribution function of a count with mean 1 at 0, 1, 2, ..., of 2**53."""
    out, p, total = [], np.exp(-1.0), 0.0
    for k in range(1, 19):
        total += p
        out.append(int(total * 2.0**53))
        p /= k
    return out


def counts(ids: np.ndarray, resamples: int) -> np.ndarray:
    """[row, resample]"""
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(GAMMA) + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(SECOND)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return np.searchsorted(np.array(steps(), np.uint64), (z ^ (z >> np.uint64(31))) >> np.uint64(11), side="right")


def bootstrap_sums(rows: DataFrame, key: str, value: str, resamples: int) -> DataFrame:
    """(resample, total, n) over rows with a whole number and a key each; rows without either are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(resamples, np.int64), np.zeros(resamples, np.int64)
        for b in batches:
            ids, values = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "x"))
            for at in range(0, len(ids), 64):
                drawn = counts(ids[at : at + 64], resamples)
                total += values[at : at + 64] @ drawn
                n += drawn.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.int64())) for x in (total, n)], ["total", "n"])

    whole = rows.select(F.col(key).cast("bigint").alias("k"), F.col(value).cast("bigint").alias("x")).where("k IS NOT NULL AND x IS NOT NULL")
    tasks = whole.mapInArrow(run, "total array<bigint>, n array<bigint>")
    each = tasks.select(F.posexplode(F.arrays_zip("total", "n")).alias("resample", "x"))
    return each.groupBy("resample").agg(F.sum("x.total").alias("total"), F.sum("x.n").alias("n"))


def bootstrap_interval(rows: DataFrame, key: str, value: str, resamples: int = 10_000, level: float = 0.95) -> DataFrame:
    """(low, high, resamples) of the mean of value; resamples that drew no row are left out."""
    means = bootstrap_sums(rows, key, value, resamples).where("n > 0").select(F.lit(1).alias("g"), (F.col("total") / F.col("n")).alias("m"))
    edge = (1 - level) / 2
    return quantiles(means, ["g"], "m", {"low": edge, "high": 1 - edge}).select("low", "high", F.col("n").alias("resamples"))
