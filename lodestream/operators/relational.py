"""Relational building blocks: ordered dedupe, shares, scalers, top-k, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.ranges import numbered, quantiles


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def share(df: DataFrame, keys: list[str], by: str, out: str = "share") -> DataFrame:
    """Each (keys, by) group's share of its keys' rows."""
    counts = df.groupBy(*keys, by).agg(F.count("*").alias("n"))
    return counts.withColumn(out, F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def minmax(df: DataFrame, column: str, out: str, equal: float = 0.5) -> DataFrame:
    """Scales over all rows with one broadcast row of bounds, not a window over everything."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(equal)).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_lo", "_hi")


def hash_sample(df: DataFrame, strata: list[str], key: str, k: int) -> DataFrame:
    """k rows of each stratum in the order of their keys' sha256."""
    return top_k(df, strata, [F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16).asc(), F.col(key).asc()], k)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the order, which must be ascending and name every tie."""
    order_of = F.struct(*order)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order_of).alias("_row"))
    return best.select("_row.*")


def one_hot(column: str, values: dict[str, object]) -> list[Column]:
    """A column of 0 and 1 for each declared value."""
    return [F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("double").alias(k) for k, v in values.items()]


#: Names that say that nothing known means 0; others get 0.5.
ZERO_MARKS = ("_known", "_confidence", "source_review_count", "cuisine", "meal_")


def fill_by_name(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna({c: 0.0 if any(m in c for m in ZERO_MARKS) else 0.5 for c in columns})


def first_existing(df: DataFrame, names: list[str]) -> Column:
    return next((F.col(n) for n in names if n in df.columns), F.lit(None))


def to_contract(df: DataFrame, columns: dict[str, Column | None]) -> DataFrame:
    """The contract's columns in its order; one that is missing gets its default."""
    return df.select(*[F.col(c) if c in df.columns else default.alias(c) for c, default in columns.items()])


def numeric_columns(df: DataFrame, but: list[str]) -> list[str]:
    return [f.name for f in df.schema if f.name not in but and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]


def medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact medians of several columns; n counts the rows of a group."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"))
    for c in columns:
        out = out.join(quantiles(df, keys, c, {c: 0.5}).drop("n"), keys, "left")
    return out


def dense_encoder(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """(key, idx): the distinct keys in order, numbered from 0; null has no number."""
    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key)], out, 0)
