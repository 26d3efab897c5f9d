"""The driver's tables in the roles of visits, places and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIES = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, ts, rating) and the columns that break ties: an order line is a customer's visit to a part."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", *TIES)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # Both are large, and orders' file is small beside its rows: by sorting, not through the driver.
    joined = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    rating = 1 + F.col("l_quantity").cast("int") % 5
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"), rating.alias("rating"), *TIES)


#: The same as SQL.
VISITS_SQL = """visits AS (SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, 1 + CAST(l_quantity AS INTEGER) % 5 AS rating,
  l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def review_id() -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")], F.col("l_quantity").cast("int").cast("string"))


def reviews(spark: SparkSession, sf_dir: str, v: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Visits as reviews: (review_id, text, reviewer_reviews) beside the columns of visits; some have no text or a short one.

    ``v`` has the visits where they are at hand, with reviewer_reviews and more columns. Places are joined by sorting: their
    file is small, but not their rows. With ``by``, rows are dealt out by it before they get their texts, which are longer.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_brand")
    if v is None:
        v = with_counts(visits(spark, sf_dir))
    text = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") == 6, "ok").otherwise(F.concat("p_name", F.lit(" of "), "p_brand", F.lit(" came with order "), F.col("l_orderkey").cast("string"), F.repeat(F.lit(" again"), F.col("l_linenumber"))))
    joined = v.where("user_id IS NOT NULL").join(part.hint("merge"), "item_id")
    if by:
        joined = joined.repartition(by)
    return joined.select(*v.columns, review_id().alias("review_id"), text.alias("text"))


def with_counts(v: DataFrame) -> DataFrame:
    """Visits with reviewer_reviews, how many their user has."""
    return v.withColumn("reviewer_reviews", F.count("*").over(W.partitionBy("user_id")))


REVIEWS_SQL = f"""{VISITS_SQL}, reviews AS (SELECT v.*, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_quantity::INTEGER AS review_id,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'ok' ELSE p_name || ' of ' || p_brand || ' came with order ' || l_orderkey || repeat(' again', l_linenumber) END AS text,
  count(*) OVER (PARTITION BY user_id) AS reviewer_reviews FROM visits v JOIN part ON item_id = p_partkey)"""
