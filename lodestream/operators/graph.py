"""Graphs as tables of edges: degrees, propagation, attention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b) and (b, a), each once."""
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight): 1 over the root of both ends' degrees."""
    degree = edges.groupBy("a").agg(F.count("*").alias("da"))
    return edges.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("da").alias("db")), "b").select("a", "b", (1 / F.sqrt(F.col("da") * F.col("db"))).alias("weight"))


def propagate(edges: DataFrame, vectors: DataFrame, layers: int) -> DataFrame:
    """Of vectors (id, i, x), the mean of layers 0 to ``layers``, each the weighted sum of the neighbours' one before.

    A layer is one join on the neighbour and a sum, both with a map-side combine.
    """
    every, last = vectors, vectors
    for _ in range(layers):
        last = edges.join(last.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"), "i").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        every = every.unionByName(last)
    return every.groupBy("id", "i").agg((F.sum("x") / (layers + 1)).alias("x"))


def attention(edges: DataFrame) -> DataFrame:
    """edges (a, b, score) with ``attention``, the softmax over what each a points to; the sums are grouped, so no group lies in one task."""
    top = edges.groupBy("a").agg(F.max("score").alias("_top"))
    e = edges.join(top, "a").withColumn("_e", F.exp(F.col("score") - F.col("_top")))
    total = e.groupBy("a").agg(F.sum("_e").alias("_sum"))
    return e.join(total, "a").withColumn("attention", F.col("_e") / (F.col("_sum") + 1e-9)).drop("_e", "_top", "_sum")
