"""Negative samples: for each training pair an item that the user has not met, half of them hard ones.

Draws are hashes of user, item, seed and round, so they depend on no partitioning. A hard draw is a neighbour of the
pair's item, from a pool, or else one of the most popular quarter (100 items at least); the others are uniform. A draw
that the user has met is drawn again, uniformly. What is still rejected after ROUNDS is drawn from the user's unmet items
by their number, so no pair is left without, however much its user has met; only users who have met all items get none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ranges import numbered, numbered_within
from lodestream.sources.shared import written

ROUNDS = 6


def drawn(seed: int, what: str) -> Column:
    """A number below 2**48 for a pair."""
    text = F.concat_ws(":", F.lit(what), F.lit(str(seed)), F.col("user_id").cast("string"), F.col("item_id").cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def popularity(pairs: DataFrame) -> DataFrame:
    """(item_id, r): items by how many pairs they are in, from 0; ties by id."""
    n = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    return written(numbered(n, [F.col("n").desc(), F.col("item_id").asc()], "r", 0).select("item_id", "r"))


def negatives(pairs: DataFrame, pool: DataFrame | None = None, hard: float = 0.5, seed: int = 0) -> DataFrame:
    """pairs (user_id, item_id), each once, with ``negative``; pool (item_id, other, rank) has the neighbours of items."""
    pairs = written(pairs.select("user_id", "item_id").distinct())
    items = popularity(pairs)
    n = items.count()
    want_hard = drawn(seed, "kind") / float(1 << 48) < hard
    uniform = lambda k: drawn(seed, f"round {k}") % max(n, 1)
    if pool is None:
        popular = min(n, max(100, n // 4))
        asked = pairs.withColumn("r", F.when(want_hard, drawn(seed, "hard") % max(popular, 1)).otherwise(uniform(0)))
        draws = asked.join(items.withColumnRenamed("item_id", "negative"), "r").select("user_id", "item_id", "negative")
    else:
        sizes = pool.groupBy("item_id").agg(F.count("*").alias("_size"))
        near = pairs.where(want_hard).join(sizes, "item_id").withColumn("rank", drawn(seed, "hard") % F.col("_size") + 1)
        near = near.join(pool, ["item_id", "rank"]).select("user_id", "item_id", F.col("other").alias("negative"))
        near = written(near)
        rest = pairs.join(near.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").withColumn("r", uniform(0))
        draws = near.unionByName(rest.join(items.withColumnRenamed("item_id", "negative"), "r").select("user_id", "item_id", "negative"))
    kept = []
    met = pairs.withColumnRenamed("item_id", "negative").withColumn("_met", F.lit(True))
    for k in range(1, ROUNDS + 1):
        tested = written(draws.join(met, ["user_id", "negative"], "left"))
        kept.append(tested.where("_met IS NULL").select("user_id", "item_id", "negative"))
        left = tested.where("_met").select("user_id", "item_id")
        if left.isEmpty():
            return _every(kept)
        draws = left.withColumn("r", uniform(k)).join(items.withColumnRenamed("item_id", "negative"), "r").select("user_id", "item_id", "negative")
    return _every([*kept, by_number(left, pairs, items, n, seed)])


def by_number(asked: DataFrame, pairs: DataFrame, items: DataFrame, n: int, seed: int) -> DataFrame:
    """A negative for each of asked, uniform over what its user has not met.

    With u unmet items before it, the j-th item that a user has met, of number s, has s - j = u. So the unmet item of
    number u comes after as many met ones as have no more than u before them: places in one order of both, less places
    among the asked alone.
    """
    users = asked.select("user_id").distinct()
    met = pairs.join(users, "user_id", "left_semi").join(items, "item_id").select("user_id", "r")
    met = written(numbered_within(met, ["user_id"], [F.col("r")], "j"))
    counts = met.groupBy("user_id").agg(F.count("*").alias("m")).where(F.col("m") < n)
    wanted = asked.join(counts, "user_id").select("user_id", "item_id", (drawn(seed, "number") % (n - F.col("m"))).alias("u"))
    wanted = written(numbered_within(wanted, ["user_id"], [F.col("u"), F.col("item_id")], "own"))
    none = F.lit(None).cast("bigint")
    both = met.select("user_id", none.alias("item_id"), (F.col("r") - F.col("j") + 1).alias("u"), none.alias("own")).unionByName(wanted.select("user_id", F.col("item_id").cast("bigint"), "u", F.col("own").cast("bigint")))
    placed = numbered_within(both, ["user_id"], [F.col("u"), F.col("item_id").asc_nulls_first()], "place").where("own IS NOT NULL")
    found = placed.select("user_id", "item_id", (F.col("u") + F.col("place") - F.col("own")).alias("r"))
    return found.join(items.withColumnRenamed("item_id", "negative"), "r").select("user_id", "item_id", "negative")


def _every(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
