"""Selection: quotas, protected groups, bands, interleaving and budgets, without gathering what is chosen from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.ranges import numbered, numbered_within, running
from lodestream.operators.relational import top_k
from lodestream.sources.shared import written


def quantile_cut(ranked: DataFrame, bins: int, n: Column, rank: str = "rank", out: str = "bin") -> DataFrame:
    """Bins by linear quantile edges of the ranks 1..n: bin k holds ranks up to 1 + (n - 1) * k / bins."""
    return ranked.withColumn(out, F.greatest(F.lit(1), F.ceil((F.col(rank) - 1) * bins / F.greatest(n - 1, F.lit(1)))).cast("int"))


def top_with_champions(df: DataFrame, group: str, order: list[Column], n: int, least_groups: int) -> DataFrame:
    """The first n, but so many best ones of groups not among them that least_groups groups are; ``champion`` marks those."""
    first = df.orderBy(*order).limit(n)
    held = first.select(group).distinct()
    needed = max(0, least_groups - held.count())
    if not needed:
        return first.withColumn("champion", F.lit(False))
    best = top_k(df.join(F.broadcast(held), group, "left_anti"), [group], order, 1).orderBy(*order).limit(needed)
    kept = best.count()
    return best.withColumn("champion", F.lit(True)).unionByName(first.orderBy(*order).limit(n - kept).withColumn("champion", F.lit(False)))


def quotas(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, quota): k dealt out by the groups' shares, one each at least; what rounding gives too much goes back, a row each, from the smallest quota over one on."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("_n").alias("_all"))))
    q = n.select(group, F.bround(F.greatest(F.lit(1.0), F.col("_n") / F.col("_all") * k)).cast("int").alias("quota"))
    over = W.orderBy(F.col("quota") <= 1, "quota", group)
    q = q.withColumn("_k", F.row_number().over(over)).crossJoin(F.broadcast(q.agg((F.sum("quota") - k).alias("_excess"))))
    return q.select(group, (F.col("quota") - F.when((F.col("_k") <= F.col("_excess")) & (F.col("quota") > 1), 1).otherwise(0)).alias("quota"))


def interleave(first: DataFrame, second: DataFrame, order: list[Column], share: int) -> DataFrame:
    """Both ranked lists with ``turn`` from 0, ``side`` and ``place``: ``share`` of the first and one of the second a turn; what is left over of either follows."""
    a = numbered(first, order, "place").withColumns({"turn": F.floor((F.col("place") - 1) / share), "side": F.lit(0)})
    b = numbered(second, order, "place").withColumns({"turn": F.col("place") - 1, "side": F.lit(1)})
    return a.unionByName(b)


def budget_fill(first: DataFrame, second: DataFrame, group: str, order: list[Column], cost: str, share: int, limit: float) -> DataFrame:
    """What a budget takes of two lists, with ``slot`` from 1 and ``before``, the cost of all slots before.

    The best row of each group comes first, of the first list and then of the second, whatever it costs; the rest follows
    in turns. The budget is looked at between turns, so a turn that begins below the limit is in as a whole.
    """
    seeds, rest = [], []
    for side, df in enumerate((first, second)):
        held = df.withColumn("_top", F.row_number().over(W.partitionBy(group).orderBy(*order)) == 1)
        seeds.append(held.where("_top").drop("_top").withColumns({"turn": F.lit(-1).cast("bigint"), "side": F.lit(side), "place": F.lit(0).cast("bigint")}))
        rest.append(held.where("NOT _top").drop("_top"))
    every = seeds[0].unionByName(seeds[1]).unionByName(interleave(*rest, order, share))
    summed = running(every, [F.col("turn"), F.col("side"), F.col("place"), F.col(group)], cost, rank="slot")
    began = F.min("before").over(W.partitionBy("turn"))
    return summed.withColumn("_began", began).where((F.col("turn") < 0) | (F.col("_began") < limit)).drop("_began", "turn", "side", "place")


def stop_after(df: DataFrame, keys: list[str], order: list[Column], empty: Column, n: int) -> DataFrame:
    """Rows of each key in the order up to and with the n-th empty one in a row."""
    own = W.partitionBy(*keys).orderBy(*order)
    held = df.withColumns({"_e": empty, "_k": F.row_number().over(own)})
    last = F.coalesce(F.max(F.when(~F.col("_e"), F.col("_k"))).over(own.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    held = held.withColumn("_run", F.col("_k") - last)
    stop = F.min(F.when(F.col("_run") >= n, F.col("_k"))).over(W.partitionBy(*keys))
    return held.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("_k") <= F.col("_stop"))).drop("_e", "_k", "_run", "_stop")


def coverage_fill(rows: DataFrame, groups: DataFrame, key: str, group: str, order: list[Column], cost: str, budget: float, floor: float = 0.25, ceiling: float = 0.5) -> DataFrame:
    """The rows that a budget takes, with ``slot`` from 1, so that the groups of least coverage come first.

    groups (group, total, covered) has what there is and what is covered already. First each group gets its first rows in
    the order until ``floor`` of it is covered; if these cost too much, nothing is taken (ValueError). Then the group of
    least coverage below ``ceiling`` (ties: the least group) gets the first of its rows that the rest of the budget allows,
    again and again.

    A group's k-th pick has a coverage before it that is known at once, so the picks of all groups have one global order;
    what they cost is one running sum. Where a row does not fit, it and all that cost as much or more are out for good and
    the order is made anew, so there is one round for each distinct cost at most.
    """
    groups = groups.select(F.col(group), "total", "covered")
    ranked = numbered_within(rows, [group], order, "_place").join(groups, group)
    needed = F.greatest(F.lit(0), F.ceil(F.lit(floor) * F.col("total")) - F.col("covered"))
    first = numbered(ranked.where(F.col("_place") <= needed), [F.col(group), F.col("_place")], "slot").drop("total", "covered", "_place")
    spent, n = first.agg(F.coalesce(F.sum(cost), F.lit(0)), F.count("*")).first()
    if spent > budget:
        raise ValueError(f"the floor costs {spent}, the budget is {budget}")
    taken, rest = [written(first)], ranked.where(F.col("_place") > needed).drop("total", "covered", "_place")
    while budget > spent:
        counts = taken[-1].groupBy(group).agg(F.count("*").alias("_more"))
        groups = written(groups.join(counts, group, "left").select(group, "total", (F.col("covered") + F.coalesce("_more", F.lit(0))).alias("covered")))
        rest = written(rest.where(F.col(cost) <= budget - spent))
        able = numbered_within(rest, [group], order, "_place").join(groups, group).withColumn("_cover", (F.col("covered") + F.col("_place") - 1) / F.col("total")).where(F.col("_cover") < ceiling)
        summed = written(running(able, [F.col("_cover"), F.col(group)], cost, "_spent", rank="_turn"))
        over = F.min(F.when((F.col("_spent") + F.col(cost) > budget - spent) | (F.col("_spent") >= budget - spent), F.col("_turn")))
        stop, every = summed.agg(over, F.count("*")).first()
        got = summed if stop is None else summed.where(F.col("_turn") < stop)
        got = written(got.withColumn("slot", F.col("_turn") + n).select(*rows.columns, "slot"))
        taken.append(got)
        if stop is None or not every:
            break
        more, k = got.agg(F.coalesce(F.sum(cost), F.lit(0)), F.count("*")).first()
        spent, n = spent + more, n + k
        rest = rest.join(got.select(key), key, "left_anti")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def budget_guard(calls: DataFrame, logged: DataFrame, monthly: int, run_ceiling: float, unit: float, order: list[Column]) -> DataFrame:
    """calls (month, run, ...) with ``allowed``: while the run's calls cost no more than its ceiling and the month's, those
    logged before (month, n) included, are no more than ``monthly``. Calls that are let through count whether they succeed or not.

    A month that is full stays full, so a run's allowed calls are its first ones, and a month's the first of these.
    """
    most = int((run_ceiling + 1e-9) // unit)
    asked = numbered_within(calls, ["month", "run"], order, "_in_run")
    first = numbered_within(asked.where(F.col("_in_run") <= most), ["month"], order, "_in_month").join(logged.select("month", F.col("n").alias("_logged")), "month", "left")
    passed = first.withColumn("allowed", F.col("_in_month") + F.coalesce("_logged", F.lit(0)) <= monthly)
    return passed.select(*calls.columns, "allowed").unionByName(asked.where(F.col("_in_run") > most).select(*calls.columns, F.lit(False).alias("allowed")))
