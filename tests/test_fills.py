"""Fills under a budget against their sequential versions, and guards that keep state."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import ranges, selection
from lodestream.streaming import budget, windows


def test_numbers_within_groups_over_many_ranges(spark):
    df = spark.range(0, 60_000, 1, 6).selectExpr("CASE WHEN id % 10 < 8 THEN null ELSE id % 7 END AS g", "id * 7919 % 60013 AS v", "id")
    got = ranges.numbered_within(df, ["g"], [F.col("v")]).orderBy("g", "v").collect()
    seen = {}
    for r in got:
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["place"] == seen[r["g"]]


def sequential(rows, groups, limit):
    """rows (id, g, score, cost); groups {g: (total, covered)}."""
    left = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])) for g in groups}
    cover, picked, spent = {g: c for g, (_, c) in groups.items()}, [], 0
    for g in sorted(groups):
        for r in left[g][: max(0, -(-groups[g][0] // 4) - cover[g])]:
            picked.append(r), left[g].remove(r)
            cover[g] += 1
            spent += r[3]
    if spent > limit:
        raise ValueError
    while spent < limit:
        for g in sorted(groups, key=lambda g: (cover[g] / groups[g][0], g)):
            fits = [r for r in left[g] if r[3] <= limit - spent]
            if cover[g] / groups[g][0] < 0.5 and fits:
                picked.append(fits[0]), left[g].remove(fits[0])
                cover[g] += 1
                spent += fits[0][3]
                break
        else:
            break
    return [r[0] for r in picked]


@pytest.mark.parametrize("seed, n_groups, limit", [(1, 1000, 9000), (2, 6, 31), (3, 6, 67), (4, 40, 10**6)])
def test_coverage_fill_equals_the_sequential_one(spark, seed, n_groups, limit):
    draw = random.Random(seed)
    rows = [(k, draw.randrange(n_groups), round(draw.random(), 2), draw.choice([1, 1, 2, 3, 5, 9])) for k in range(8 * n_groups)]
    totals = {g: [0, draw.randint(0, 3)] for g in range(n_groups)}
    for r in rows:
        totals[r[1]][0] += 1
    groups = {g: (n + c, c) for g, (n, c) in totals.items() if n}
    df = spark.createDataFrame(rows, "id int, g int, score double, cost int")
    held = spark.createDataFrame([(g, *x) for g, x in groups.items()], "g int, total int, covered int")
    fill = lambda: [r["id"] for r in selection.coverage_fill(df, held, "id", "g", [F.col("score").desc(), F.col("id").asc()], "cost", limit).orderBy("slot").collect()]
    try:
        wanted = sequential(rows, groups, limit)
    except ValueError:
        with pytest.raises(ValueError):
            fill()
        return
    assert fill() == wanted


def in_order(calls, logged, monthly, run_calls):
    used, runs, out = {}, {}, {}
    for month, run, seq in sorted(calls, key=lambda c: c[2]):
        ok = runs.get((month, run), 0) < run_calls and logged.get(month, 0) + used.get(month, 0) < monthly
        out[seq] = ok
        used[month], runs[month, run] = used.get(month, 0) + ok, runs.get((month, run), 0) + ok
    return out


#: (calls, logged, monthly, run ceiling): the two ledgers of the budget's rules, and a drawn one.
LEDGERS = [
    ([("2026-09", "a", 1)], {"2026-09": 3}, 3, 10.0),
    ([("2026-09", "a", k) for k in range(3)], {}, 100, 0.064),
    ([(f"2026-0{m}", draw, s) for s, (m, draw) in enumerate((random.Random(s).choice([1, 2, 3]), random.Random(s + 999).choice("abcde")) for s in range(400))], {"2026-01": 20}, 60, 0.5),
]


@pytest.mark.parametrize("calls, logged, monthly, ceiling", LEDGERS)
def test_guard_in_batch(spark, calls, logged, monthly, ceiling):
    df = spark.createDataFrame(calls, "month string, run string, seq bigint").repartition(3)
    had = spark.createDataFrame(list(logged.items()), "month string, n bigint")
    got = {r["seq"]: r["allowed"] for r in selection.budget_guard(df, had, monthly, ceiling, 0.032, [F.col("seq")]).collect()}
    assert got == in_order(calls, logged, monthly, int((ceiling + 1e-9) // 0.032))


@pytest.mark.parametrize("calls, logged, monthly, ceiling", LEDGERS[1:])
def test_guard_keeps_its_state_over_a_restart(spark, tmp_path, calls, logged, monthly, ceiling):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(m, r, s, logged.get(m, 0)) for m, r, s in calls]
    try:
        for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
            spark.createDataFrame(part, "month string, run string, seq bigint, logged bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = windows.table_stream(spark, f"{tmp_path}/in")
            found = windows.drain(budget.guarded(stream, monthly, ceiling, 0.032), f"{tmp_path}/out", "append")
        got = {r["seq"]: r["allowed"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == in_order(calls, logged, monthly, int((ceiling + 1e-9) // 0.032)) and len(found.collect()) == len(calls)
