"""Negative samples: one for each pair, never a positive, hard ones from the pool, also for users who met nearly all."""

import random

from lodestream.operators import negatives


def pairs(draw):
    rows = {(u, i) for u in range(40) for i in draw.sample(range(150), draw.randint(1, 40))}
    rows |= {(100, i) for i in range(149)}  # all but one
    rows |= {(101, i) for i in range(150)}  # all
    return rows


def test_each_pair_gets_an_unmet_item(spark):
    rows = pairs(random.Random(1))
    df = spark.createDataFrame(sorted(rows), "user_id bigint, item_id bigint")
    for pool in (None, spark.createDataFrame([(i, (i + k) % 150, k) for i in range(150) for k in range(1, 6)], "item_id bigint, other bigint, rank int")):
        got = [tuple(r) for r in negatives.negatives(df, pool, seed=3).collect()]
        assert sorted(g[:2] for g in got) == sorted(p for p in rows if p[0] != 101)
        assert not {(u, n) for u, _, n in got} & rows
        assert {n for u, _, n in got if u == 100} == {149}
        if pool is not None:
            near = sum(0 < (n - i) % 150 < 6 for u, i, n in got if u < 40)
            assert 0.3 < near / sum(u < 40 for u, *_ in got) < 0.6
        assert got and sorted(map(tuple, negatives.negatives(df.repartition(7), pool, seed=3).collect())) == sorted(got)


def test_unmet_items_by_number(spark):
    """Every number of a user names another unmet item, and all are named."""
    rows = pairs(random.Random(2))
    df = spark.createDataFrame(sorted(rows), "user_id bigint, item_id bigint")
    items = negatives.popularity(df)
    got = {}
    for seed in range(6):
        for r in negatives.by_number(df, df, items, 150, seed).collect():
            got.setdefault(r["user_id"], set()).add(r["negative"])
    met = {u: {i for v, i in rows if v == u} for u, _ in rows}
    assert 101 not in got and all(not got[u] & met[u] for u in got)
    assert got[100] == {149} and sum(len(x) for x in got.values()) > 1000
