"""Rules of single operators, by hand and by brute force."""

import math
import random

from pyspark.sql import functions as F

from lodestream.functions import expr
from lodestream.operators import geo, ranges, ranking, relational, selection, split


def test_alignment_policy(spark):
    # The policy's truth table.
    cases = [("value", 0.9, 0.8, "strict", True), ("value", 0.2, 0.2, "strict", False), ("noise", 0.2, 0.3, "strict", True), ("wait", 0.8, 0.8, "strict", False), ("value", 1.0, 0.6, "strict", False), ("value", 1.0, 0.6, "legacy", True)]
    for attribute, u, i, policy, wanted in cases:
        got = spark.range(1).select(expr.aligned(F.lit(attribute), F.lit(u), F.lit(i), ["value"], ["noise"], policy)).first()[0]
        assert got is wanted, (attribute, u, i, policy)


def test_bounded_text(spark):
    texts = ["  a  b\n", " ", "x" * 2000, "y" * 50, "z", None]
    df = spark.createDataFrame([(texts,)], "t array<string>")
    assert df.select(expr.bounded_text(F.col("t"), 5, 900, 930)).first()[0] == ["a b", "x" * 900, "y" * 27]


def test_corpora_ignore_row_order(spark):
    rows = [(k % 3, k, " ".join(["w"] * (k % 7))) for k in range(60)]
    docs = spark.createDataFrame(rows, "g int, id int, t string")
    made = [sorted(map(str, split.corpora(x, "g", "id", "t", [F.length("t").desc(), F.col("id").asc()], 8, 900, 40).collect())) for x in (docs, docs.orderBy(F.rand(2)).repartition(5))]
    assert made[0] == made[1]


def test_quantile_cut_is_not_ntile(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 7)], "rank int")
    assert [r["bin"] for r in selection.quantile_cut(df, 4, F.lit(6)).orderBy("rank").collect()] == [1, 1, 2, 3, 4, 4]


def test_near_pairs_on_the_globe(spark):
    draw = random.Random(6)
    rows = [(k, draw.uniform(-90, 90), draw.uniform(-180, 180)) for k in range(150)] + [(200, 89.9, 10.0), (201, 89.9, -170.0), (202, -90.0, 0.0), (203, -89.99, 99.0), (204, 10.0, 179.99), (205, 10.0, -179.99), (206, 0.0, 180.0), (207, 0.0, -180.0)]

    def km(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * expr.EARTH_KM * math.asin(math.sqrt(min(1.0, x)))

    points = spark.createDataFrame(rows, "id int, lat double, lng double")
    for reach in (5.0, 300.0, 2500.0):
        found = {(r["id"], r["other"]) for r in geo.near_pairs(points, points, reach).collect()}
        assert found == {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and km(a, b) <= reach}


def test_best_items_in_blocks(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(k, [draw.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for k in range(300)]
    items = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 8 * 4 * 3)
    found = {}
    for r in ranking.best_items(items, items.where("vec_id % 25 = 0"), 7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for k in range(0, 300, 25):
        wanted = sorted((i for i in range(300) if i != k), key=lambda i: (-sum(x * y for x, y in zip(rows[k][1], rows[i][1])), i))[:7]
        assert [i for _, i in sorted(found[k])] == wanted


def test_numbers_over_ranges(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id % 1000 AS k", "id AS v")
    assert sorted(map(tuple, relational.dense_encoder(df, "k").collect())) == [(k, k) for k in range(1000)]
    ranked = ranges.numbered(df, [F.col("k").desc(), F.col("v").asc()]).collect()
    order = sorted(ranked, key=lambda r: (-r["k"], r["v"]))
    assert [r["rank"] for r in order] == list(range(1, 5001))


def test_quantiles(spark):
    draw = random.Random(1)
    values = [draw.choice([None, 1.0, 2.5, 7.0, draw.random()]) for _ in range(501)]
    df = spark.createDataFrame([(k % 2, v) for k, v in enumerate(values)] + [(5, None)], "g int, x double")
    found = {r["g"]: (r["a"], r["b"]) for r in relational.quantiles(df, ["g"], "x", {"a": 0.05, "b": 0.5}).collect()}
    wanted = {r["g"]: tuple(r["p"]) for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.5))).alias("p")).collect() if r["p"]}
    assert found.keys() == wanted.keys() and all(abs(a - b) < 1e-12 for g in found for a, b in zip(found[g], wanted[g]))


def test_numbers_and_sums_of_two_million_rows(spark):
    """A wide column beside the order, so that no plan can share what deals the rows out."""
    df = spark.range(0, 2_000_000, 1, 8).selectExpr("pmod(xxhash64(id), 1000000007) AS k", "id", "repeat(string(id), 6) AS pad", "id % 7 AS v")
    order = [F.col("k").asc(), F.col("id").asc()]
    got = ranges.running(df, order, "v", rank="n")
    assert got.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (2_000_000, 1, 2_000_000)
    spread = got.withColumn("o", F.struct("k", "id")).withColumn("p", F.floor(F.col("n") / 1000)).groupBy("p").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.min("o").alias("lo"), F.max("o").alias("hi"), F.min("before").alias("s"), F.sum("v").alias("v")).orderBy("p").collect()
    assert all(x["hi"] < y["lo"] and x["b"] + 1 == y["a"] and x["s"] + x["v"] == y["s"] for x, y in zip(spread, spread[1:]))


def test_quantiles_of_one_group_of_many_values(spark):
    n = 500_000
    df = spark.range(0, n, 1, 8).selectExpr("cast(null AS int) AS g", "cast((id * 7919) % 500009 AS double) AS x")
    held = ranges.ranged(df.groupBy("g", "x").count(), [F.col("g"), F.col("x")]).groupBy("_p").count().collect()
    assert max(r["count"] for r in held) < 2 * n / len(held) + 1 and len(held) > 1
    got = ranges.quantiles(df, ["g"], "x", {"a": 0.0, "b": 0.3337, "c": 1.0}).collect()
    wanted = df.agg(F.percentile("x", F.array(*map(F.lit, (0.0, 0.3337, 1.0))))).first()[0]
    assert [tuple(r) for r in got] == [(None, n, *wanted)]


def test_budget_is_looked_at_between_turns(spark):
    draw = random.Random(4)
    first = [(k, draw.randint(0, 5), draw.random(), draw.randint(1, 4)) for k in range(60)]
    second = [(100 + k, draw.randint(0, 7), draw.random(), draw.randint(1, 4)) for k in range(23)]
    for limit in (0, 25, 60, 10_000):
        lists = [sorted(x, key=lambda r: (-r[2], r[0])) for x in (first, second)]
        taken = [next(r for r in x if r[1] == g) for x in lists for g in sorted({r[1] for r in x})]
        left = [[r for r in x if r not in taken] for x in lists]
        while sum(r[3] for r in taken) < limit and (left[0] or left[1]):
            taken += left[0][:4] + left[1][:1]
            left = [left[0][4:], left[1][1:]]
        a, b = (spark.createDataFrame(x, "id int, g int, s double, cost int") for x in (first, second))
        got = selection.budget_fill(a, b, "g", [F.col("s").desc(), F.col("id").asc()], "cost", 4, limit).orderBy("slot").collect()
        assert [r["id"] for r in got] == [r[0] for r in taken] and [r["slot"] for r in got] == list(range(1, len(got) + 1))
