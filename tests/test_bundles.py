"""What is read of users and items must not depend on held-out visits."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestream.operators import bundles, geo, split
from lodestream.sources.tables import TIES

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "user_id string, item_id string, ts timestamp, rating int, review_id string, text string, reviewer_reviews int, " + ", ".join(f"{c} bigint" for c in TIES)


def reviews(spark, swap=None):
    """Five places of one user on one day, a user with a single visit, and visits without a user."""
    draw = random.Random(1)
    rows = [("same", f"place-{k}", DAY, 4, f"review-{k}", f"What the same user wrote of place {k}.", 4) for k in range(5)]
    rows += [("other", "place-0", DAY, 5, "unrelated", "Somebody else wrote of place 0 here.", 1), ("", "place-0", DAY, 5, "blank", "Nobody known wrote this text here.", 0), (None, "place-1", DAY, 5, "none", "short", 0)]
    rows += [("busy", f"place-{k}", DAY + dt.timedelta(days=draw.randint(0, 90)), draw.randint(1, 5), f"busy-{k}", "A busy reviewer. " * draw.randint(1, 9), 40) for k in range(9)]
    return spark.createDataFrame([(*r[:5], swap(r) if swap else r[5], r[6], *range(len(TIES))) for r in rows], SCHEMA)


def corpora(r):
    s = split.leave_two_out(r)
    items = split.review_corpora(split.safe_reviews(r, s), "item_id", [F.col("reviewer_reviews").desc()], 8, 900, 4000)
    users = split.review_corpora(split.safe_reviews(r, s, True), "user_id", [], 8, 900, 4000)
    return sorted(map(str, items.collect())), sorted(map(str, users.collect()))


def test_held_out_texts_change_nothing(spark):
    r = reviews(spark)
    held = {(x["user_id"], x["item_id"]) for x in split.leave_two_out(r).where("split <> 'train'").collect()}
    assert {("same", "place-0"), ("same", "place-1")} <= held and len(held) == 4
    first = corpora(r)
    assert first == corpora(r.repartition(5).orderBy(F.rand(3)))
    assert first == corpora(reviews(spark, lambda x: "Leaked words of a held-out visit." if x[:2] in held else x[5]))
    assert "Somebody else" in "".join(first[0]) and "Somebody else" not in "".join(first[1])
    assert not any("user_id=''" in x for x in first[1])


def test_bundles(spark):
    targets = spark.createDataFrame([(1, 10), (2, 11)], "user_id int, item_id int")
    history = spark.createDataFrame([(1, 11, 3, 2, "r1"), (1, 12, 5, 3, "r2"), (2, 10, 5, 2, "r3")] + [(1, 20 + k, 5, 4 + k, f"s{k}") for k in range(9)], "user_id int, item_id int, rating int, split_rank int, review_id string")
    items = spark.createDataFrame([(10, "Ten", "thai", "x"), (11, "Eleven", "thai", "y"), (12, "Twelve", "pub", "z")] + [(20 + k, f"N{k}", "pub", "w") for k in range(9)], "item_id int, name string, category string, about string")
    users = spark.createDataFrame([(1, "noise", 10), (1, "value", 90), (1, "wait", None), (2, "value", 90)], "user_id int, attribute string, score int")
    places = spark.createDataFrame([(10, "noise", 20), (10, "value", 40), (11, "value", 80)], "item_id int, attribute string, score int")
    quotes = spark.createDataFrame([(10, f"q{k}", k % 5, "Good  words about the place " + str(k)) for k in range(7)] + [(10, "q9", 5, "short")], "item_id int, review_id string, rating int, text string")
    made = lambda policy: bundles.assemble(targets, history, items, users, places, quotes, ["value"], ["noise"], policy)
    nodes = {(r["user_id"], r["id"]): r for r in made("strict").collect()}
    assert [nodes[1, f"H{k}"]["entity"] for k in range(1, 7)] == ["Eleven", "Twelve", "N0", "N1", "N2", "N3"] and (1, "H7") not in nodes
    # The shared visit was not liked, so the first agreeing attribute is the match; the other user liked one.
    assert nodes[1, "M1"]["fact"] == "both lean to noise (10, 20)" and nodes[2, "M1"]["source"] == "H1 and R1"
    assert [nodes[1, f"Q{k}"]["source"] for k in (1, 2, 3)] == ["q4", "q3", "q2"] and "Good words" in nodes[1, "Q1"]["fact"]
    assert {r["id"] for r in made("legacy").where("user_id = 1 AND id = 'M1' AND source = 'H1 and R1'").collect()} == {"M1"}
    good = bundles.validate(made("strict"), spark.createDataFrame([("zz",)], "review_id string"))
    assert [tuple(r)[1:] for r in good.collect()] == [(0, 0, 0, 0, True)] * 2
    bad = bundles.validate(made("strict").unionByName(made("strict").where("id = 'R1' AND user_id = 2").withColumns({"entity": F.lit(None).cast("string")})), spark.createDataFrame([("q3",), ("r1",)], "review_id string"))
    assert sorted(tuple(r) for r in bad.collect()) == [(1, 0, 0, 0, 2, False), (2, 1, 1, 0, 0, False)]


def test_pairs_of_a_key_in_parts(spark, monkeypatch):
    draw = random.Random(8)
    rows = [(k % 3 if k < 120 else 7, k, draw.uniform(-80, 80), draw.uniform(-170, 170)) for k in range(121)]
    df = spark.createDataFrame(rows, "u int, id int, lat double, lng double")
    monkeypatch.setattr(geo, "PART", 7)
    parts = {r["u"]: r for r in geo.pair_spread(df, "u").collect()}
    monkeypatch.setattr(geo, "PART", 512)
    whole = {r["u"]: r for r in geo.pair_spread(df, "u").collect()}
    assert set(parts) == set(whole) == {0, 1, 2} and all(parts[u]["n"] == whole[u]["n"] == 780 and abs(parts[u]["mean"] - whole[u]["mean"]) < 1e-6 and parts[u]["far"] == whole[u]["far"] for u in parts)


def test_split_of_every_visit_without_a_join(spark):
    """Repeats, visits without a rating, a time or a user, against the split itself; and the plan has one shuffle."""
    draw = random.Random(5)
    rows = [(draw.choice([None, "", *"abcdefgh"]), draw.choice([None, *"pqrstuvw"]), draw.choice([None, DAY, DAY + dt.timedelta(days=draw.randint(1, 5))]), draw.choice([None, 1, 5, 5]), "", "", 0, *(draw.randint(0, 2) for _ in TIES)) for _ in range(400)]
    r = spark.createDataFrame(rows, SCHEMA).drop("review_id", "text", "reviewer_reviews")
    made = split.with_split(r)
    columns = [*r.columns, "split_rank", "split"]
    assert sorted(map(str, made.where("newest AND split IS NOT NULL").select(columns).collect())) == sorted(map(str, split.leave_two_out(r).select(columns).collect()))
    pairs = {(x["user_id"], x["item_id"]): x["split"] for x in split.leave_two_out(r).collect()}
    every = made.collect()
    assert len(every) == sum(x[0] is not None and x[1] is not None for x in rows)
    assert all(x["split"] == pairs.get((x["user_id"], x["item_id"])) for x in every)
    assert split.with_split(r)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_bundles_send_no_table_through_the_driver(spark):
    """Small files of many rows would go out whole: only the joins of a key's few rows are left to Spark."""
    from lodestream.plans import evidence, features

    seen = []
    keep = bundles.written
    try:
        bundles.written = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
        nodes, held = evidence.bundle_nodes(spark, "/root/testdata/sf0.001")
    finally:
        bundles.written = keep
    seen.append(features.split_visits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    assert len(seen) >= 5 and not any("BroadcastHashJoin" in x or "CartesianProduct" in x for x in seen[:1] + seen[-1:])
    assert all(x.count("BroadcastExchange") == 0 for x in seen)
