"""Intervals, resampling, model calls, batch functions and matrices against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest

from lodestream.functions.tables import Sentences, trimmed_mean
from lodestream.operators import contract, intervals, resampling
from lodestream.operators.calls import answered
from lodestream.operators.intervals import interval_join
from lodestream.plans import extensions
from lodestream.plans.catalogue import QUERIES


def test_intervals_of_any_length(spark):
    draw = random.Random(1)
    points = [(k, draw.randint(-5000, 5000)) for k in range(300)] + [(900, None), (901, 2**62), (902, -(2**62))]
    spans = []
    for k in range(200):
        a = draw.randint(-5000, 5000)
        spans.append((k, a, a + draw.choice([0, 1, 9, 10, 11, 40, 80, 3000])))
    spans += [(500, -(2**62), 2**62), (501, 10, 9), (502, None, 5), (503, 5, None), (504, points[0][1], points[0][1])]
    wanted = {(p, i) for p, t in points if t is not None for i, a, b in spans if a is not None and b is not None and a <= t <= b}
    df, held = spark.createDataFrame(points, "p int, t bigint"), spark.createDataFrame(spans, "i int, a bigint, b bigint")
    got = [tuple(r) for r in interval_join(df, held, "t", "a", "b", 10).select("p", "i").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert interval_join(df, held.limit(0), "t", "a", "b", 10).count() == 0


def test_bootstrap_sums_equal_the_same_draws(spark):
    draw = random.Random(2)
    rows = [(k * 7 - 40, draw.randint(-900, 900)) for k in range(150)] + [(None, 3), (4, None)]
    got = {r["resample"]: (r["total"], r["n"]) for r in resampling.bootstrap_sums(spark.createDataFrame(rows, "k bigint, x bigint").repartition(3), "k", "x", 40).collect()}
    mask = 2**64 - 1

    def count(k, b):
        z = (k * resampling.GAMMA + (b + 1) * resampling.SECOND) & mask
        z = ((z ^ z >> 30) * resampling.FIRST) & mask
        z = ((z ^ z >> 27) * resampling.SECOND) & mask
        return sum(s <= (z ^ z >> 31) >> 11 for s in resampling.steps())

    for b in range(40):
        times = [(count(k, b), x) for k, x in rows if k is not None and x is not None]
        assert got[b] == (sum(n * x for n, x in times), sum(n for n, _ in times))
    drawn = resampling.counts(np.arange(2000), 200)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02


def test_model_calls(spark):
    def model(texts: pd.Series) -> pd.Series:
        if (texts == "bad").any():
            raise ValueError("bad")
        return texts.str.upper()

    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "bad"), (5, "c"), (6, None)], "id bigint, t string").coalesce(1)
    recorded = spark.createDataFrame([(2, 7, "old b"), (5, 6, "other version"), (6, 7, "kept"), (99, 7, "x")], "id bigint, version int, answer string")
    got = {r["id"]: (r["answer"], r["origin"]) for r in answered(requests, recorded, "id", "t", model, 7).collect()}
    assert got == {1: ("A", "called"), 2: ("old b", "recorded"), 3: (None, "no text"), 4: (None, "failed"), 5: ("C", "called"), 6: ("kept", "recorded")}


def test_batch_functions(spark):
    texts = [(1, "One. Two two!  \n?? Three"), (2, None), (3, ""), (4, "..."), (5, "é"), (1, "again. more")]
    got = sorted(map(tuple, Sentences(spark.createDataFrame(texts, "id bigint, text string").coalesce(1).asTable()).collect()))
    assert [r for r in got if r[0] != 1] == [(5, 1, "é")] and [r[2] for r in got if r[0] == 1] == ["One", "again", "Two two", "more", "Three"]
    values = [(k % 7, 1 + k % 3) for k in range(20)] + [(1000, 1)]
    rows = sorted(v for v, n in values for _ in range(n))
    cut = len(rows) // 10
    mean = spark.createDataFrame(values, "v int, n int").agg(trimmed_mean("v", "n")).first()[0]
    assert mean == pytest.approx(sum(rows[cut : len(rows) - cut]) / (len(rows) - 2 * cut))


def test_slots_and_groups(spark):
    a = spark.createDataFrame([(1, 0.5, "x", 3)], "id int, `Tex-Mex (new)` double, why string, source_review_count int")
    b = spark.createDataFrame([(2, 4, None)], "id int, hours_known int, fit double")
    groups = {"a": a, "b": b}
    assert contract.slots("id", groups) == [(0, "tex_mex_new", "a"), (1, "hours_known", "b"), (2, "fit", "b")]
    assert contract.slots("id", groups, ("a",)) == [(0, "hours_known", "b"), (1, "fit", "b")]
    spine = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id int")
    assert sorted(map(tuple, contract.assemble(spine, "id", groups).collect())) == [(1, [0.5, 0.0, 0.5]), (2, [0.5, 4.0, 0.5]), (3, [0.5, 0.0, 0.5])]
    with pytest.raises(ValueError):
        contract.slots("id", {"a": a, "c": a})
    sf = "/root/testdata/sf0.001"
    for key, made, names in (("user_id", extensions.user_groups, extensions._USER_SLOTS), ("item_id", extensions.item_groups, extensions._ITEM_SLOTS)):
        assert [n for _, n, _ in contract.slots(key, made(spark, sf))] == names


def test_late_rows_are_left_out(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    kept = sum(r["n"] for r in QUERIES["ext_stream_late"](spark, sf).collect())
    assert 1.5 * n < kept < 2 * n


def test_counts_in_intervals_make_no_pairs(spark, monkeypatch):
    """Cells of three moments: intervals within one, over many, without points, with one key twice, and many at a moment."""
    monkeypatch.setattr(intervals, "CELL", 3)
    draw = random.Random(8)
    at = [(draw.choice([None, *range(60)]), k) for k in range(150)] + [(30, 1000 + k) for k in range(200)]
    held = [(k % 90, a := draw.randint(-5, 70), draw.choice([None, a - 1, a, a + 2, a + 30, 1 << 40])) for k in range(120)]
    wanted = {}
    for key, a, b in held:
        inside = [(t, p) for t, p in at if t is not None and b is not None and a <= t <= b]
        if inside:
            n, first, far = wanted.get(key, (0, 1 << 40, -1))
            wanted[key] = n + len(inside), min(first, *(p for _, p in inside)), max(far, *(t - a for t, _ in inside))
    df, rows = spark.createDataFrame(at, "t bigint, p bigint"), spark.createDataFrame(held, "i bigint, a bigint, b bigint")
    got = {r["i"]: (r["n"], r["first"], r["far"]) for r in intervals.interval_counts(df, rows, "t", "p", "i", "a", "b").collect()}
    assert got == wanted
    assert intervals.interval_counts(df.limit(0), rows, "t", "p", "i", "a", "b").count() == 0
