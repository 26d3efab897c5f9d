"""Audits and worklists by hand."""

import json

import pytest

from lodestream.operators import audits


def test_freeze_issues(spark):
    bodies = {
        1: {"total_reviews": 1, "outcome": "scraped", "reviews": ["a"]},
        2: None,
        3: "{bro",
        4: {"total_reviews": 3, "reviews": ["a"], "outcome": "scraped"},
        5: {"outcome": "error"},
        6: {"outcome": "scraped", "reviews": []},
        7: {},
        8: {"outcome": "no_reviews_tab", "total_reviews": 0},
        9: {"outcome": "no_reviews_tab"},
        10: {"outcome": "bot_detection", "total_reviews": 2},
    }
    catalogue = spark.createDataFrame([(k, k != 10, 5 if k == 8 else 0 if k == 9 else None) for k in bodies], "place_id int, eligible boolean, rating_count int")
    rows = [(k, b if isinstance(b, str) else json.dumps(b)) for k, b in bodies.items() if b is not None]
    held = spark.createDataFrame(rows, "place_id int, body string")
    found = {}
    for r in audits.freeze_issues(catalogue, held).collect():
        found.setdefault(r["issue"], []).append(r["place_id"])
    names = audits.ISSUES
    assert found == {names[0]: [2], names[1]: [3], names[2]: [4], names[3]: [5], names[4]: [6], names[5]: [7], names[6]: [8]}
    assert {(r["issue"], r["n"], r["ready"]) for r in audits.freeze_audit(catalogue, held).collect()} == {(x, 1, False) for x in names}
    assert [tuple(r) for r in audits.freeze_audit(catalogue.where("place_id IN (1, 9)"), held).select("n", "ready").distinct().collect()] == [(0, True)]


def test_joins_that_stop(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,), (None,)], "k int"), spark.createDataFrame([(2, "x")], "k int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in audits.one_to_one(a, b, "k").collect()) == [(0, None), (0, None), (1, None), (2, "x")]
    with pytest.raises(ValueError, match=r"twice on the right: \[2\]"):
        audits.one_to_one(a, b.union(b), "k")
    with pytest.raises(ValueError, match="twice on the left"):
        audits.one_to_one(b.union(b), a, "k")


def test_action_union(spark):
    work = spark.createDataFrame([(1, "old"), (2, "old"), (3, "new"), (4, "none")], "id int, action string")
    old, new = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "id int, x string"), spark.createDataFrame([(3, 7)], "id int, y int")
    rows, audit = audits.action_union(work, "id", {"old": old, "new": new})
    assert sorted((r["id"], r["x"], r["y"]) for r in rows.collect()) == [(1, "a", None), (1, "b", None), (3, None, 7)]
    assert sorted(map(tuple, audit.collect())) == [("new", 1, 1, 0, 0, 0), ("none", 1, 0, 1, 0, 0), ("old", 2, 1, 1, 1, 1)]


def test_what_is_tried_again(spark):
    asked = spark.createDataFrame([(k,) for k in range(1, 10)], "place_id int")
    tried = spark.createDataFrame(
        [(2, False, None, None, None, None), (3, True, "error", "x", "2026-09-01T00:00:00", 0), (4, True, "error", "x", "2026-09-09T00:00:00+00:00", 0), (5, True, "error", "Cannot allocate memory", "2026-09-09", 0),
         (6, True, "scraped", "Too many open files", "2026-09-01", 3), (7, True, "error", None, "soon", 0), (8, True, "error", None, None, 2), (9, True, "scraped", None, "2026-09-01", 0)],
        "place_id int, readable boolean, outcome string, message string, at string, n int",
    )
    got = lambda *a: sorted(r[0] for r in audits.to_process(asked, tried, *a).collect())
    assert got([], False, None) == [1, 2]
    assert got([], True, None) == [1, 2, 3, 4, 5, 7, 9]
    assert got(["error"], False, None) == [2, 3, 4, 5, 7, 8]
    assert got(["error"], False, "2026-09-05T00:00:00") == [2, 3, 5, 7, 8]
