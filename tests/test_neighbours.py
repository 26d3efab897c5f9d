"""Ranking with exclusion, and the index of cells against exact search."""

import random

from pyspark.sql import functions as F

from lodestream.operators import neighbours, ranking
from lodestream.plans import evidence


def test_seen_items_are_left_out_before_the_best_are_kept(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(k, [draw.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for k in range(200)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 4)]
    items = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    seen = [(q, i) for q in range(0, 200, 25) for i in range(200) if draw.random() < (0.98 if q == 50 else 0.4)]
    known = spark.createDataFrame(seen + seen[:20], "query_id bigint, vec_id bigint")
    for size in (1 << 26, 8 * 4 * 3):
        monkeypatch.setattr(ranking, "BLOCK_BYTES", size)
        found = {}
        for r in ranking.best_items(items, items.where("vec_id % 25 = 0"), 6, seen=known).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        for q in range(0, 200, 25):
            wanted = sorted((i for i in range(200) if i != q and (q, i) not in set(seen)), key=lambda i: (-sum(x * y for x, y in zip(rows[q][1], rows[i][1])), i))[:6]
            assert [i for _, i in sorted(found.get(q, []))] == wanted


def test_index_finds_nine_in_ten(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = e.where("vec_id % 100 = 0")
    found = neighbours.neighbours(e, 50, queries=queries)
    exact = ranking.best_items(e, queries, 50, normalise=True)
    assert neighbours.recall(found, exact, "vec_id").first()[0] >= 0.9


def test_copies_parts_and_odd_vectors(spark, monkeypatch):
    """A third of the rows are one vector; all cells that hold neighbours of the rows tried are looked into, here of all rows, so results are exact."""
    monkeypatch.setattr(neighbours, "PART", 16)
    draw = random.Random(3)
    rows = [(k, [1.0, 0.0, 0.5] if k % 3 == 0 else [draw.gauss(0, 1) for _ in range(3)]) for k in range(240)] + [(900, None), (901, []), (902, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = {}
    for r in neighbours.neighbours(df, 5, target=1.0).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["other"]))

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9)

    assert set(got) == set(range(240))
    for k in range(240):
        wanted = sorted((i for i in range(240) if i != k), key=lambda i: (-cosine(rows[k][1], rows[i][1]), i))[:5]
        assert [i for _, i in sorted(got[k])] == wanted, k


def shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_vectors_are_sent_to_groups_and_not_to_cells(spark, monkeypatch):
    """In two groups 15,416 rows are shuffled here, with those of the exact search for the rows tried; cell by cell it was 74,893."""
    monkeypatch.setattr(neighbours, "GROUPS", 2, raising=False)
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    before = shuffled(spark)
    assert neighbours.neighbours(e, 50).count() == 25000
    assert shuffled(spark) - before < 20 * 500 + 2 * neighbours.TRIED * 50


def test_draws_from_neighbours_shuffle_few_rows(spark, monkeypatch):
    """Every row of the query, and no pairs of a query and a cell in a shuffle."""
    monkeypatch.setattr(neighbours, "GROUPS", 2, raising=False)
    before = shuffled(spark)
    found = evidence.dm17_neighbour_pool(spark, "/root/testdata/sf0.01").collect()
    assert len({(r["user_id"], r["item_id"]) for r in found}) == len(found) == 500
    assert shuffled(spark) - before < 50000


def test_groups_have_about_as_many_queries(spark, monkeypatch):
    """A cell with half of all queries is in several groups; a group has no more than ASKED, about."""
    counts = {0: 5000} | {c: 50 for c in range(1, 101)}
    for asked, wanted in ((1 << 15, neighbours.GROUPS), (100, 100)):
        monkeypatch.setattr(neighbours, "ASKED", asked)
        n, groups = neighbours.groups_of(counts, list(range(101)))
        assert n == wanted and set(groups) == set(counts) and len(groups[0]) >= n // 2
        sizes = [sum(counts[c] * g.count(i) / len(g) for c, g in groups.items()) for i in range(n)]
        assert 0 < min(sizes) and max(sizes) < 1.6 * 10000 / n
    assert neighbours.groups_of({}, [0]) == (neighbours.GROUPS, {})


def test_items_of_a_querys_group_are_left_out(spark, monkeypatch):
    """As if all its pairs were in ``seen``; null and groups that no query has are none."""
    draw = random.Random(6)
    rows = [(k, [float(draw.randint(-3, 3)) for _ in range(3)], draw.choice([None, 3, 7, 11, 1 << 40])) for k in range(150)]
    items = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, g bigint").repartition(3)
    asked = items.where("vec_id % 10 = 0 AND (g IS NULL OR g <> 11)")
    pairs = spark.createDataFrame([(q[0], i[0]) for q in rows for i in rows if q[2] is not None and q[2] == i[2]], "query_id bigint, vec_id bigint")
    for size in (1 << 24, 8 * 3 * 4):
        monkeypatch.setattr(ranking, "BLOCK_BYTES", size)
        monkeypatch.setattr(ranking, "GIVEN", 4)
        monkeypatch.setattr(ranking, "SCORES", 64)
        a = ranking.best_items(items, asked, 6, group="g")
        b = ranking.best_items(items, asked, 6, seen=pairs)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 50
