"""Every query against its SQL in DuckDB, on the smallest tables; and the parsing rules by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestream.functions import expr
from lodestream.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(("|".join(str(r[i]) for i in order) for r in found))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = QUERIES[name](spark, SF)
    theirs = con.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


def test_parsing(spark):
    one = spark.createDataFrame([("$10–20", "2 years ago"), ("$100+", "a month ago"), ("$100", "yesterday"), ("$1,000", "a day ago"), (None, None), ("", "Today"), ("$5 ", "a  week ago"), ("x", "just now"), ("$1-3 or $9", "2 years"), ("9", "5 hours ago")], "p string, a string")
    assert [tuple(r) for r in one.select(expr.price_midpoint(F.col("p")), expr.age_days(F.col("a"))).collect()] == [(15.0, 730), (100.0, 30), (None, 1), (0.5, None), (None, None), (None, 0), (5.0, 7), (None, 0), (2.0, 730), (None, None)]


def test_split_ignores_row_order(spark):
    first = QUERIES["dm1_leave_two_out"](spark, "/root/testdata/sf0.001")
    from lodestream.operators.split import leave_two_out
    from lodestream.sources.tables import visits

    again = leave_two_out(visits(spark, "/root/testdata/sf0.001").orderBy(F.rand(3)).repartition(7))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.select(*first.columns).collect()))
