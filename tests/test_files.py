"""Tables that are replaced at once, marks and logs."""

import pytest
from pyspark.sql import functions as F

from lodestream.sources import files


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(10), path)
    before = files.current_table(spark, path)
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        files.replace_table(bad, path)
    assert files.current_table(spark, path).count() == 10 and files.manifest(spark, path)["rows"] == 10
    # A table can be replaced by what is made of it, and a reader of the old version goes on.
    made = files.replace_table(files.current_table(spark, path).selectExpr("id * 2 AS id", "'x' AS more"), path)
    assert made == {"version": made["version"], "rows": 10, "columns": ["id", "more"]}
    assert sorted(r["id"] for r in files.current_table(spark, path).collect()) == list(range(0, 20, 2))
    assert sorted(r["id"] for r in before.collect()) == list(range(10))
    files.drop_versions(spark, path)
    assert files.current_table(spark, path).count() == 10
    assert len([x for x in (tmp_path / "t").iterdir() if x.is_dir()]) == 1


def test_marks_and_logs(spark, tmp_path):
    files.mark_done(spark, str(tmp_path / "d"), ["0012", "a.b"])
    (tmp_path / "d" / "other.txt").write_text("x")
    assert sorted(r[0] for r in files.done_stems(spark, str(tmp_path / "d")).collect()) == ["0012", "a.b"]
    for k in range(3):
        files.append_csv(spark.range(k, k + 2).coalesce(1), str(tmp_path / "l"))
    assert sorted(r[0] for r in files.csv_strings(spark, str(tmp_path / "l"), ["id"]).collect()) == ["0", "1", "1", "2", "2", "3"]
