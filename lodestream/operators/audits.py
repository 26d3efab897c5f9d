"""Checks of tables before they are frozen: issues by name, coverage of unions, joins that must be one to one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.sources.shared import written

#: Outcomes of an attempt, and what they mean for a freeze.
RETRYABLE = ["error", "bot_detection"]
CHECKPOINT = "total_reviews bigint, outcome string, reviews array<string>"
ISSUES = ["missing_checkpoints", "invalid_json", "review_count_mismatches", "retryable_outcomes", "scraped_with_zero_reviews", "legacy_with_zero_reviews", "no_reviews_tab_with_known_positive_rating_count"]


def freeze_issues(catalogue: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(issue, place_id): every issue of every eligible place; catalogue (place_id, eligible, rating_count), checkpoints (place_id, body).

    A body that is no JSON has only that issue. A missing outcome is legacy, a missing count of reviews 0.
    """
    read = checkpoints.select("place_id", F.try_parse_json("body").isNotNull().alias("valid"), F.from_json("body", CHECKPOINT).alias("b"))
    n = F.coalesce(F.array_size("b.reviews"), F.lit(0))
    outcome = F.coalesce(F.nullif("b.outcome", F.lit("")), F.lit("legacy"))
    j = catalogue.where("eligible").select("place_id", "rating_count").join(read, "place_id", "left").select("place_id", "rating_count", "valid", F.coalesce("b.total_reviews", F.lit(0)).alias("declared"), n.alias("n"), outcome.alias("outcome"))
    ok = F.coalesce("valid", F.lit(False))
    tests: list[Column] = [
        F.col("valid").isNull(), ~F.coalesce("valid", F.lit(True)), ok & (F.col("declared") != F.col("n")), ok & F.col("outcome").isin(RETRYABLE),
        ok & (F.col("outcome") == "scraped") & (F.col("n") == 0), ok & (F.col("outcome") == "legacy") & (F.col("n") == 0),
        ok & (F.col("outcome") == "no_reviews_tab") & (F.coalesce("rating_count", F.lit(0)) > 0),
    ]
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in zip(ISSUES, tests)]))
    return j.select(F.explode(found).alias("issue"), "place_id")


def freeze_audit(catalogue: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(issue, n, first, ready) for all seven issues; ready says whether there is none of any kind."""
    n = freeze_issues(catalogue, checkpoints).groupBy("issue").agg(F.count("*").alias("n"), F.min("place_id").alias("first"))
    names = catalogue.sparkSession.createDataFrame([(x,) for x in ISSUES], "issue string")
    every = written(F.broadcast(names).join(n, "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("n"), "first"))
    return every.crossJoin(F.broadcast(every.agg((F.sum("n") == 0).alias("ready"))))


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join that stops where a key occurs twice on either side (ValueError)."""
    for side, df in (("left", left), ("right", right)):
        twice = df.groupBy(key).count().where(f"count > 1 AND {key} IS NOT NULL").select(key).take(3)
        if twice:
            raise ValueError(f"keys that occur twice on the {side}: {[r[0] for r in twice]}")
    return left.join(right, key, how)


def action_union(worklist: DataFrame, key: str, sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows of each source for the keys whose action names it, columns aligned; and (action, wanted, found, missing,
    repeated, unasked), which says whether every key is there once. An action without a source finds nothing."""
    parts = [df.withColumn("action", F.lit(name)) for name, df in sources.items()]
    every = written(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    asked = worklist.select(key, "action").distinct()
    rows = every.join(asked, [key, "action"], "left_semi")
    counts = every.groupBy(key, "action").agg(F.count("*").alias("_n"))
    both = asked.withColumn("_asked", F.lit(True)).join(counts, [key, "action"], "full")
    has, wanted = F.coalesce("_n", F.lit(0)), F.coalesce("_asked", F.lit(False))
    audit = both.groupBy("action").agg(F.count_if(wanted).alias("wanted"), F.count_if(wanted & (has > 0)).alias("found"), F.count_if(wanted & (has == 0)).alias("missing"), F.count_if(wanted & (has > 1)).alias("repeated"), F.count_if(~wanted).alias("unasked"))
    return rows, audit


#: Messages of attempts that never reached the other side.
LOST = ["Too many open files", "Cannot allocate memory"]


def to_process(asked: DataFrame, attempts: DataFrame, outcomes: list[str], retry_empty: bool, before: str | None) -> DataFrame:
    """(place_id) to be tried: those without an attempt, unless only outcomes are asked for; unreadable attempts; and those
    with one of the outcomes, at once if the attempt was lost and otherwise if it was not after ``before``, or has no
    readable time; or, where no outcomes are asked for, with ``retry_empty`` those without reviews.

    attempts (place_id, readable, outcome, message, at (text), n).
    """
    j = asked.select("place_id").join(attempts, "place_id", "left")
    message = F.coalesce("message", F.lit(""))
    lost = F.contains(message, F.lit(LOST[0])) | F.contains(message, F.lit(LOST[1]))
    late = F.coalesce(F.try_to_timestamp("at") > F.lit(before).cast("timestamp"), F.lit(False)) if before else F.lit(False)
    again = F.coalesce(F.col("outcome").isin(outcomes), F.lit(False)) & (lost | ~late) if outcomes else (F.coalesce("n", F.lit(0)) == 0) & F.lit(retry_empty)
    keep = F.when(F.col("readable").isNull(), F.lit(not outcomes)).when(~F.col("readable"), F.lit(True)).otherwise(again)
    return j.where(keep).select("place_id")
