"""Chronological splits and what must not leak across them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions.expr import capped, piece
from lodestream.operators.relational import keep_first
from lodestream.sources.tables import TIES


def newest_visits(visits: DataFrame) -> DataFrame:
    """The newest visit of each user to each item; ties by the remaining columns."""
    return keep_first(visits, ["user_id", "item_id"], [F.col("ts").desc_nulls_last(), *[F.col(c).asc() for c in TIES]])


def leave_two_out(visits: DataFrame, least: int = 4) -> DataFrame:
    """Adds split_rank and split: the newest place is test, the next validation, the others train.

    Visits without a user (null or empty), an item or a rating are left out. Counting and ranking share the dedupe's hash partitioning by user, so there is one shuffle.
    """
    own = W.partitionBy("user_id")
    once = newest_visits(visits.where("user_id IS NOT NULL AND string(user_id) <> '' AND item_id IS NOT NULL AND rating IS NOT NULL").repartition("user_id"))
    ranked = once.withColumn("_n", F.count("*").over(own)).where(F.col("_n") >= least).withColumn("split_rank", F.row_number().over(own.orderBy(F.col("ts").desc_nulls_last(), "item_id")) - 1)
    return ranked.withColumn("split", F.when(F.col("split_rank") == 0, "test").when(F.col("split_rank") == 1, "validation").otherwise("train")).drop("_n")


def with_split(visits: DataFrame, least: int = 4, ties: list[str] = TIES) -> DataFrame:
    """Every visit, repeats included, with split_rank and split of its pair, as leave_two_out has them, and ``newest``: whether
    it is the one that stands for the pair there. Pairs that are left out there have no split; visits without a user or an
    item are dropped.

    Rows are dealt out by user once. Pairs, counts and ranks are windows of these, so no pair is joined back to its visits.
    The split needs no ties; who does not ask which of a pair's visits at one time is the newest can leave them out.
    """
    held = visits.where("user_id IS NOT NULL AND item_id IS NOT NULL").repartition("user_id").withColumn("_ok", (F.col("user_id").cast("string") != "") & F.col("rating").isNotNull())
    pair = W.partitionBy("user_id", "item_id").orderBy(F.col("_ok").desc(), F.col("ts").desc_nulls_last(), *[F.col(c).asc() for c in ties])
    own, last = W.partitionBy("user_id"), F.col("_last")
    held = held.withColumn("newest", (F.row_number().over(pair) == 1) & F.col("_ok")).withColumn("_last", F.first(F.struct("_ok", "ts")).over(pair))
    # Equal rows of the order are those of a pair, of which one is the newest.
    rank = F.count_if("newest").over(own.orderBy(last["_ok"].desc(), last["ts"].desc_nulls_last(), "item_id")) - 1
    held = held.withColumn("_rank", rank).withColumn("_n", F.count_if("newest").over(own))
    held = held.withColumn("split_rank", F.when(last["_ok"] & (F.col("_n") >= least), F.col("_rank")))
    return held.withColumn("split", F.when(F.col("split_rank") == 0, "test").when(F.col("split_rank") == 1, "validation").when(F.col("split_rank") > 1, "train")).drop("_ok", "_last", "_rank", "_n")


def train_only(visits: DataFrame, split: DataFrame) -> DataFrame:
    """All raw visits, repeats included, of pairs in train."""
    return visits.join(split.where("split = 'train'").select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")


def leave_one_out(visits: DataFrame, least: int = 3, allowed: DataFrame | None = None) -> DataFrame:
    """The newest place is test, the others train; with ``allowed`` (item_id), tests of other places are left out."""
    split = leave_two_out(visits, least).withColumn("split", F.when(F.col("split_rank") == 0, "test").otherwise("train"))
    if allowed is None:
        return split
    return split.join(allowed.select("item_id").distinct().withColumn("_ok", F.lit(True)), "item_id", "left").where("split = 'train' OR _ok").drop("_ok")


def pieces_of(texts: DataFrame, key: str, text: str, order: list, pieces: int, each: int, total: int) -> DataFrame:
    """The rows whose texts a corpus holds, with their place ``_k`` and piece ``_t``: the first in the order, until ``total`` characters."""
    held = texts.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "").withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    held = held.where(F.col("_k") <= pieces).withColumn("_t", piece(F.col(text), each))
    used = F.coalesce(F.sum(F.length("_t")).over(W.partitionBy(key).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_used", used).where(F.col("_used") < total).drop("_used")


def corpora(texts: DataFrame, key: str, id_column: str, text: str, order: list, pieces: int, each: int, total: int) -> DataFrame:
    """(key, corpus, ids) of the first texts in the order, bounded in number and characters; blank texts are left out first."""
    rows = F.sort_array(F.collect_list(F.struct("_k", F.col(id_column).alias("id"), F.col("_t").alias("t"))))
    grouped = pieces_of(texts, key, text, order, pieces, each, total).groupBy(key).agg(rows.alias("_r"))
    return grouped.select(key, F.array_join(capped(F.transform("_r", lambda r: r.t), total), "\n---\n").alias("corpus"), F.transform("_r", lambda r: r.id).alias("ids"))


def safe_reviews(reviews: DataFrame, split: DataFrame | None = None, train: bool = False, least: int = 20) -> DataFrame:
    """Reviews with a text of ``least`` characters that no held-out pair has; with ``train``, of training pairs alone.

    Reviews of users without a split are auxiliary and may be used for items. Without ``split``, reviews have the column
    from with_split themselves, and nothing is joined.
    """
    held = reviews.where(F.length("text") >= least)
    if split is None:
        return held.where("split = 'train'" if train else "split IS NULL OR split = 'train'")
    pairs = split.select("user_id", "item_id", "split")
    if train:
        return held.join(pairs.where("split = 'train'"), ["user_id", "item_id"], "left_semi")
    return held.join(pairs.where("split <> 'train'"), ["user_id", "item_id"], "left_anti")


def review_corpora(reviews: DataFrame, key: str, first: list, pieces: int, each: int, total: int) -> DataFrame:
    """(key, corpus, ids) of each key's reviews, a review_id once, in the order of ``first``, then the longest, then by id."""
    return corpora(_once(reviews, key), key, "review_id", "text", [*first, *_longest_first()], pieces, each, total)


def review_pieces(reviews: DataFrame, key: str, first: list, pieces: int, each: int, total: int) -> DataFrame:
    """The reviews that are in review_corpora's corpora."""
    return pieces_of(_once(reviews, key), key, "text", [*first, *_longest_first()], pieces, each, total).drop("_k", "_t")


def _once(reviews: DataFrame, key: str) -> DataFrame:
    return keep_first(reviews, [key, "review_id"], [F.col("text").asc(), F.col("rating").asc()])


def _longest_first() -> list:
    return [F.length("text").desc(), F.col("review_id").asc()]
