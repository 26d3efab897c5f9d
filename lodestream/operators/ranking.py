"""Ranking: blocked scores, exclusion, reranking by distance, and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import expr
from lodestream.operators.relational import top_k
from lodestream.sources.shared import written

#: So many bytes of query vectors are sent at once; more of them take further passes over the items. And so many scores
#: are held at once by a task, some eight times over while the best are taken; and so many queries' best are given back at once.
BLOCK_BYTES = 16 << 20
SCORES = 1 << 19
GIVEN = 1 << 12


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column that are there and whole, and which rows these are."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.flatten() if column.null_count else column.values[ends[0] : ends[-1]]
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    flat = flat.to_numpy(zero_copy_only=False).astype(float)
    at = np.cumsum(length) - length
    rows = np.flatnonzero(length == size)
    x = flat[at[rows][:, None] + np.arange(size)] if len(rows) else np.empty((0, size))
    good = np.isfinite(x).all(axis=1)
    return x[good], rows[good]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores, ties by id."""
    if scores.shape[1] > 4 * k:
        # All that are no worse than the k-th, so that ties are kept for the sort below.
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        width = max(k, int((scores >= least).sum(axis=1).max()))
        at = np.argpartition(-scores, min(width, scores.shape[1] - 1), axis=1)[:, :width]
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def best_items(items: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", vector: str = "embedding", skip_self: bool = True, normalise: bool = False, seen: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """(query_id, item, score, rank): the k best items of each query by inner product, ties by item; exact.

    Queries go out in blocks of a fixed size, one after the other. A task multiplies its items with a block and keeps the k
    best of each query, so only k rows a query and task are shuffled, whatever the number of items. ``seen`` (query_id,
    item) is left out before the best are kept: each item carries those queries of the block that have seen it. Where a
    query has seen all items of its ``group``, a column of whole numbers that both sides have, no pairs are made for it:
    items of a query's group are left out, and null is in none. Null
    vectors, and those of another length than the queries' or with a number that is not finite, are passed over.
    """
    spark, size = items.sparkSession, max(1, queries.agg(F.max(F.size(vector))).first()[0] or 1)
    step = max(1, BLOCK_BYTES // (8 * size))
    ids = queries.where(F.col(vector).isNotNull()).select(F.col(item).alias("query_id"), F.col(vector).alias("q"), *([F.col(group).cast("bigint").alias("_group")] if group else []))
    n_blocks = max(1, -(-ids.count() // step))

    masked = seen is not None

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if normalise else x

    found = []
    for b in range(n_blocks):
        own = ids if n_blocks == 1 else ids.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        held = own.toArrow().combine_chunks()
        q, kept = matrix(held.column("q").combine_chunks(), size)
        names = held.column("query_id").to_numpy()[kept].astype(np.int64)
        order = np.argsort(names)
        groups = held.column("_group").combine_chunks().take(pa.array(kept[order])) if group else None
        # A number for each group of the block's queries, so that null, and what no query has, is none.
        known_groups = np.unique(groups.drop_null().to_numpy()) if group else None
        own_group = np.where(groups.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(known_groups, groups.fill_null(0).to_numpy()), -1) if group else None
        sent = spark.sparkContext.broadcast((names[order], unit(q[order]), known_groups, own_group))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q, known_groups, own_group = sent.value
            best_score, best_id = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
            width = max(1, SCORES // max(1, len(q)))
            for batch in batches:
                if not batch.num_rows or not len(q):
                    continue
                x, kept = matrix(batch.column(vector), size)
                own_ids = batch.column(item).to_numpy(zero_copy_only=False)[kept].astype(np.int64)
                x = unit(x)
                known = batch.column("_seen").take(pa.array(kept)) if masked else None
                if group:
                    asked_group = batch.column("_group").take(pa.array(kept))
                    place = np.searchsorted(known_groups, asked_group.fill_null(0).to_numpy())
                    same = asked_group.is_valid().to_numpy(zero_copy_only=False) & (place < len(known_groups))
                    same[same] = known_groups[place[same]] == asked_group.fill_null(0).to_numpy()[same]
                    place = np.where(same, place, -2)
                for at in range(0, len(x), width):
                    s = q @ x[at : at + width].T
                    i = np.broadcast_to(own_ids[at : at + width], s.shape)
                    if skip_self:
                        s = np.where(i == names[:, None], -np.inf, s)
                    if known is not None:
                        part = known.slice(at, width)
                        by = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                        s[np.searchsorted(names, by), np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy())] = -np.inf
                    if group:
                        s[own_group[:, None] == place[at : at + width]] = -np.inf
                    best_score, best_id = best_of(np.hstack([best_score, s]), np.hstack([best_id, i]), k)
            for at in range(0, len(names), GIVEN):
                own_score, own_id = best_score[at : at + GIVEN], best_id[at : at + GIVEN]
                ok = np.isfinite(own_score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at : at + GIVEN], ok.sum(axis=1)), pa.int64()), pa.array(own_id[ok], pa.int64()), pa.array(own_score[ok])], ["query_id", item, "score"])

        asked = items.select(item, vector, *([F.col(group).cast("bigint").alias("_group")] if group else []))
        if seen is not None:
            by = seen.join(F.broadcast(spark.createDataFrame(pa.table({"query_id": names}))), "query_id").groupBy(item).agg(F.collect_set("query_id").alias("_seen"))
            asked = asked.join(by, item, "left")
        top = asked.mapInArrow(run, f"query_id bigint, {item} bigint, score double")
        top = top.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(item).asc()))).where(F.col("rank") <= k)
        if n_blocks == 1:
            return top
        found.append(written(top))
        sent.destroy()
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return every


def row_minmax(column: str, keys: list[str], equal: float) -> Column:
    """Scaled within the rows of the keys; ``equal`` where all are alike."""
    w = W.partitionBy(*keys)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high == low, F.lit(equal)).otherwise((F.col(column) - low) / (high - low))


def rerank(candidates: DataFrame, grid: DataFrame, k: int = 10) -> DataFrame:
    """For each row of grid (depth, bandwidth, alpha): of candidates (user, item, score, rank, km), the first ``depth`` by
    rank, scores and nearness scaled within the user (equal: 0) and blended, and the best k of them.

    Candidates are made once at the greatest depth; the grid, a small table, is joined to them.
    """
    c = candidates.join(F.broadcast(grid), F.col("rank") <= F.col("depth")).withColumn("near", F.coalesce(F.exp(-F.col("km") / F.col("bandwidth")), F.lit(0.0)))
    keys = ["user", "depth", "bandwidth", "alpha"]
    blend = (1 - F.col("alpha")) * row_minmax("score", keys, 0.0) + F.col("alpha") * row_minmax("near", keys, 0.0)
    # Rounded, so that sums in another order break no tie.
    return top_k(c.withColumn("blend", F.round(blend, 9)), keys, [F.col("blend").desc(), F.col("rank").asc()], k).withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("blend").desc(), F.col("rank").asc())))


def metrics(ranked: DataFrame, truth: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """Of ranked (keys, user, item, place) against truth (user, item): users, hit, ndcg, recall and precision at 10."""
    found = ranked.join(truth, ["user", "item"]).select(*keys, "user", place)
    users = truth.agg(F.count_distinct("user").alias("users"))
    out = found.groupBy(*keys).agg(F.count("*").alias("hits"), F.sum(expr.ndcg(F.col(place))).alias("gain"))
    every = ranked.select(*keys).distinct() if keys else None
    out = every.join(out, keys, "left") if keys else out
    out = out.crossJoin(F.broadcast(users))
    hit = F.coalesce("hits", F.lit(0)) / F.col("users")
    return out.select(*keys, "users", F.round(hit, 6).alias("hit"), F.round(F.coalesce("gain", F.lit(0.0)) / F.col("users"), 6).alias("ndcg"), F.round(hit, 6).alias("recall"), F.round(hit / 10, 6).alias("precision"))
