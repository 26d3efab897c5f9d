r"""Importance resampling towards a target: hashed n-gram features by word-id suffix arrays, drawn by Gumbel noise.

In each task the words of a stretch of documents get ids; a suffix array of their positions, as deep as the longest
n-gram, puts equal n-grams side by side. Where the prefix that neighbours share (the LCP) is shorter than n, a run of an
n-gram ends; each run is hashed once, its CRC-32 put together from its words', and its bucket is scattered back to where
it occurs. Counts of buckets take the runs' lengths; scores take the buckets' gains at the occurrences.

A bucket's gain is the logarithm, in thousandths and rounded down, of its smoothed share in the target over that in the
corpus. A document's weight is the sum of its features' gains; its score adds Gumbel noise hashed from its id, so the
highest scores are a draw without replacement in proportion to exp(weight / 1000). Only documents of LEAST words or more
are drawn; PERCENT of these are.

Words are runs of ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased. Null and empty texts have no
features and weight 0. n-grams don't cross documents. A text of any length is taken in stretches. Rows that share a
doc_id have the same noise; ties go to the smaller doc_id (null last), then to the larger weight. The hash of a null
doc_id is that of ``<seed>:``. Other columns are not read. An empty target leaves the corpus against a flat one; an empty
corpus gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import cut, documents, rows, utf8
from lodestream.operators.ranges import numbered

BUCKETS, WORDS, LEAST, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: So many words are sorted at once, with WORDS - 1 that follow; their ids fit into 21 bits.
STRETCH = 1 << 20
_ID_BITS = 21
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def split(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts between the edges, and where each text's begin and the last end."""
    data = _LOWER[data]
    within = np.r_[_WORD[data], False]
    starts = within[:-1] & ~np.r_[False, within[:-2]]
    first = edges[:-1][edges[1:] > edges[:-1]]
    starts[first] = within[first]
    starts = np.flatnonzero(starts)
    # The words' bytes, one word after the other.
    held = data[within[:-1]]
    at = np.cumsum(within[:-1], dtype=np.int64)[starts] - 1 if len(starts) else np.empty(0, np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[at, len(held)].astype(np.int64)), pa.py_buffer(held)])
    return words, np.searchsorted(starts, edges)


def _moves() -> np.ndarray:
    """[k, byte of a CRC, value]: what a CRC-32 register's byte becomes after 2**k zero bytes."""
    one = np.array([zlib.crc32(b"\0", int(x) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for x in (np.uint64(1) << np.arange(32, dtype=np.uint64))], np.uint64)
    out = []
    for _ in range(32):
        table = np.zeros((4, 256), np.uint64)
        for byte in range(4):
            for bit in range(8):
                table[byte] ^= np.where(np.arange(256) >> bit & 1, one[8 * byte + bit], 0).astype(np.uint64)
        out.append(table)
        one = _moved(one, table)
    return np.array(out)


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.int64)
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24 & 255]


_MOVES = _moves()


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of two texts put together, from theirs and the second one's size in bytes."""
    left = left.astype(np.uint64)
    for k in range(int(size.max(initial=0)).bit_length()):
        far = (size >> k & 1).astype(bool)
        left[far] = _moved(left[far], _MOVES[k])
    return left ^ right


def runs(ids: np.ndarray, left: np.ndarray, crc: np.ndarray, spaced: np.ndarray, size: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n-grams of 1 to WORDS words that begin in the first n of ids: the suffix array, where each run begins in it, and
    the runs' buckets. left: how many words of its text each position has; crc, spaced, size: of each word by id, spaced
    and sized with the space before it."""
    deep = [np.where(left[:n] > j, ids[j : j + n] if j == 0 else np.r_[ids, np.zeros(j, np.int64)][j : j + n] + 1, 0) for j in range(WORDS)]
    key = np.zeros(n, np.uint64)
    for d in deep:
        key = (key << np.uint64(_ID_BITS)) | d.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    change = np.zeros(n, bool)
    change[:1] = True
    held = None
    for j in range(WORDS):
        # The LCP of neighbours is at most j where their first j + 1 words differ.
        part = key >> np.uint64(_ID_BITS * (WORDS - 1 - j))
        change = change | np.r_[np.ones(min(1, n), bool), part[1:] != part[:-1]]
        head = np.flatnonzero(change)
        own = deep[j][order[head]]
        if held is None:
            hashed = crc[own]
        else:
            before = held[np.cumsum(held_at)[head] - 1]
            some = own > 0
            hashed = before.copy()
            hashed[some] = joined(before[some], spaced[own[some] - 1], size[own[some] - 1])
        held, held_at = hashed, change.copy()
        alive = own > 0 if j else np.ones(len(own), bool)
        yield order, head, np.where(alive, (hashed % np.uint64(BUCKETS)).astype(np.int64), -1)


def features(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator]]:
    """Stretches of the texts between the edges: the texts of its words, and its runs."""
    words, at = split(data, edges)
    of = np.repeat(np.arange(len(edges) - 1), np.diff(at))
    ends = at[1:][of]
    for low in range(0, len(words), STRETCH):
        high = min(low + STRETCH, len(words))
        coded = words[low : high + WORDS - 1].dictionary_encode()
        ids, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        crc = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))
        spaced = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint64, len(distinct))
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1
        left = ends[low : low + len(ids)] - np.arange(low, low + len(ids))
        yield of[low:high], left, runs(ids, left, crc, spaced, size, high - low)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts: (bucket, n)."""
    total = np.zeros(BUCKETS, np.int64)
    for b in rows(batches, 2048):
        for _, left, found in features(*utf8(b)):
            for order, head, bucket in found:
                length = np.diff(np.r_[head, len(order)])
                total += np.bincount(bucket + 1, length, BUCKETS + 1).astype(np.int64)[1:]
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of the features of a text column; BUCKETS rows at most."""
    return texts.select("text").mapInArrow(_counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) for every bucket."""
    every = corpus.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    both = every.join(bucket_counts(corpus).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_counts(target).withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    both = cut(both)
    total = both.agg(F.sum("s").cast("double").alias("_s"), F.sum("t").cast("double").alias("_t"))
    share = ((F.col("t") + 1.0) * (F.col("_s") + float(BUCKETS))) / ((F.col("s") + 1.0) * (F.col("_t") + float(BUCKETS)))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def _weighed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.r_[sent.value, 0]
        for b in rows(batches, 2048):
            data, edges = utf8(b)
            weight, n = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for of, left, found in features(data, edges):
                own = np.zeros(len(of), np.int64)
                for order, head, bucket in found:
                    own[order] += np.repeat(gain[bucket], np.diff(np.r_[head, len(order)]))
                weight += np.bincount(of, own, len(weight)).astype(np.int64)
                n += np.bincount(of, minlength=len(n))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "weight"])

    return run


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for each row of docs."""
    found = gains(docs, target).toPandas()  # BUCKETS rows
    gain = np.zeros(BUCKETS, np.int64)
    gain[found["bucket"].to_numpy()] = found["gain"].to_numpy()
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    out = docs.select("doc_id", "text").mapInArrow(_weighed(sent), f"doc_id {kind}, n_words bigint, weight bigint")
    n = F.col("n_words")
    count = sum((F.greatest(n - j, F.lit(0)) for j in range(1, WORDS)), n)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return out.select("doc_id", "n_words", count.alias("n_features"), "weight", (F.col("weight") + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; drawn rows have a rank from 1."""
    every = cut(scored(docs, target, seed))
    able = F.col("n_words") >= least
    n = every.agg(F.floor(F.count_if(able) * percent / 100).alias("_n"))
    drawn = numbered(every.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc()], "rank")
    drawn = drawn.crossJoin(F.broadcast(n)).withColumn("rank", F.when(F.col("rank") <= F.col("_n"), F.col("rank"))).drop("_n")
    rest = every.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
