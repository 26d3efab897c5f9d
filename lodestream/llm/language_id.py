"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and all that is neither letter nor mark becomes one space; the n-grams of 1 to 3 characters are
hashed to BUCKETS buckets. Counts are summed by Spark over all training rows; the matrix of log-probabilities, BUCKETS
times the number of languages, is broadcast, and batches of documents are scored as a sparse matrix, in numpy: each
text's row of buckets times that matrix.

A block of BLOCK languages is sent at a time (67 MB), so any number of them is scored exactly: further blocks follow on
the same rows, which keep their best language so far and the sum of all likelihoods.

Null texts and those without letters get ``und`` and score 0, as do all where nothing could be learned. Languages that
tie go to the first in alphabetical order. Repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import cut, documents, held_out, mix, rows

BUCKETS, ORDERS, ALPHA = 1 << 15, (1, 2, 3), 0.5
#: So many languages, with 32,769 numbers each, are sent and scored at once.
BLOCK = 256
PIECE = 1 << 20
_GAPS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> str:
    plain = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {plain} " if _LETTER.search(plain) else ""


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of all texts, in stretches of bounded size: for each order, their buckets (BUCKETS where an n-gram would
    go over the end of its text), the texts that the stretch has and where each begins in it."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = ends - np.diff(np.r_[0, ends])
    some = np.flatnonzero(ends > starts)
    for at in range(0, len(code), PIECE):
        upto = min(at + PIECE, len(code))
        own = some[(ends[some] > at) & (starts[some] < upto)]
        begin = np.maximum(starts[own], at) - at
        for k in ORDERS:
            part = code[at : upto + k - 1]
            n = max(0, len(part) - k + 1)
            h = np.full(n, k, np.uint64)
            for j in range(k):
                h = h * np.uint64(0x100000001B3) + part[j : j + n]
            bucket = np.full(upto - at, BUCKETS, np.int64)
            bucket[:n] = mix(h) % np.uint64(BUCKETS)
            for j in range(1, k):
                over = ends[own] - j - at
                bucket[over[(over >= 0) & (over < upto - at)]] = BUCKETS
            yield bucket, own, begin


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's counts: rows of (lang, bucket, n) for the n-grams and (lang, -1, documents)."""
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])
        counts.clear()

    for b in rows(batches):
        by: dict[str, list[str]] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            if plain := letters(text):
                by.setdefault(lang, []).append(plain)
        for lang, texts in by.items():
            own = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            own[0] += len(texts)
            for bucket, _, _ in grams(texts):
                own[1:] += np.bincount(bucket, minlength=BUCKETS + 1)[:BUCKETS]
        if len(counts) > BLOCK:
            yield from flush()
    yield from flush()


def train(docs: DataFrame) -> list[tuple[list[str], np.ndarray]]:
    """Blocks of languages and their log-probabilities, [bucket, language]; the last row of a block has the priors."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = cut(labelled.mapInArrow(_counted, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = counts.where("bucket = -1").toPandas()
    prior = np.log(found.set_index("lang")["n"] / max(1, found["n"].sum()))
    blocks, langs = [], sorted(prior.index)
    for k in range(0, len(langs), BLOCK):
        own = langs[k : k + BLOCK]
        held = counts.where(F.col("lang").between(own[0], own[-1]) & (F.col("bucket") >= 0)).toPandas()
        table = np.zeros((BUCKETS + 1, len(own)))
        table[held["bucket"].to_numpy(np.int64), np.searchsorted(np.array(own, object), held["lang"].to_numpy(object))] = held["n"]
        table[:BUCKETS] = np.log(table[:BUCKETS] + ALPHA) - np.log(table[:BUCKETS].sum(axis=0) + ALPHA * BUCKETS)
        table[BUCKETS] = prior[own]
        blocks.append((own, table))
    return blocks


def scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The log-likelihoods of texts, [text, language]: rows of buckets times the matrix."""
    total = np.repeat(table[BUCKETS :], len(texts), axis=0)
    plain = np.vstack([table[:BUCKETS], np.zeros((1, table.shape[1]))])
    step = max(4096, (1 << 22) // table.shape[1])
    for bucket, own, begin in grams(texts):
        for at in range(0, len(bucket), step):
            upto = at + step
            some = np.flatnonzero((begin < upto) & (np.r_[begin[1:], len(bucket)] > at))
            if len(some):
                total[own[some]] += np.add.reduceat(plain[bucket[at:upto]], np.maximum(begin[some], at) - at, axis=0)
    return total


def _scored(sent, langs: list[str], first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in rows(batches):
            texts = [letters(t) for t in b.column("text").to_pylist()]
            own = scores(texts, table)
            at = own.argmax(axis=1) if len(texts) else np.empty(0, np.int64)
            top = own[np.arange(len(at)), at]
            said = np.array(langs, object)[at]
            every = top + np.log(np.exp(own - top[:, None]).sum(axis=1))
            if not first:
                old, summed = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_top", "_sum"))
                said = np.where(top > old, said, b.column("_lang").to_numpy(zero_copy_only=False))
                top, every = np.maximum(top, old), np.logaddexp(every, summed)
            kept = [n for n in b.schema.names if n not in ("_lang", "_top", "_sum") and not (last and n == "text")]
            made = [pa.array([x if t else None for x, t in zip(said, texts)], pa.string()), pa.array(top), pa.array(every)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *made], [*kept, "_lang", "_top", "_sum"])

    return run


def predict(docs: DataFrame, blocks: list[tuple[list[str], np.ndarray]]) -> DataFrame:
    """The columns of docs but text and lang, with lang_pred and score (its posterior probability)."""
    docs = docs.drop("lang_pred", "score", "lang")
    kept = [c for c in docs.columns if c != "text"]
    if not blocks:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for k, (langs, table) in enumerate(blocks):
        last = k == len(blocks) - 1
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("_lang", "_top", "_sum") and not (last and f.name == "text")]
        docs = docs.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(table), langs, k == 0, last), ", ".join([*fields, "_lang string, _top double, _sum double"]))
    score = F.when(F.col("_lang").isNotNull(), F.least(F.lit(1.0), F.exp(F.col("_top") - F.col("_sum")))).otherwise(0.0)
    return docs.select(*kept, F.coalesce("_lang", F.lit("und")).alias("lang_pred"), score.alias("score"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id")))
    return predict(docs.select("doc_id", "held_out", "text"), train(docs.where("NOT held_out")))
