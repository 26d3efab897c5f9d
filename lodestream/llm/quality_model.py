"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its mean and a covariance shrunk towards the pooled one and its diagonal; a document's score is the
logistic of the difference of the classes' log-densities, from Mahalanobis distances by Cholesky factors that are
computed once and sent with the task. Sums and products for the fit are aggregated by Spark over all labelled rows.

Null texts count as empty and have statistics like any other. A document labelled twice gives its mean label, rounded;
null labels are left out. Where a class has no rows, all scores are the share of label 1 (0.5 without labels). Repeated
rows score alike; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import WORD, cut, documents, held_out, rows, texts

NAMES = ("words", "word_length", "long_words", "symbols", "digits", "upper", "punctuation", "stops", "dup_lines", "repeats", "distinct", "line_words")
SHRINK, RIDGE = 0.2, 0.05


def statistics(text: str) -> list[float]:
    """Shares are square-rooted and counts are taken to logarithms, to bring them near normal."""
    words = WORD.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    again = sum(c for c in Counter(windows).values() if c > 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # Of characters beyond ASCII, no byte is one of those that are counted here.
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    share = lambda k, of: math.sqrt(k / of)
    return [
        math.log1p(len(words)), math.log1p(lengths.mean() if len(words) else 0), share(int((lengths > 14).sum()), n),
        share(int(seen[[ord(c) for c in "#*$%&|<>@{}[]\\/_=^~"]].sum()), chars), share(int(seen[48:58].sum()), chars), share(int(seen[65:91].sum()), chars),
        share(int(seen[[ord(c) for c in ",;:"]].sum()), chars), share(int(seen[[ord(c) for c in ".!?"]].sum()), chars),
        share(len(lines) - len(set(lines)), max(1, len(lines))), share(again, max(1, len(windows))), len(set(words)) / n, math.log1p(len(words) / max(1, len(lines))),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows(batches):
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "held_out")), pa.array([statistics(t) for t in texts(b)], pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])


def fit(labelled: DataFrame) -> dict:
    """From rows of (x, quality): the means, factors and log-determinants of both classes, and the prior."""
    d = len(NAMES)
    moments = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(d) for j in range(i + 1)]
    found = {r["quality"]: r for r in labelled.groupBy("quality").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"), F.array(*moments).alias("m")).collect()}
    n = np.array([found[k]["n"] if k in found else 0 for k in (0, 1)], float)
    if not n.all():
        return {"share": float(n[1] / n.sum()) if n.sum() else 0.5}
    means, covs = [], []
    for k in (0, 1):
        mean = np.array(found[k]["s"]) / n[k]
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = np.array(found[k]["m"]) / n[k]
        second = second + np.tril(second, -1).T
        means.append(mean), covs.append(second - np.outer(mean, mean))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    spread = np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    factors = [np.linalg.cholesky((1 - SHRINK - RIDGE) * c + SHRINK * pooled + RIDGE * spread + 1e-6 * np.eye(d)) for c in covs]
    return {"prior": float(np.log(n[1] / n[0])), "means": means, "inverse": [np.linalg.inv(f) for f in factors], "logdet": [2 * float(np.log(np.diag(f)).sum()) for f in factors]}


def score(stats: DataFrame, model: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(NAMES))
            if "share" in model:
                p = np.full(len(x), model["share"])
            else:
                dense = [-0.5 * ((((x - m) @ i.T) ** 2).sum(axis=1) + det) for m, i, det in zip(model["means"], model["inverse"], model["logdet"])]
                p = 1 / (1 + np.exp(-np.clip(dense[1] - dense[0] + model["prior"], -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    stats = cut(docs.mapInArrow(_statistics, "doc_id bigint, held_out boolean, x array<double>"))
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    return score(stats, fit(stats.where("NOT held_out").join(marks, "doc_id")))
