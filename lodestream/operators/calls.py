"""Calls of a model over rows: what is recorded is reused, and only the rest is asked for, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answered(requests: DataFrame, recorded: DataFrame, key: str, text: str, model: Callable[[pd.Series], pd.Series], version: int, size: int = 256) -> DataFrame:
    """(key, answer, origin) for each request (key, text).

    recorded (key, version, answer) of this version is taken as it is. The other texts go to the model in batches of up to
    ``size``; one that is null is not asked. A batch for which the model raises is asked again row by row, and a row for
    which it raises has no answer and the origin ``failed``.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                try:
                    said = [(x, "called") for x in model(part[text])]
                except Exception:
                    said = [_one(model, x) for x in part[text]]
                yield pd.DataFrame({key: part[key].to_numpy(), "answer": [x for x, _ in said], "origin": [o for _, o in said]})

    known = recorded.where(F.col("version") == version).select(key, F.col("answer").alias("_answer"), F.lit(True).alias("_known"))
    both = requests.select(key, text).join(known, key, "left")
    kind = requests.schema[key].dataType.simpleString()
    asked = both.where(F.col("_known").isNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(ask, f"{key} {kind}, answer string, origin string")
    held = both.where(F.col("_known").isNotNull() | F.col(text).isNull())
    return held.select(key, F.col("_answer").alias("answer"), F.when(F.col("_known"), "recorded").otherwise("no text").alias("origin")).unionByName(asked)


def _one(model: Callable[[pd.Series], pd.Series], text: str) -> tuple[str | None, str]:
    try:
        return model(pd.Series([text])).iloc[0], "called"
    except Exception:
        return None, "failed"
