"""Shared helpers of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII controls from tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold kept from training: crc32 of the id's text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one. Where none is set, only a session on one machine gets a local one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage: df as a compressed table in the shared folder.

    The plan that wrote it is not kept. Its shuffle files go when the driver collects its garbage, which Spark itself
    asks for every half hour only; a job of many cuts would hold all of its shuffles on disk until then, so it is asked here.
    """
    return scratch(df)[0]


def scratch(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df as such a table, and what empties it once all that reads it is written."""
    path, schema = shared_dir(df.sparkSession), df.schema
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(schema).parquet(path), lambda: df.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def fold_ascii(text: str) -> str:
    return text.translate(_UPPER)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def rows(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one slice stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one text after the other, and where each begins and the last ends; null is empty."""
    held = batch.column(column)
    if held.null_count:
        held = held.fill_null("")
    if not len(held):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    held = held.cast(pa.string())
    _, ends, data = held.buffers()
    ends = np.frombuffer(ends, np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return data, ends - ends[0]


_rng = np.random.default_rng(77)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x))
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums up to each place; a difference of two, times the inverse power at the first, is the hash of what lies between."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data))[0], out=out[1:])
    return out
