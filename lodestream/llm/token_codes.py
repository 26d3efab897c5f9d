"""Token ids in directly addressable codes.

A file holds the ids of consecutive documents. Ids are split into chunks of 8 bits; level k has the k-th chunk of every
id that has one, and a bitmap that says which of them go on. A rank directory counts the set bits before each word of 64
bits, so any id is found from its position alone: its chunk, then by rank its place in the next level.

Layout, all numbers little-endian: 8 bytes mark, then as 64-bit numbers the documents, ids and levels; the documents' ids
(doc_id) and ends; then for each level its length, chunks (padded to 8 bytes), bitmap and directory.

Files lie in a folder that all executors share, with the task attempt in their names; the manifest says which count.
Documents are in ascending order of doc_id (nulls first), then text, through all files. Null texts count as empty and
have the end id alone; repeated rows are all written. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.llm.bpe import encoder
from lodestream.llm.common import documents, rows, shared_dir, utf8
from lodestream.llm.warc import _store, spread

MARK = b"DACODES1"
#: Fixed value: the id that ends every document.
END_ID = 1
#: A file takes documents until it has so many ids, by slices of the input.
FILE_IDS = 2_000_000
NULL_ID = -(2**63)


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each level's chunks, bitmap words and rank directory."""
    levels, rest = [], ids.astype(np.uint64)
    while len(rest) or not levels:
        more = rest > 255
        bits = np.zeros(-(-len(rest) // 64) * 64, np.uint8)
        bits[: len(rest)] = more
        words = np.packbits(bits, bitorder="little").view("<u8")
        ranks = np.r_[0, np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))].astype("<u8")
        levels.append(((rest & np.uint64(255)).astype(np.uint8), words, ranks))
        rest = rest[more] >> np.uint64(8)
    return levels


def write_codes(out, doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> None:
    levels = pack(ids)
    out.write(MARK + np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes())
    out.write(np.array([NULL_ID if x is None else x for x in doc_ids], "<i8").tobytes() + np.array(ends, "<u8").tobytes())
    for chunks, words, ranks in levels:
        out.write(np.array([len(chunks)], "<u8").tobytes() + chunks.tobytes() + b"\0" * (-len(chunks) % 8) + words.tobytes() + ranks.tobytes())


class Codes:
    """Random access to an open file: reads the parts of each level that a range of positions touches."""

    def __init__(self, source) -> None:
        self.source = source
        if bytes(source.read_at(8, 0)) != MARK:
            raise ValueError("not a file of directly addressable codes")
        n_docs, self.n, n_levels = self._numbers(8, 3).tolist()
        self.doc_ids = self._numbers(32, n_docs).view("<i8")
        self.ends = self._numbers(32 + 8 * n_docs, n_docs)
        at, self.levels = 32 + 16 * n_docs, []
        for _ in range(n_levels):
            n = int(self._numbers(at, 1)[0])
            words, chunks = -(-n // 64), at + 8
            bitmap = chunks + n + -n % 8
            self.levels.append((chunks, bitmap, bitmap + 8 * words))
            at = bitmap + 8 * words + 8 * (words + 1)

    def _numbers(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.source.read_at(8 * n, at), "<u8")

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids at positions from start to before end."""
        out, places = np.zeros(end - start, np.uint64), np.arange(end - start)
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            if start >= end:
                break
            out[places] |= np.frombuffer(self.source.read_at(end - start, chunks + start), np.uint8).astype(np.uint64) << np.uint64(8 * k)
            first, last = start // 64, -(-end // 64)
            bits = np.unpackbits(np.frombuffer(self.source.read_at(8 * (last - first), bitmap + 8 * first), np.uint8), bitorder="little")
            low = int(self._numbers(ranks + 8 * first, 1)[0]) + int(bits[: start - 64 * first].sum())
            places = places[bits[start - 64 * first : end - 64 * first] == 1]
            start, end = low, low + len(places)
        return out.astype(np.uint32)


def write_tokens(docs: DataFrame, folder: str, name: str = "word_bpe_49k.json", partitions: int | None = None) -> DataFrame:
    """Writes the files; returns the manifest (path, part, file, n_docs, n_ids, start), start over all files."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ordered = (docs.repartitionByRange(partitions, "doc_id") if partitions else docs.repartitionByRange("doc_id")).sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        enc, file, part = encoder(name), 0, 0
        names, sizes, held = [], [], []

        def flush() -> pa.RecordBatch:
            path, ids = f"{top}/{uuid.uuid4().hex}.dac", np.concatenate(held)
            with store.open_output_stream(path) as out:
                write_codes(out, names, np.cumsum(np.concatenate(sizes)), ids)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64())], ["path", "part", "file", "n_docs", "n_ids"])

        for b in rows(batches):
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            _, ends, ids = enc.encode(*utf8(b))
            names += b.column("doc_id").to_pylist()
            sizes.append(np.diff(ends) + 1)
            held.append(np.insert(ids, ends[1:], END_ID))
            if sum(map(len, held)) >= FILE_IDS:
                yield flush()
                names, sizes, held, file = [], [], [], file + 1
        if names:
            yield flush()

    ordered.mapInArrow(run, "path string, part int, file int, n_docs bigint, n_ids bigint").write.parquet(f"{folder}/manifest")
    # First over the tasks, a row for each, then over the files within a task.
    files = spark.read.parquet(f"{folder}/manifest")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(W.orderBy("part")).alias("base"))
    return files.join(tasks, "part").withColumn("start", F.col("base") + before(W.partitionBy("part").orderBy("file"))).drop("base")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with store.open_input_file(path) as source:
                    codes = Codes(source)
                    ends = codes.ends.astype(np.int64)
                    starts = np.r_[0, ends[:-1]].astype(np.int64)
                    for at in range(0, len(ends), 256):
                        some = slice(at, at + 256)
                        ids = codes.read(int(starts[at]), int(ends[some][-1]))
                        each = [ids[a - starts[at] : e - starts[at]] for a, e in zip(starts[some], ends[some])]
                        names = [None if x == NULL_ID else x for x in codes.doc_ids[some].tolist()]
                        columns = [pa.array(names, pa.int64()), pa.array(starts[some] + base, pa.int64()), pa.array([len(x) for x in each], pa.int64()), pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return spread(manifest.select("path", "start")).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint")


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    found = read_tokens(write_tokens(documents(spark, sf_dir), folder), folder)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
