r"""Removal of bytes in strings of LENGTH bytes that also start earlier in the corpus, by prefix-free parsing.

A rolling hash of K bytes triggers at the least value in each window of WINDOW positions, so every string of LENGTH
bytes has exactly one trigger, set by its content alone. The strings that share a trigger form one phrase: a run of
starts and the bytes they reach. The dictionary is the set of distinct phrases.

1. Exact copies of a document with a smaller id are resolved whole.
2. Triggers (K bytes) seen once are unique, and so is every string through them.
3. A phrase that equals an earlier one repeats it in all its strings.
4. Where different phrases share a trigger, the first occurrence of each (the dictionary's entries) is cut into runs of
   STEP starts, aligned to the trigger. All strings of a run share its core, of LENGTH - STEP + 1 bytes, which stands
   for the trigger while steps 2 and 3 are repeated for the runs.
5. Where different runs share a core, the strings of the first occurrence of each are compared one by one.

Corpus order of equal strings is all the contract asks of the suffix order; grouping by hash gives it without a sort of
suffixes, and each step is a grouped minimum with a map-side combine and a join, which Spark splits where it is skewed.
Equality is by 64-bit phrase and string hashes within an equal 64-bit trigger hash.

Null texts count as empty; texts shorter than LENGTH lose nothing. Rows that share a doc_id and text are the same
document and get the same result. Of different texts that share a doc_id, that of the least sha256 has the place of the
id and the others come later, at a place that a hash of id and text gives them from 2**62 on. Rows with a null doc_id
are passed on as they are. Clashing output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lodestream.llm.common import cut, documents, mix, powers, prefix_hash, rows, scratch, texts

LENGTH, K, STEP = 100, 32, 8
WINDOW = LENGTH - K + 1
PIECE = 1 << 21
#: Triggers are resolved in so many slices, one after the other.
SLICES = 4
_LOW = np.uint64((1 << 24) - 1)


def pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of PIECE starts, with the bytes that these reach."""
    for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        yield at, data[at : at + PIECE + LENGTH - 1]


def phrases(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one piece: first start, number of starts, lead to the trigger, trigger hash and phrase hash of each phrase."""
    total, inverse = prefix_hash(data), powers(len(data))[1]
    grams = mix((total[K:] - total[:-K]) * inverse[: len(data) - K + 1])
    ranked = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.full((-(-len(ranked) // WINDOW), WINDOW), 2**64 - 1, np.uint64)
    blocks.reshape(-1)[: len(ranked)] = ranked
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(data) - LENGTH + 1
    trigger = (np.minimum(behind[:n], ahead[WINDOW - 1 : WINDOW - 1 + n]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
    count = np.diff(np.r_[first, n])
    at = trigger[first]
    whole = mix((total[first + count + LENGTH - 1] - total[first]) * inverse[first])
    whole = mix(whole + (count.astype(np.uint64) << np.uint64(16)) + (at - first).astype(np.uint64))
    return first, count, at - first, grams[at].view(np.int64), whole.view(np.int64)


def runs(data: np.ndarray, start: np.ndarray, n: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the phrases given by these: first start, number of starts, lead (0), core hash and hash of each run."""
    total, inverse = prefix_hash(data), powers(len(data))[1]
    low, high = (lead - n + 1) // STEP, lead // STEP
    times = high - low + 1
    of = np.repeat(np.arange(len(start)), times)
    block = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + low[of]
    far, near = np.minimum(lead[of], STEP * block + STEP - 1), np.maximum((lead - n + 1)[of], STEP * block)
    first, count = (start + lead)[of] - far, far - near + 1
    core = (start + lead)[of] - STEP * block
    same = mix((total[core + LENGTH - STEP + 1] - total[core]) * inverse[core])
    whole = mix((total[first + count + LENGTH - 1] - total[first]) * inverse[first])
    whole = mix(whole + (count.astype(np.uint64) << np.uint64(16)) + (core - first + STEP).astype(np.uint64))
    return first, count, np.zeros(len(of), np.int64), mix(same + block.astype(np.uint64)).view(np.int64), whole.view(np.int64)


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows(batches, 256):
        out = []
        for i, t in zip(b.column("doc_id").to_pylist(), texts(b)):
            own = [(first + at, *more) for at, part in pieces(np.frombuffer(t.encode(), np.uint8)) for first, *more in [phrases(part)]]
            if own:
                out.append((i, *map(np.concatenate, zip(*own))))
        if out:
            yield _rows(out)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows(batches, 256):
        out = []
        for i, t, opened in zip(b.column("doc_id").to_pylist(), texts(b), b.column("opened").to_pylist()):
            data = np.frombuffer(t.encode(), np.uint8)
            given = np.array([(x["start"], x["n"], x["lead"]) for x in sorted(opened, key=lambda x: x["start"])], np.int64)
            own = []
            for at in np.unique(given[:, 0] // PIECE) * PIECE:
                start, n, lead = given[given[:, 0] // PIECE * PIECE == at].T
                first, *more = runs(data[at : at + PIECE + 2 * LENGTH], start - at, n, lead)
                own.append((first + at, *more))
            out.append((i, *map(np.concatenate, zip(*own))))
        if out:
            yield _rows(out)


_PARSED = "doc_id bigint, start bigint, n bigint, lead bigint, trigger bigint, phrase bigint, again boolean"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    """Rows of _PARSED from (doc_id, start, n, lead, trigger, phrase) of each document."""
    columns = [(np.full(len(start), i), start, n, lead, trigger, phrase, repeated(trigger, phrase)) for i, start, n, lead, trigger, phrase in out]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns)], ["doc_id", "start", "n", "lead", "trigger", "phrase", "again"])


def repeated(*keys: np.ndarray) -> np.ndarray:
    """Which of a document's rows, in order of start, have the keys of an earlier one."""
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    return out


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of the opened phrases: trigger, string hash and start."""
    for b in rows(batches, 64):
        for i, t, opened in zip(b.column("doc_id").to_pylist(), texts(b), b.column("opened").to_pylist()):
            data, own = np.frombuffer(t.encode(), np.uint8), []
            for x in sorted(opened, key=lambda x: x["start"]):
                part = data[x["start"] : x["start"] + x["n"] + LENGTH - 1]
                total = prefix_hash(part)
                h = mix((total[LENGTH:] - total[:-LENGTH]) * powers(len(part))[1][: x["n"]]).view(np.int64)
                own.append((np.arange(x["start"], x["start"] + x["n"]), np.full(len(h), x["trigger"]), h))
            start, trigger, string = map(np.concatenate, zip(*own))
            columns = [np.full(len(start), i), start, trigger, string, repeated(trigger, string)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["doc_id", "start", "trigger", "string", "again"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 50_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spans(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the half-open marks cover; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows(batches, 256):
        sizes, gone, runs, kept = [], [], [], []
        for t, copy, marks in zip(texts(b), b.column("_copy").to_pylist(), b.column("_marks").to_pylist()):
            data = t.encode()
            found = [(0, len(data))] if copy and len(data) >= LENGTH else spans([(x["a"], x["b"]) for x in marks or ()])
            upto, parts = 0, []
            for start, end in found:
                parts.append(data[upto:start])
                upto = end
            kept.append(b"".join([*parts, data[upto:]]))
            sizes.append(len(data)), gone.append(len(data) - len(kept[-1])), runs.append(len(found))
        carried = [n for n in b.schema.names if n not in ("_copy", "_marks")]
        new = [pa.array(x, pa.int64()) for x in (sizes, gone, runs)]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in carried), *new, pa.array(kept, pa.binary())], [*carried, "n_bytes", "n_removed", "n_spans", "kept"])


def later(found: DataFrame, keys: list[str], first: DataFrame | None = None) -> DataFrame:
    """The rows of which another with the same keys lies earlier in the corpus; first has the earliest of several, if known."""
    first = earliest(found, keys) if first is None else first
    return found.join(first, keys).where("again OR doc_id > _low").drop("_low", "again")


def earliest(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.min("doc_id").alias("_low"), F.count("*").alias("_n")).where("_n > 1").drop("_n")


def resolve(parsed: DataFrame, slices: int) -> tuple[DataFrame, DataFrame]:
    """Of rows of _PARSED: those that repeat an earlier one, and the first of each where a trigger has several.

    The triggers are taken in slices, so that the shuffles of one slice at a time lie on disk; what was parsed goes once
    all are done. What triggers and phrases share is written before it is joined: Spark splits a very common key in a
    join of tables, but not where one side is an aggregate.
    """
    parsed, release = scratch(parsed)
    held = []
    for k in range(slices):
        own = parsed.where(F.pmod("trigger", F.lit(slices)) == k)
        shared = cut(own.groupBy("trigger").agg(F.count("*").alias("k"), (F.min("phrase") != F.max("phrase")).alias("mixed")).where("k > 1").drop("k"))
        held.append(cut(own.join(shared, "trigger")))
    release()
    found = reduce(DataFrame.union, held)
    keys = ["trigger", "phrase"]
    repeats = cut(later(found.drop("mixed"), keys, cut(earliest(found, keys))).select("doc_id", "start", "n"))
    return repeats, found.where("mixed").join(repeats, ["doc_id", "start"], "left_anti")


def placed(docs: DataFrame) -> DataFrame:
    """docs with ``_place``, one number for each pair of doc_id and text; null for rows without a doc_id."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(sha).alias("_own"), F.max(sha).alias("_top")).where("_own < _top").drop("_top")
    later = F.lit(1 << 62).bitwiseOR(F.xxhash64("doc_id", sha).bitwiseAND(F.lit((1 << 62) - 1)))
    return docs.join(cut(several), "doc_id", "left").withColumn("_place", F.when(F.col("_own").isNull() | (F.col("_own") == sha), F.col("doc_id")).otherwise(later)).select(*docs.columns, "_place")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with n_bytes, n_removed, n_spans and ``kept``, the bytes that stay."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    at_place = placed(docs)
    own = at_place.where("_place IS NOT NULL").select(F.col("_place").alias("doc_id"), "text")
    ids = own.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    firsts = ids.groupBy("sha").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(ids.join(firsts, "sha").where("doc_id != low").select("doc_id").distinct())
    once = own.join(copies, "doc_id", "left_anti")
    whole, entries = resolve(once.mapInArrow(_phrases, _PARSED), SLICES)
    opened = entries.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "lead")).alias("opened"))
    part, entries = resolve(once.join(opened, "doc_id").mapInArrow(_runs, _PARSED), 1)
    opened = entries.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "trigger")).alias("opened"))
    strings = once.join(opened, "doc_id").mapInArrow(lambda b: _gathered(_strings(b)), "doc_id bigint, start bigint, trigger bigint, string bigint, again boolean")
    again = later(strings, ["trigger", "string"])
    marks = whole.union(part).select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))
    marks = marks.union(again.select("doc_id", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")))
    marks = marks.groupBy(F.col("doc_id").alias("_place")).agg(F.collect_list(F.struct("a", "b")).alias("_marks"))
    marked = at_place.join(copies.select(F.col("doc_id").alias("_place"), F.lit(True).alias("_copy")), "_place", "left").join(marks, "_place", "left").select(*docs.columns, "_copy", "_marks")
    schema = StructType([*docs.schema.fields, *(StructField(k, LongType()) for k in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    return marked.mapInArrow(_removed, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 100 bytes by its md5; texts are cut into blocks first, so that no substring is far from a beginning.
SQL = r"""WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
b AS (SELECT doc_id, n, x, unnest(range(0, n - 99, 500)) AS o FROM h),
c AS (SELECT doc_id, o, substring(x, 2 * o + 1, 1198) AS x, least(500, n - 99 - o) AS m FROM b),
s AS (SELECT doc_id, o, x, unnest(range(0, m)) AS a FROM c),
k AS (SELECT doc_id, o + a AS a, md5_number(substring(x, 2 * a + 1, 200)) AS k FROM s),
r AS (SELECT doc_id, a FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, a) > 1),
i AS (SELECT doc_id, a, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS span FROM (SELECT doc_id, a, (a > coalesce(lag(a) OVER (PARTITION BY doc_id ORDER BY a), -101) + 100)::INT AS fresh FROM r)),
g AS (SELECT doc_id, min(a) AS a, max(a) + 100 AS b FROM i GROUP BY doc_id, span),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM g),
q AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS gone, max(b) AS upto, string_agg(substring(x, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS head FROM p JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(x, 2 * coalesce(upto, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN q USING (doc_id)"""
