"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

Two collections of SIDE sub-signatures, each of WIDTH minhashes, are combined in pairs: SIDE * SIDE tables with keys of
2 * WIDTH minhashes out of 2 * SIDE * WIDTH minhashes computed. A pair of similarity s shares no key with probability of
about 2 * (1 - s**WIDTH)**SIDE: 4e-4 at 0.80, 2e-5 at 0.85, 1e-7 at 0.90. Only sub-signatures that occur twice are combined.

Equal sets are collapsed first. Within a bucket, each member is compared with the smallest and the largest member only;
what these links leave in different components of a bucket is then joined on rare shingles, but for the bucket's largest
component with itself, which is connected already; only pairs whose sizes and places of a shared shingle allow a link
are compared. So no bucket is gathered, none is capped and no candidate link that could join two components is left out.

Texts without words (null, empty) are linked with nothing. Rows that share a doc_id count as one document; rows with a
null doc_id are their own component (null) and kept. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import cut, documents, mix, powers, prefix_hash, rows, utf8

SIDE, WIDTH, SHINGLE = 12, 3, 5
PERCENT = 85
STRETCH = 1 << 21
LONG = 256
#: Documents that a task hashes at once: numpy holds some hundred bytes for each of their letters, and a worker keeps them.
SLICE = 128
#: What parts words, the space and the ASCII controls from tab to carriage return.
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_rng = np.random.default_rng(20240601)
_STEP = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(1, 2**63, 2 * SIDE * WIDTH, dtype=np.uint64)
_MUL = _rng.integers(1, 2**63, 2 * SIDE * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lower-cased words of the texts between the edges, and where each text's begin and the last end."""
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    within = np.r_[~_GAP[data], False]
    starts = within[:-1] & ~np.r_[False, within[:-2]]
    begin = edges[:-1][edges[1:] > edges[:-1]]
    starts[begin] = within[begin]
    ends = within[:-1] & ~within[1:]
    last = begin[1:] - 1
    ends[last] = within[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # in stretches of whole words
        m = max(k + 1, int(np.searchsorted(ends, starts[k] + STRETCH, "right")))
        low = starts[k]
        total, inverse = prefix_hash(data[low : ends[m - 1]]), powers(int(ends[m - 1] - low))[1]
        out[k:m] = (total[ends[k:m] - low] - total[starts[k:m] - low]) * inverse[starts[k:m] - low]
        for i in k + np.flatnonzero(ends[k:m] - starts[k:m] > LONG):
            out[i] = long_word(total, inverse, int(starts[i] - low), int(ends[i] - low))
        k = m
    return mix(out), np.searchsorted(starts, edges)


def long_word(total: np.ndarray, inverse: np.ndarray, start: int, end: int) -> np.uint64:
    """The hash of a word in blocks of LONG bytes, each mixed before the next. A polynomial modulo 2**64 takes crafted
    texts of some thousand letters for one another, whatever its base; none as short as a block."""
    at = np.arange(start, end, LONG)
    blocks = mix((total[np.minimum(at + LONG, end)] - total[at]) * inverse[at])
    held = np.array([end - start], np.uint64)
    for b in blocks:
        held = mix(held + b) * np.uint64(0x9E3779B97F4A7C15)
    return held[0]


def shingle_hashes(data: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """For each text between the edges, the sorted 64-bit hashes of its distinct 5-word shingles; of the whole sequence if there are fewer words."""
    h, ends = words(data, edges)
    n = max(0, len(h) - SHINGLE + 1)
    total = np.full(n, SHINGLE, np.uint64)
    for j in range(SHINGLE):
        total += h[j : j + n] * _STEP[j]
    total = mix(total)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if 0 < b - a < SHINGLE:
            out.append(mix(np.array([b - a], np.uint64) + (h[a:b] * _STEP[: b - a]).sum(dtype=np.uint64)))
            continue
        own = np.sort(total[a : b - SHINGLE + 1] if b > a else total[:0])
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
    return out


def shingles(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return shingle_hashes(data, np.array([0, len(data)]))[0]


def minhashes(found: list[np.ndarray]) -> np.ndarray:
    """The minhashes of sets that are not empty, [set, minhash]; in blocks of sets, and large sets in pieces."""
    least = np.full((len(found), len(_SEED)), 2**64 - 1, np.uint64)
    at = 0
    while at < len(found):
        upto, n = at + 1, len(found[at])
        while upto < len(found) and n + len(found[upto]) <= 32_768:
            n += len(found[upto])
            upto += 1
        sizes = np.array([len(x) for x in found[at:upto]])
        flat = np.concatenate(found[at:upto])
        for low in range(0, n, 1 << 20):
            part = flat[low : low + (1 << 20)]
            starts = np.cumsum(sizes) - sizes if low == 0 else np.zeros(1, np.int64)
            for k in range(len(_SEED)):
                x = (part ^ _SEED[k]) * _MUL[k]
                own = least[at:upto, k]
                np.minimum(own, np.minimum.reduceat(x, starts), out=own)
        at = upto
    return least


def band_keys(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sub-signatures of the two collections, [set, sub-signature]; a table is a pair of them."""
    m = minhashes(found).reshape(len(found), 2 * SIDE, WIDTH)
    keys = m[:, :, 0]
    for j in range(1, WIDTH):
        keys = mix(keys) + m[:, :, j]
    keys = mix(keys).view(np.int64)
    return keys[:, :SIDE], keys[:, SIDE:]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows(batches, SLICE):
        found = shingle_hashes(*utf8(b))
        some = [x for x in found if len(x)]
        left, right = band_keys(some) if some else (np.empty((0, SIDE), np.int64),) * 2
        empty = pa.array([not len(x) for x in found], pa.bool_())
        sets = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found], pa.binary())
        lists = []
        for side in (left, right):
            ends = np.cumsum([0, *(SIDE if len(x) else 0 for x in found)])
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(side.reshape(-1)), mask=empty))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in found], pa.int64()), sets, *lists], ["doc_id", "n_shingles", "same", "left", "right"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows(batches, SLICE):
        found = shingle_hashes(*utf8(b))
        ends = np.cumsum([0, *map(len, found)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), lists], ["doc_id", "found"])


def shingle_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, found): the full shingle sets of the documents in wanted."""
    return cut(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, found array<bigint>"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("found").alias(f"{k}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - both
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * union).select("a", "b")


def close_pairs(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of members (doc_id, component, outer) of two components, one of them outer, that can be similar enough.

    All shingles are put into one order, those that no other component has first and then rare ones. Similar sets then
    share one so early in both that enough follows it; only pairs that do are returned, and every similar pair does.
    """
    held = sets.join(members, "doc_id").withColumn("n", F.size("found").cast("bigint"))
    each = held.select("doc_id", "component", "outer", F.explode("found").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or("outer").alias("outer"))
    common = common.where("low < high AND outer").select("h", "df")
    shared = each.select("doc_id", "h").join(common, "h").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    place = held.drop("found").join(shared, "doc_id").withColumn("first", F.col("n") - F.size("s"))
    # A set of n needs percent * n / 100 in common with any other, and one no smaller 2 * percent * n / (100 + percent).
    keep = F.expr(f"greatest(0L, n - ({percent}L * n + 99L) div 100L + 1L - first)").cast("int")
    keys = place.withColumn("s", F.slice("s", F.lit(1), keep)).select("doc_id", "component", "outer", "n", "first", F.posexplode("s").alias("i", "x"))
    keys = cut(keys.select("doc_id", "component", "outer", "n", (F.col("first") + F.col("i")).alias("at"), F.col("x.h").alias("h")))
    short = keys.where(f"at <= n - ({2 * percent}L * n + {99 + percent}L) div {100 + percent}L")
    side = lambda t, k: t.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "component", "n", "at")])
    enough = f"component_x != component_y AND n_x <= n_y AND {100 + percent} * least(n_x - at_x, n_y - at_y) >= {percent} * (n_x + n_y)"
    meet = lambda x, y: side(x, "x").join(side(y, "y"), "h").where(enough).select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b"))
    return meet(short.where("outer"), keys).union(meet(short.where("NOT outer"), keys.where("outer"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for all ids in links.

    Each round points every node to its smallest neighbour, shortens the pointers to their ends and contracts the
    links; every node that is not a smallest one disappears, so the rounds are logarithmic in number.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        least = both(edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        least = cut(least)
        while True:
            up = least.select(F.col("id").alias("to"), F.col("to").alias("top")).where("to != top")
            moved = cut(least.join(up, "to", "left").select("id", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")))
            least = moved.select("id", "to")
            if moved.where("moved").isEmpty():
                break
        labels = least if labels is None else cut(labels.join(least.select(F.col("id").alias("to"), F.col("to").alias("top")), "to", "left").select("id", F.coalesce("top", "to").alias("to")))
        a, b = (least.select(F.col("id").alias(k), F.col("to").alias(f"{k}_to")) for k in "ab")
        edges = cut(edges.join(a, "a").join(b, "b").where("a_to != b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.select("id", F.col("to").alias("component"))


def bucketed(reps: DataFrame) -> DataFrame:
    """(doc_id, n, bucket) for each table's key of a document that may have company: both its sub-signatures occur twice."""
    side = lambda name, at: F.transform(name, lambda x, i: F.struct((i + at).cast("tinyint").alias("k"), x.alias("x")))
    keys = cut(reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode(F.concat(side("left", 0), side("right", SIDE))).alias("s")).select("doc_id", "n", "s.k", "s.x").distinct())
    shared = keys.groupBy("k", "x").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    of = lambda right: F.transform(F.filter("s", lambda s: (s.k >= SIDE) == F.lit(right)), lambda s: F.struct(s.k, s.x))
    held = keys.join(shared, ["k", "x"]).groupBy("doc_id", "n").agg(F.collect_list(F.struct("k", "x")).alias("s")).select("doc_id", "n", of(False).alias("left"), of(True).alias("right"))
    tables: Column = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.xxhash64(a.k, b.k, a.x, b.x))))
    return held.select("doc_id", "n", F.explode(tables).alias("bucket"))


def can_link(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    schema = "doc_id bigint, n_shingles bigint, same binary, left array<bigint>, right array<bigint>"
    found = cut(docs.select("doc_id", "text").mapInArrow(_signatures, schema))
    classes = found.where("same IS NOT NULL AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = cut(classes)
    reps = found.join(classes.select("same", F.col("rep").alias("doc_id")), ["same", "doc_id"], "left_semi")
    members = bucketed(reps)
    end = F.struct("doc_id", "n")
    buckets = members.groupBy("bucket").agg(F.min(end).alias("low"), F.max(end).alias("high")).where("low.doc_id < high.doc_id")
    members = cut(members.join(buckets, "bucket"))
    stars = members.select("doc_id", "n", F.explode(F.array("low", "high")).alias("end")).where(F.col("doc_id") != F.col("end.doc_id")).where(can_link("n", "end.n", percent))
    stars = cut(stars.select(F.least("doc_id", "end.doc_id").alias("a"), F.greatest("doc_id", "end.doc_id").alias("b")).distinct())
    sets = shingle_sets(members.select("doc_id").distinct(), docs)
    linked = cut(verified(stars, sets, percent))
    parts = components(linked)
    placed = members.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("all")).where("parts > 1 AND all > 2")
    rest = placed.join(open_.select("bucket", "main"), "bucket")
    rest = cut(rest.groupBy("doc_id", "component").agg(F.bool_or(F.col("component") != F.col("main")).alias("outer")))
    if not rest.isEmpty():
        linked = linked.union(verified(cut(close_pairs(rest, sets, percent).join(stars, ["a", "b"], "left_anti")), sets, percent))
        parts = components(linked)
    tops = classes.where("n > 1").select("same", "rep")
    placed = found.join(tops, "same", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = placed.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: Links by an inverted index on the shingles, then a recursive walk from each document.
LINKS_SQL = r"""
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM docs6),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4])) END AS ss FROM w),
x AS MATERIALIZED (SELECT doc_id, hash(unnest(ss)) AS h FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.ss) + len(q.ss) - n)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk AS (SELECT a AS doc_id, b AS seen FROM both_ways UNION SELECT walk.doc_id, both_ways.b FROM walk JOIN both_ways ON walk.seen = both_ways.a),
c AS (SELECT doc_id, min(seen) AS low FROM walk GROUP BY doc_id),
o6 AS (SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id FROM s LEFT JOIN c USING (doc_id))
"""
SQL = f"WITH RECURSIVE docs6 AS (SELECT doc_id, text FROM documents), {LINKS_SQL} SELECT *, doc_id = component_id AS kept FROM o6"
