"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A source's repetition rate is its target share of the rows over its actual share. Each document draws a count from
the Poisson distribution with that mean, by inverting it at a uniform number hashed from seed and id, is repeated so
often, and the copies are ordered by a hash: a global shuffle that is the same on every run.

Null sources form a source of their own; a null or repeated doc_id draws like any other, so repeated rows draw alike.
Null and empty texts are carried along. A source without a weight gets none of the mix. An empty table stays empty.
Columns that clash with the ones added here are replaced.

Any rate is inverted: high ones, whose exp(-rate) would underflow, in a window about the mode beyond which less than
1e-25 remains, and the copies of their documents are dealt out in blocks. ``copy`` is an int, which would bound the
copies of one document at 2**31; without weights a rate stays below the square root of the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import documents

#: At most so many sources are broadcast (their tables of the distribution take some kilobytes each).
BROADCAST_SOURCES = 2000
#: Mean number of copies above which the distribution is taken from its mode: exp(-rate) would underflow.
MAX_RATE = 500.0
#: So many copies of a document with a high rate are made in one place.
BLOCK = 1000


def uniform(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, flatten: float = 0.5) -> DataFrame:
    """(source, rate): without weights, a source's target share is proportional to its row count to the power ``flatten``."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        wanted = counts.withColumn("weight", F.pow("n", F.lit(flatten)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "given string, weight double")
        wanted = counts.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = wanted.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_w"))
    return wanted.crossJoin(F.broadcast(total)).select("source", F.expr("if(all_w > 0, weight * all_n / (all_w * n), 0D)").alias("rate"))


def steps(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... until what remains is below the resolution of the uniform numbers."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    add = lambda s, k: F.struct((s.p * rate / k).alias("p"), F.concat(s.c, F.array(F.element_at(s.c, -1) + s.p * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s.c)


def window(rate: Column) -> Column:
    """(low, p): the first count of a high rate's window and its probability, by ratios from the mode outwards."""
    mode, reach = F.floor(rate), 12 * F.sqrt(rate) + 30
    add = lambda ratio: lambda s, k: F.struct((s.q * ratio(k)).alias("q"), (s.sum + s.q * ratio(k)).alias("sum"))
    none = F.struct(F.lit(1.0).alias("q"), F.lit(0.0).alias("sum"))
    low = F.floor(rate - reach)
    down = F.aggregate(F.sequence(mode, low + 1, F.lit(-1).cast("bigint")), none, add(lambda k: k / rate))
    up = F.aggregate(F.sequence(mode + 1, F.ceil(rate + reach)), none, add(lambda k: rate / k))
    return F.struct(low.alias("low"), (down["q"] / (1 + down["sum"] + up["sum"])).alias("p"))


def drawn_high(rate: Column, first: Column, draw: Column) -> Column:
    """The number of counts at which the distribution function is no more than the draw; no table of it is kept."""
    start = F.struct(first["p"].alias("p"), F.lit(0.0).alias("c"), first["low"].alias("n"))
    add = lambda s, k: F.struct((s.p * rate / (k + 1)).alias("p"), (s.c + s.p).alias("c"), (s.n + (s.c + s.p <= draw).cast("bigint")).alias("n"))
    return F.aggregate(F.sequence(first["low"], F.ceil(rate + 12 * F.sqrt(rate) + 30)), start, add, lambda s: s.n)


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, flatten: float = 0.5, seed: int = 17) -> DataFrame:
    """The columns of docs, ``copy`` (from 1) and ``shuffle_key``, ordered by the key."""
    table = rates(docs, weights, flatten)
    high = table.where(F.col("rate") > MAX_RATE)
    any_high = not high.isEmpty()
    table = table.where(F.col("rate") <= MAX_RATE).select(F.col("source").alias("_of"), steps(F.col("rate")).alias("_steps"))
    small = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    draw = uniform(F.lit(seed), F.col("doc_id"))

    def joined(to: DataFrame) -> DataFrame:
        return docs.drop("copy", "shuffle_key").join(F.broadcast(to) if small else to, F.col("source").eqNullSafe(F.col("_of")))

    n = F.size(F.filter("_steps", lambda c: c <= draw))
    copies = joined(table).withColumn("_n", n).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_of", "_steps", "_n")
    if any_high:
        first = high.select(F.col("source").alias("_of"), F.col("rate").alias("_rate"), window(F.col("rate")).alias("_first"))
        many = joined(first).withColumn("_n", drawn_high(F.col("_rate"), F.col("_first"), draw)).where("_n > 0")
        many = many.withColumn("_at", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"), F.lit(BLOCK).cast("bigint")))).drop("_of", "_rate", "_first")
        many = many.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        end = F.least(F.col("_n"), F.col("_at") + (BLOCK - 1))
        copies = copies.unionByName(many.withColumn("copy", F.explode(F.sequence(F.col("_at").cast("int"), end.cast("int")))).drop("_n", "_at"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}s"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("shuffle_key", key).orderBy("shuffle_key", "doc_id", "copy")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


SQL = """WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT source, sqrt(n::DOUBLE) * sum(n) OVER () / (sum(sqrt(n::DOUBLE)) OVER () * n) AS rate FROM n),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM t UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
s AS (SELECT source, list(c ORDER BY k) AS cs FROM c GROUP BY source),
d AS (SELECT documents.*, len(list_filter(cs, lambda x: x <= ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '~')), 1, 13))::BIGINT / 4503599627370496.0)) AS m FROM documents JOIN s ON documents.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('17s:' || coalesce(doc_id::VARCHAR, '~') || ':' || copy) AS shuffle_key FROM (SELECT *, unnest(generate_series(1, m)) AS copy FROM d)"""
