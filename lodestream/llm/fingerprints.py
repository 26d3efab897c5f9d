"""Document fingerprints by one-permutation MinHash, with DataFrame functions alone.

The 64-bit hashes of a text's 5-word shingles (lower-cased words; all words as one where there are fewer) are sorted
once, together with an end mark for each of BINS bins. The high bits of a hash name its bin, and a bin keeps its least
hash; a bin led by its end mark is empty. An empty bin takes the value of a bin chosen by optimal densification: hash
(bin, attempt) until a filled bin is hit; after PROBES misses the filled bin of least hash (bin, filled bin) is taken,
which is as uniform a choice and needs no further attempts. A fingerprint packs the low BITS bits of each bin, in hex;
likeness corrects the matches for those of chance.

Null texts count as empty; texts without words have the empty fingerprint, alike (1) to one another and unlike (0) all
others. The next document, in descending doc_id order, is that with the next smaller id; rows that share a doc_id stand
side by side, ordered by text. Rows with null ids come at the end, ordered by a hash of their text. Other columns are not
read. Rows that share one id, or null ids of equal texts, are ordered in one task.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.llm.common import documents

BINS, BITS, SHINGLE, PROBES = 256, 8, 5, 16
#: The bits of a hash below those that name its bin; all set in a bin's end mark.
_BELOW = 64 - (BINS.bit_length() - 1)
_END = (1 << _BELOW) - 1
#: Ids are cut into up to so many stretches of about equally many rows, and each of these into up to so many blocks of
#: equal width, of BLOCK_ROWS rows or more on average: each block repeats one row of another.
STRETCHES, BLOCKS, BLOCK_ROWS = 256, 256, 256


def turns() -> list[str]:
    """For each attempt, the bin that each bin turns to, drawn by a generator seeded with both; as text, so it folds to one literal."""
    return [" ".join(str(random.Random(f"{t}:{b}").randrange(BINS)) for b in range(BINS)) for t in range(PROBES)]


def _bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the bins of a text column: BINS numbers, or none for a text without words."""
    n = F.size("_g")
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_g", F.transform(words, lambda w: F.xxhash64(w)))
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), _BELOW).bitwiseOR(F.lit(_END)))
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_g", i, F.lit(SHINGLE))))
    df = df.withColumn("_h", F.when(n > 0, F.sort_array(F.concat(hashes, ends))))
    # In ascending order the bins come in runs, each led by its least hash; every bin has a run.
    bin_of = lambda h: F.shiftright(h, _BELOW)
    lead = F.filter("_h", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("_h", i - 1))))
    value = lambda h: F.when(h.bitwiseAND(F.lit(_END)) != _END, h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    df = df.withColumn("_slot", F.transform(lead, value))
    df = df.withColumn("_filled", F.filter(F.transform("_slot", lambda v, b: F.struct(b.alias("b"), v.alias("v"))), lambda x: x.v.isNotNull()))
    least = lambda b: F.array_min(F.transform("_filled", lambda x: F.struct(F.xxhash64(x.b, b).alias("h"), x.v.alias("v")))).v
    turned = [F.split(F.lit(x), " ").cast("array<int>") for x in turns()]
    filled = F.transform("_slot", lambda v, b: F.coalesce(v, *[F.get("_slot", F.get(to, b)) for to in turned], least(b)).cast("short"))
    # _filled is named twice here, so Spark makes it once a row instead of within the loop over bins.
    return df.withColumn(out, F.when(F.size("_filled") > 0, filled).otherwise(F.array().cast("array<smallint>"))).drop("_g", "_h", "_slot", "_filled")


def packed(bins: Column) -> Column:
    """A fingerprint: the bins' low bits, in hex."""
    digits = F.split(F.lit(" ".join(f"{v:0{BITS // 4}x}" for v in range(1 << BITS))), " ")
    return F.array_join(F.transform(bins, lambda v: F.get(digits, v.cast("int"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the shingle sets behind two rows of bins, 0 to 1, corrected for chance matches."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(corrected)


def blocks(docs: DataFrame) -> DataFrame:
    """docs with ``_at``, the number that orders a row, and ``_block``, a number for each block of them, in the same order.

    The stretches' bounds are approximate quantiles of the ids, so that neither gaps nor dense places make large blocks.
    """
    q = [k / STRETCHES for k in range(STRETCHES + 1)]
    found, n = docs.agg(F.percentile_approx("doc_id", q, 10_000), F.count("*")).first()
    wanted = max(1, n // BLOCK_ROWS)
    lows = sorted(set((found or [0])[:: -(-STRETCHES // min(STRETCHES, wanted))]))
    parts = min(BLOCKS, -(-wanted // STRETCHES))
    widths = [max(1, -(-(b - a) // parts)) for a, b in zip(lows, [*lows[1:], max(found or [0]) + 1])]
    at = F.greatest(F.size(F.filter(F.array(*map(F.lit, lows)), lambda x: x <= F.col("doc_id"))), F.lit(1))
    # Exact numbers: the distance between two ids may pass 2**63.
    exact = lambda c: c.cast("decimal(20,0)")
    low, width = (F.element_at(F.array(*[exact(F.lit(str(x))) for x in xs]), at) for xs in (lows, widths))
    within = F.floor((exact(F.col("doc_id")) - low) / width).cast("bigint")
    null_at = F.xxhash64("text")
    null_block = F.shiftright(null_at, 54) - (1 << 20)
    own = at.cast("bigint") * (BLOCKS + 1) + F.least(F.greatest(within, F.lit(0)), F.lit(BLOCKS))
    return docs.withColumns({"_at": F.coalesce("doc_id", null_at), "_block": F.when(F.col("doc_id").isNull(), null_block).otherwise(own)})


def with_guests(docs: DataFrame) -> DataFrame:
    """docs in blocks, and in each block a ``_guest``: the document that follows its smallest one.

    A block's guest is the largest document of the block below; the lowest block's is the largest of all. A short row for
    each of the blocks, of which there are STRETCHES * (BLOCKS + 1) + 1024 at most, is broadcast and ordered in one task.
    """
    docs = blocks(docs)
    tops = docs.groupBy("_block").agg(F.max("_at").alias("_top"))
    order = W.orderBy("_block")
    to = F.coalesce(F.lead("_block").over(order), F.first("_block").over(order))
    tops = tops.select(F.col("_block").alias("_of"), "_top", to.alias("_to"))
    at_top = (F.col("_block") == F.col("_of")) & (F.col("_at") == F.col("_top"))
    guests = docs.join(F.broadcast(tops), at_top).groupBy("doc_id", "_at", F.col("_to").alias("_block")).agg(F.max("text").alias("text"))
    return docs.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, edited, edited_fingerprint, near_edited and near_next of each row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("_block").orderBy(F.col("_guest").desc(), "_at", "text")
    both = _bins(with_guests(docs), "text", "bins")
    both = both.withColumns({f"next_{c}": F.lag(c).over(order) for c in ("text", "bins")}).where("NOT _guest")
    n = F.length("text")
    moved = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.col("next_text"), F.lit(1), moved))
    both = _bins(both.withColumn("edited", edited), "edited", "edited_bins")
    return both.select(
        "doc_id", n.cast("bigint").alias("n_chars"), packed(F.col("bins")).alias("fingerprint"), "edited", packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(documents(spark, sf_dir))
    return out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
