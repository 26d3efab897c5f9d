"""documents to token ids: quality rules, near-duplicates, repeated passages, source mix, BPE.

Null doc_ids pass every stage; null texts fail the quality rules. Extra columns are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, minhash, mixing, quality_rules, suffix_dedup
from lodestream.llm.common import shared_dir

ASIDE = "\uffff"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(docs.select(*COLUMNS))).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links from a similarity of 0.80 on; op 6 alone has 0.85."""
    gone = minhash.near_duplicates(docs, percent=80).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a removal leaves of a split character are dropped; n_chars is that of what stays."""
    kept = suffix_dedup.remove_repeats(docs)
    held = F.col("kept").cast("string")
    # Genuine replacement characters wait as a character that XML and JSON forbid, unless the text has that as well.
    aside = F.replace(F.make_valid_utf8(F.replace(held, F.lit("�"), F.lit(ASIDE))), F.lit("�"), F.lit(""))
    text = F.coalesce(F.try_validate_utf8(held), F.when(F.contains(held, F.lit(ASIDE)), F.replace(F.make_valid_utf8(held), F.lit("�"), F.lit(""))).otherwise(F.replace(aside, F.lit(ASIDE), F.lit("�"))))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", rules),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", passages),
    ("mix_sources", mixture),
    ("bpe_encode_decode", token_ids),
]
#: The library's encoding is not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}_{name}")
        docs = spark.read.parquet(f"{top}/{k}_{name}")
    return docs
