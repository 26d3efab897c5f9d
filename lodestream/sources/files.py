"""Other file formats than the driver's tables, and sinks."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def csv_strings(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A CSV file with a header, every column as text: leading zeros of codes survive."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("sep", sep).csv(path)


def coded_counts(spark: SparkSession, path: str, columns: list[str], prefix: str) -> DataFrame:
    """A pipe-delimited file: rows whose first column has the prefix, which is taken off; the other columns as numbers, or null."""
    raw = csv_strings(spark, path, columns, "|").where(F.startswith(F.col(columns[0]), F.lit(prefix)))
    return raw.select(F.substring(columns[0], len(prefix) + 1, 2**31 - 1).alias(columns[0]), *[F.col(c).try_cast("double").alias(c) for c in columns[1:]])


def nested_documents(spark: SparkSession, path: str, schema: str, array: str, defaults: dict[str, Column], lines: bool = False) -> DataFrame:
    """A folder of JSON documents, a row for each member of an array of theirs; broken ones are skipped, missing fields get
    their defaults. A file has one document, or with ``lines`` one in each line."""
    docs = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = docs.where("_corrupt IS NULL").select("*", F.explode(array).alias("_x")).select(*[c for c in docs.columns if c not in ("_corrupt", array)], "_x.*")
    return rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def checkpoint_lines(spark: SparkSession, path: str, schema: str, key: str, version: int) -> DataFrame:
    """Rows of a JSONL log that are well formed, done and of this version; of several with one key the last written counts."""
    lines = spark.read.text(path).select(F.from_json("value", f"{schema}, status string, version int, seq bigint").alias("r")).where("r IS NOT NULL").select("r.*")
    kept = lines.where((F.col("status") == "ok") & (F.col("version") == version) & F.col(key).isNotNull())
    return kept.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.col("seq").desc()))).where("_k = 1").drop("_k", "status", "version")


def pushed_in(df: DataFrame, key: str, values: list, order: list[Column]) -> DataFrame:
    """The first row of each wanted key; the list is pushed down to the scan."""
    return df.where(F.col(key).isin(values)).withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def shard(df: DataFrame, key: str, shards: int, which: int) -> DataFrame:
    """One of so many parts, by the key's hash: stable, and without numbering all rows."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(shards)) == which)


def _fs(spark: SparkSession, path: str):
    """Hadoop's file context of a path, and the path, as Spark's own writers have them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name and renames it: who reads the path sees the old text or the new one."""
    files, hadoop = _fs(spark, path)
    jvm, aside = spark.sparkContext._jvm, hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    files.mkdir(aside.getParent(), hadoop.permission.FsPermission.getDirDefault(), True)
    flags = jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE)
    out = files.create(aside, flags, spark.sparkContext._gateway.new_array(hadoop.Options.CreateOpts, 0))
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    files.rename(aside, hadoop.Path(path), how)


POINTER = "current.json"


def replace_table(df: DataFrame, path: str) -> dict:
    """Replaces a table at once: a new version is written beside the old one, and then one small file is renamed that names it.

    Returns that file's text, the manifest (version, rows, columns). A write that fails leaves the old version in place;
    who has read the manifest goes on with its version. Versions stay until ``drop_versions``. The rename is atomic on
    local disks' metadata and HDFS; on object stores it is as good as their overwrite of one object.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.option("compression", "zstd").parquet(f"{path}/{version}")
    held = spark.read.parquet(f"{path}/{version}")
    manifest = {"version": version, "rows": held.count(), "columns": held.columns}
    _put(spark, f"{path}/{POINTER}", json.dumps(manifest))
    return manifest


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{POINTER}", wholetext=True).first()[0])


def current_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{manifest(spark, path)['version']}")


def drop_versions(spark: SparkSession, path: str) -> None:
    """Removes all versions but the current one; for when no job reads them any more."""
    files, hadoop = _fs(spark, path)
    keep, found = {manifest(spark, path)["version"], POINTER}, files.listStatus(hadoop.Path(path))
    while found.hasNext():
        own = found.next().getPath()
        if own.getName() not in keep:
            files.delete(own, True)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a CSV log: each part has the header once, and parts of several writers never mix."""
    df.write.mode("append").option("header", True).csv(path)


def mark_done(spark: SparkSession, path: str, stems: list[str]) -> None:
    """An empty ``<stem>.done`` file for each of a few stems."""
    for stem in stems:
        _put(spark, f"{path}/{stem}.done", "")


def done_stems(spark: SparkSession, path: str) -> DataFrame:
    """(stem) of the ``*.done`` files of a folder, empty ones included: of the list of files that Spark makes of any folder."""
    names = spark.read.option("pathGlobFilter", "*.done").text(path).inputFiles()
    stems = [unquote(n.rsplit("/", 1)[1]).removesuffix(".done") for n in names]
    return spark.createDataFrame(pa.table({"stem": pa.array(stems, pa.string())}))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest): the same for equal rows in any order. Rows' hashes are put in order and chained by range, then the ranges' hashes are."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    each = df.select(row.alias("h")).withColumn("p", F.substring("h", 1, 2))
    ranges = each.groupBy("p", F.substring("h", 3, 2).alias("q")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    firsts = ranges.groupBy("p").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", "h"))), lambda x: x.h), ""), 256).alias("h"))
    return firsts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x.h), ""), 256).alias("digest"))
