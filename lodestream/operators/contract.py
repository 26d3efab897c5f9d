"""Feature matrices by contract: one vector a key, with a map from names to slots and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.relational import fill_by_name, numeric_columns

#: Columns that say where a row comes from, and are no features.
PROVENANCE = ("source_review_count", "schema_version", "model", "generated_at")


def clean(name: str) -> str:
    """A name of lower-case letters, digits and single underscores."""
    return "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split())


def slots(key: str, groups: dict[str, DataFrame], skip: tuple[str, ...] = ()) -> list[tuple[int, str, str]]:
    """(slot, name, group) of the numeric columns of the groups, in their order; a name that two groups have is an error."""
    named = [(clean(c), g) for g, df in groups.items() if g not in skip for c in numeric_columns(df, [key, *PROVENANCE])]
    names = [n for n, _ in named]
    if len(set(names)) < len(names):
        raise ValueError(f"names in several places: {sorted({n for n in names if names.count(n) > 1})}")
    return [(k, n, g) for k, (n, g) in enumerate(named)]


def assemble(spine: DataFrame, key: str, groups: dict[str, DataFrame], skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, vector): for every key of spine the features of the groups in their slots; what is unknown is filled by name.

    Each group, one row a key, is joined once; all are dealt out by the same key, so Spark shuffles each side once.
    """
    out = spine.select(key).distinct()
    for group, df in groups.items():
        if group not in skip:
            own = numeric_columns(df, [key, *PROVENANCE])
            out = out.join(df.select(key, *[F.col(c).cast("double").alias(clean(c)) for c in own]), key, "left")
    names = [n for _, n, _ in slots(key, groups, skip)]
    return fill_by_name(out, names).select(key, F.array(*names).alias("vector"))


def slot_table(spark: SparkSession, key: str, groups: dict[str, DataFrame], skip: tuple[str, ...] = ()) -> DataFrame:
    return spark.createDataFrame(slots(key, groups, skip), "slot int, name string, group string")
