"""Column functions: parsing, scaling, distance, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the earth's radius.
EARTH_KM = 6371.0


def first_number(text: Column, decimals: bool = True) -> Column:
    """The first number in a text, or null."""
    return F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)" if decimals else r"(\d+)", 1), F.lit("")).try_cast("double")


def price_midpoint(text: Column) -> Column:
    """``$10-20`` gives 15 and ``$100+`` 100; there must be something between or after the numbers."""
    # Fixed value: what a price range looks like.
    pattern = r"\$(\d+)\D+(\d+)?"
    low, high = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("double") for k in (1, 2))
    return F.when(low.isNotNull(), (low + F.coalesce(high, low)) / 2)


#: What a relative age says, in the order in which it is tried, and the days of one such unit.
AGE_RULES = [
    (r"(\d+)\s+year", 365), (r"a\s+year", 365), (r"(\d+)\s+month", 30), (r"a\s+month", 30), (r"(\d+)\s+week", 7), (r"a\s+week", 7),
    (r"(\d+)\s+day", 1), (r"yesterday", 1), (r"today|just now", 0),
]


def age_days(text: Column) -> Column:
    """Days from a relative age by the first rule that fits; hours and texts that no rule covers give null."""
    t = F.lower(text)
    out = F.lit(None).cast("bigint")
    for pattern, days in reversed(AGE_RULES):
        n = F.regexp_extract(t, pattern, 1).cast("bigint") if pattern[0] == "(" else F.lit(1).cast("bigint")
        out = F.when(t.rlike(pattern), n * days).otherwise(out)
    return out


def number(text: Column) -> Column:
    """A number, or null where the text is none."""
    return text.try_cast("double")


def thousands(text: Column) -> Column:
    """The first whole number of a text, with or without separators of thousands."""
    return F.replace(F.nullif(F.regexp_extract(text, r"(\d[\d,]*)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("bigint")


def split_list(text: Column, least: int = 3) -> Column:
    """The parts between commas, normalised, of at least so many characters."""
    return F.filter(F.transform(F.split(text, ","), plain), lambda x: F.length(x) >= least)


def first_mapped(text: Column, mapping: dict[str, str], noise: list[str], fallback: str) -> Column:
    """What the first part between commas stands for that is mapped and no noise."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    parts = F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x.isin(list(mapping)) & ~x.isin(noise))
    return F.coalesce(F.try_element_at(table, F.try_element_at(parts, F.lit(1))), F.lit(fallback))


def json_list(text: Column, kind: str) -> Column:
    """A JSON array; empty where the text is none."""
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def window_share(values: Column, low: int, high: int) -> Column:
    """The share of an array's sum that lies at places from low to before high; 0 without a sum."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    total = add(values)
    return F.when(total > 0, add(F.slice(values, low + 1, high - low)) / total).otherwise(0.0)


def bounded_text(texts: Column, pieces: int, each: int, total: int) -> Column:
    """Of an ordered array: the first ``pieces`` texts, white space collapsed, blank ones left out, ``each`` characters of each, ``total`` in all."""
    return capped(F.filter(F.transform(F.slice(texts, 1, pieces), lambda t: piece(t, each)), lambda t: t != ""), total)


def piece(text: Column, each: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, each)


def capped(texts: Column, total: int) -> Column:
    """The texts up to so many characters in all, the last one cut."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))
    room = lambda s: F.greatest(F.lit(total) - s.used, F.lit(0))
    add = lambda s, t: F.struct(F.when(room(s) > 0, F.concat(s.out, F.array(t.substr(F.lit(1), room(s))))).otherwise(s.out).alias("out"), (s.used + F.least(F.length(t), room(s))).alias("used"))
    return F.aggregate(texts, start, add, lambda s: s.out)


def aligned(attribute: Column, user: Column, item: Column, high_only: list[str], both_ways: list[str], policy: str = "strict") -> Column:
    """Whether two values of an attribute agree: close, and both clearly high, or both clearly low where low says something."""
    if policy == "legacy":
        return ((user >= 0.6) & (item >= 0.6)) | ((user <= 0.4) & (item <= 0.4))
    high, low = (user >= 0.65) & (item >= 0.65), (user <= 0.35) & (item <= 0.35)
    return (F.abs(user - item) <= 0.25) & ((attribute.isin(high_only) & high) | (attribute.isin(both_ways) & (high | low)))


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(dlat) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ndcg(rank: Column) -> Column:
    return F.when(rank.isNotNull(), 1 / F.log2(rank + 1.0)).otherwise(0.0)


def zero_pad(text: Column, width: int) -> Column:
    """Pads, and never cuts, as lpad alone would."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def retry(message: Column, outcome_asked: Column, old_enough: Column) -> Column:
    """Whether to try again: only outcomes that are asked for; lost resources always, others when long enough ago."""
    # Messages of attempts that never reached the other side.
    lost = F.lower(message).rlike("too many open files|cannot allocate memory")
    return F.when(~outcome_asked, F.lit(False)).when(lost, F.lit(True)).otherwise(F.coalesce(old_enough, F.lit(True)))
