"""Joins by distance: points meet through grid cells, and full cells are counted without pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.expr import EARTH_KM, haversine
from lodestream.sources.shared import written

#: So many parts a cell's points are dealt into, so that a dense cell is joined by many tasks.
SALTS = 8


def cells(points: DataFrame, km: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """points with ``_y`` (rings of km in height), ``_x`` (columns at least km wide in the ring and the ones beside it) and ``_wide``, the columns of a ring."""
    height = math.degrees(km / EARTH_KM)
    y = F.floor(F.col(lat) / height)
    # The widest reach in longitude, by the ring's edge nearest to a pole, one ring further out.
    edge = F.least(F.lit(90.0), (F.abs(y.cast("double") + 0.5) + 2) * height)
    wide = F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / height)).cast("bigint")
    return points.withColumns({"_y": y, "_wide": wide}).withColumn("_x", F.pmod(F.floor((F.col(lng) + 180) / 360 * F.col("_wide")), F.col("_wide")))


def near_pairs(a: DataFrame, b: DataFrame, km: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of a (id, lat, lng) and b within km, as (id, other, km), each point of a with those of b; itself is left out.

    A point of a looks into the three rings around it and, in each, into the cells that its reach touches: longitudes
    wrap, and cells near a pole are few. ``keys`` must be equal as well. b is dealt into SALTS parts, to which a goes.
    """
    keys = keys or []
    height = math.degrees(km / EARTH_KM)
    own = cells(b, km).select(*keys, F.col("id").alias("other"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), "_x", "_y", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("_s"))
    rings = a.withColumn("_y", F.explode(F.sequence(F.floor(F.col("lat") / height) - 1, F.floor(F.col("lat") / height) + 1)))
    edge = F.least(F.lit(90.0), (F.abs(F.col("_y").cast("double") + 0.5) + 2) * height)
    wide = F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / height)).cast("bigint")
    at = F.floor((F.col("lng") + 180) / 360 * wide)
    around: Column = F.array_distinct(F.transform(F.array(F.lit(-2), F.lit(-1), F.lit(0), F.lit(1), F.lit(2)), lambda j: F.pmod(at + j, wide)))
    asked = rings.select(*keys, "id", "lat", "lng", "_y", F.explode(around).alias("_x")).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    dist = haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    return asked.join(own, [*keys, "_y", "_x", "_s"]).where(F.col("id") != F.col("other")).select(*keys, "id", "other", dist.alias("km")).where(F.col("km") <= km)


def near_count(points: DataFrame, km: float, keys: list[str] | None = None) -> DataFrame:
    """(id, near): the other points within km of each, 0 where there are none."""
    n = near_pairs(points, points, km, keys).groupBy("id").agg(F.count("*").alias("near"))
    return points.select("id").join(n, "id", "left").select("id", F.coalesce("near", F.lit(0)).alias("near"))


#: So many points of a key meet so many others in one place.
PART = 512


def pair_spread(points: DataFrame, key: str) -> DataFrame:
    """(key, n, mean, far) of the distances of the unordered pairs of each key's points (key, id, lat, lng); ids are distinct.

    A key's points are dealt into parts of PART, and each part meets each: a key of n points is (n / PART) squared groups
    of bounded size, whose pairs are summed where they are made.
    """
    points = written(points)
    parts = written(points.groupBy(key).agg(F.ceil(F.count("*") / PART).alias("_parts")))
    held = points.join(parts, key).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_parts")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))
    side = lambda n, a, b: held.withColumn("_each", every).select(key, F.col("_own").alias(a), F.col("_each").alias(b), *[F.col(c).alias(f"_{c}{n}") for c in ("id", "lat", "lng")])
    pairs = side(1, "_a", "_b").join(side(2, "_b", "_a"), [key, "_a", "_b"]).where("_id1 < _id2")
    km = haversine(F.col("_lat1"), F.col("_lng1"), F.col("_lat2"), F.col("_lng2"))
    return pairs.groupBy(key).agg(F.count("*").alias("n"), F.avg(km).alias("mean"), F.max(km).alias("far"))
