"""Polygons, intervals and fills over places, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import polygons as P
from lodestream.plans.registry import query
from lodestream.sources.tables import table

#: The corners of a hexagon of radius one.
CORNERS = [(1.0, 0.0), (0.5, 0.8660254037844386), (-0.5, 0.8660254037844386), (-1.0, 0.0), (-0.5, -0.8660254037844386), (0.5, -0.8660254037844386)]


def hexagon(x, y, radius):
    return F.array(*[F.struct((x + radius * a).alias("x"), (y + radius * b).alias("y")) for a, b in CORNERS])


def _ring_sql(radius: str) -> str:
    return "[" + ", ".join(f"{{'x': x + ({radius}) * ({a!r}::DOUBLE), 'y': y + ({radius}) * ({b!r}::DOUBLE)}}" for a, b in CORNERS) + "]"


#: A region about the middle of each label, every other one with a hole.
_REGIONS_SQL = f"""places AS (SELECT vec_id, label, embedding[2]::DOUBLE * 10 AS x, embedding[1]::DOUBLE * 10 AS y FROM embeddings),
middles AS (SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM places GROUP BY label),
regions AS (SELECT label AS id, CASE WHEN label % 2 = 0 THEN [{_ring_sql("1.5::DOUBLE")}, {_ring_sql("0.5::DOUBLE")}] ELSE [{_ring_sql("1.0::DOUBLE")}] END AS rings FROM middles)"""
_EDGES_SQL = """rings AS (SELECT id, unnest(rings) AS r FROM {polygons}),
edges AS (SELECT id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM (SELECT id, unnest(r) AS p, unnest(list_concat(r[2:], r[:1])) AS q FROM rings))"""
_ON_SQL = "(x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2)"
_CROSS_SQL = "(y1 > py) <> (y2 > py) AND px < x1 + (py - y1) * ((x2 - x1) / (y2 - y1))"


def places(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", (F.col("embedding")[1].cast("double") * 10).alias("x"), (F.col("embedding")[0].cast("double") * 10).alias("y"))


def regions(spark, d):
    m = places(spark, d).groupBy("label").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
    ring = lambda r: hexagon(F.col("x"), F.col("y"), F.lit(r))
    return m.select(F.col("label").alias("id"), F.when(F.col("label") % 2 == 0, F.array(ring(1.5), ring(0.5))).otherwise(F.array(ring(1.0))).alias("rings"))


@query(f"""WITH {_REGIONS_SQL}, {_EDGES_SQL.format(polygons="regions")},
asked AS (SELECT vec_id AS point, x AS px, y AS py FROM places UNION ALL SELECT -1 - id, x1, y1 FROM edges),
tested AS (SELECT point, id, count(*) FILTER ({_CROSS_SQL}) % 2 = 1 AS inside, bool_or({_ON_SQL}) AS border FROM asked, edges GROUP BY point, px, py, id)
SELECT id, count(*) FILTER (inside AND NOT border) AS within, count(*) FILTER (inside OR border) AS touching, coalesce(sum(point) FILTER (inside AND NOT border), 0)::BIGINT AS points FROM tested GROUP BY id HAVING count(*) FILTER (inside OR border) > 0""")
def jn16_point_in_polygon(spark, d):
    """Points within regions with holes, and with those on a border; the corners themselves are asked for as well."""
    r = regions(spark, d)
    asked = places(spark, d).select(F.col("vec_id").alias("point"), "x", "y").unionByName(P.edges(r).select((-1 - F.col("id")).cast("bigint").alias("point"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    both = P.points_within(asked, r, 0.5).withColumn("inside", F.lit(True)).unionByName(P.points_within(asked, r, 0.5, True).withColumn("inside", F.lit(False)))
    return both.groupBy("id").agg(F.count_if("inside").alias("within"), F.count_if(~F.col("inside")).alias("touching"), F.sum(F.when(F.col("inside"), F.col("point")).otherwise(0)).alias("points"))


_BLOCKS_SQL = f"""places AS (SELECT vec_id, embedding[2]::DOUBLE * 10 AS x, embedding[1]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings),
blocks AS (SELECT vec_id AS id, z, [{_ring_sql("0.01::DOUBLE + 0.01::DOUBLE * (vec_id % 8)")}] AS rings FROM places)"""


@query(f"""WITH {_BLOCKS_SQL}, {_EDGES_SQL.format(polygons="blocks")},
boxes AS (SELECT id, min(x1) AS x1, max(x1) AS x2, min(y1) AS y1, max(y1) AS y2 FROM edges GROUP BY id),
core AS (SELECT id FROM blocks WHERE z >= 1.5),
pairs AS (SELECT a.id, b.id AS other FROM boxes a JOIN boxes b ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 WHERE a.id NOT IN (FROM core) AND b.id IN (FROM core)),
turns AS (SELECT p.id, p.other, a.x1 AS ax, a.y1 AS ay, a.x2 AS bx, a.y2 AS by_, b.x1 AS cx, b.y1 AS cy, b.x2 AS dx, b.y2 AS dy,
  (b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1) AS t1, (b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) AS t2,
  (a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) AS t3, (a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) AS t4 FROM pairs p JOIN edges a ON a.id = p.id JOIN edges b ON b.id = p.other),
met AS (SELECT id FROM turns WHERE sign(t1) * sign(t2) < 0 AND sign(t3) * sign(t4) < 0
  OR t1 = 0 AND ax BETWEEN least(cx, dx) AND greatest(cx, dx) AND ay BETWEEN least(cy, dy) AND greatest(cy, dy) OR t2 = 0 AND bx BETWEEN least(cx, dx) AND greatest(cx, dx) AND by_ BETWEEN least(cy, dy) AND greatest(cy, dy)
  OR t3 = 0 AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, by_) AND greatest(ay, by_) OR t4 = 0 AND dx BETWEEN least(ax, bx) AND greatest(ax, bx) AND dy BETWEEN least(ay, by_) AND greatest(ay, by_)),
corners AS (SELECT id, rings[1][1].x AS px, rings[1][1].y AS py FROM blocks),
inner_ AS (SELECT p.id FROM pairs p JOIN corners c ON c.id = p.id JOIN edges e ON e.id = p.other GROUP BY p.id, p.other HAVING count(*) FILTER ({_CROSS_SQL}) % 2 = 1 OR bool_or({_ON_SQL})),
outer_ AS (SELECT p.id FROM pairs p JOIN corners c ON c.id = p.other JOIN edges e ON e.id = p.id GROUP BY p.id, p.other HAVING count(*) FILTER ({_CROSS_SQL}) % 2 = 1 OR bool_or({_ON_SQL}))
SELECT id, 'high_density' AS reason FROM core UNION ALL SELECT id, 'adjacent' FROM (FROM met UNION FROM inner_ UNION FROM outer_)""")
def jn15_adjacent_polygons(spark, d):
    """Dense blocks, and those that meet one of them: by crossing edges, a shared border or one lying within the other."""
    z = F.col("embedding")[2].cast("double") * 10
    p = table(spark, d, "embeddings").select("vec_id", (F.col("embedding")[1].cast("double") * 10).alias("x"), (F.col("embedding")[0].cast("double") * 10).alias("y"), z.alias("z"))
    blocks = p.select(F.col("vec_id").alias("id"), "z", F.array(hexagon(F.col("x"), F.col("y"), F.lit(0.01) + F.lit(0.01) * (F.col("vec_id") % 8))).alias("rings"))
    core = blocks.where("z >= 1.5").select("id", "rings")
    out = core.select("id", F.lit("high_density").alias("reason"))
    return out.unionByName(P.adjacent(blocks.select("id", "rings"), core, 0.05).withColumn("reason", F.lit("adjacent")))
