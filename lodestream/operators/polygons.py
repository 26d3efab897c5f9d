"""Joins of points and polygons, and of polygons with polygons, through a cover of grid cells.

A polygon is a row (id, rings): rings are arrays of (x, y), the first is the outer one, further ones are holes or other
parts; a place is inside by the even-odd rule. A cover has the cells that an edge passes through (border) and those that
lie inside as a whole. Points in the latter need no test; those in a border cell are tested against the polygon's edges
in the cell's row alone. Polygons meet through the cells of their edges, so pairs that are far apart are never made.

``size`` is the cells' width, which should be near the length of a typical edge: a polygon has about its area over
size squared cells. Covers are written, so that Spark splits a cell or polygon that very many points lie in. Points with a
null or NaN coordinate, and polygons without rings, join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.sources.shared import written

#: Cells are taken so much wider, in cells, than an edge reaches: more border cells change no result.
SLACK = 1e-9


def edges(polygons: DataFrame) -> DataFrame:
    """(id, x1, y1, x2, y2) for each edge of each ring; the last corner is joined to the first."""
    rings = polygons.select("id", F.explode("rings").alias("r")).where(F.size("r") > 0)
    n = F.size("r")
    pairs = F.transform("r", lambda p, i: F.struct(p.x.alias("x1"), p.y.alias("y1"), F.get("r", (i + 1) % n).x.alias("x2"), F.get("r", (i + 1) % n).y.alias("y2")))
    return rings.select("id", F.inline(pairs)).where("x1 <> x2 OR y1 <> y2")


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size - SLACK), F.floor(high / size + SLACK)))


def _at(y: Column) -> Column:
    """The x of an edge at a height within its reach."""
    return F.col("x1") + (y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))


def edge_rows(polygons: DataFrame, size: float) -> DataFrame:
    """The edges, each in every ``row`` of cells that it reaches."""
    return edges(polygons).withColumn("row", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size))


def edge_cells(rows: DataFrame, size: float) -> DataFrame:
    """Edges in rows, each in every cell (row, col) that it passes through."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    within = lambda y: F.least(F.greatest(y, low), high)
    level = F.col("y1") == F.col("y2")
    a, b = (F.when(level, F.col(x)).otherwise(_at(within((F.col("row") + k) * size))) for x, k in (("x1", 0), ("x2", 1)))
    return rows.withColumn("col", _cells(F.least(a, b), F.greatest(a, b), size))


def cover(rows: DataFrame, size: float) -> DataFrame:
    """(id, row, col, border) of the polygons with these edges."""
    border = edge_cells(rows, size).select("id", "row", "col").distinct()
    middle = (F.col("row") + 0.5) * size
    crossed = rows.where((F.col("y1") > middle) != (F.col("y2") > middle)).groupBy("id", "row").agg(F.sort_array(F.collect_list(_at(middle))).alias("xs"))
    stretch = F.explode(F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.get("xs", i).alias("a"), F.get("xs", i + 1).alias("b"))))
    stretches = crossed.select("id", "row", stretch.alias("s")).select("id", "row", F.ceil(F.col("s.a") / size - 0.5).alias("a"), F.floor(F.col("s.b") / size - 0.5).alias("b"))
    inside = stretches.where("a <= b").select("id", "row", F.explode(F.sequence("a", "b")).alias("col"))
    inside = inside.join(border, ["id", "row", "col"], "left_anti")
    return border.withColumn("border", F.lit(True)).unionByName(inside.withColumn("border", F.lit(False)))


def _on(x: Column, y: Column, e: Column) -> Column:
    """Whether a point lies on an edge."""
    turn = (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)
    return (turn == 0) & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))


def within(x: Column, y: Column, edges: Column, boundary: bool) -> Column:
    """Whether a point is inside by the edges at its height: those that a ray to its right crosses are odd in number."""
    crosses = lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < e.x1 + (y - e.y1) * ((e.x2 - e.x1) / (e.y2 - e.y1)))
    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    on = F.exists(edges, lambda e: _on(x, y, e))
    return on | inside if boundary else inside & ~on


def points_within(points: DataFrame, polygons: DataFrame, size: float, boundary: bool = False) -> DataFrame:
    """(point, id) of points (point, x, y) and the polygons that they lie in; with ``boundary`` also on."""
    rows = written(edge_rows(polygons, size))
    cells = written(cover(rows, size))
    near = rows.groupBy("id", "row").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    found = points.where(~F.isnan("x") & ~F.isnan("y")).withColumns({"row": F.floor(F.col("y") / size), "col": F.floor(F.col("x") / size)}).join(cells, ["row", "col"])
    asked = found.where("border").join(written(near), ["id", "row"]).where(within(F.col("x"), F.col("y"), F.col("edges"), boundary))
    return found.where("NOT border").select("point", "id").unionByName(asked.select("point", "id"))


def _meet(a: str, b: str) -> Column:
    """Whether the edges with these suffixes have a point in common."""
    c = lambda k, n: F.col(f"{k}_{n}")
    turn = lambda n, x, y: (c("x2", n) - c("x1", n)) * (y - c("y1", n)) - (c("y2", n) - c("y1", n)) * (x - c("x1", n))
    ends = lambda n: [(c("x1", n), c("y1", n)), (c("x2", n), c("y2", n))]
    on_b, on_a = [turn(b, *p) for p in ends(a)], [turn(a, *p) for p in ends(b)]
    cross = (F.signum(on_b[0]) * F.signum(on_b[1]) < 0) & (F.signum(on_a[0]) * F.signum(on_a[1]) < 0)
    reach = lambda n, x, y: x.between(F.least(c("x1", n), c("x2", n)), F.greatest(c("x1", n), c("x2", n))) & y.between(F.least(c("y1", n), c("y2", n)), F.greatest(c("y1", n), c("y2", n)))
    for n, turns, points in ((b, on_b, ends(a)), (a, on_a, ends(b))):
        for t, p in zip(turns, points):
            cross = cross | ((t == 0) & reach(n, *p))
    return cross


def intersecting(polygons: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """(id, other): pairs of polygons and others of another id that have a point in common, borders included.

    Either two edges meet, in a cell of both, or a ring of one lies within the other, and so does its first corner.
    """
    side = lambda p, n: edge_cells(edge_rows(p, size), size).select("row", "col", F.col("id").alias(f"id_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in ("x1", "y1", "x2", "y2")])
    met = written(side(polygons, "a")).join(written(side(others, "b")), ["row", "col"]).where(F.col("id_a") != F.col("id_b")).where(_meet("a", "b"))
    met = met.select(F.col("id_a").alias("id"), F.col("id_b").alias("other"))
    corner = lambda p: p.select(F.col("id").alias("point"), F.explode("rings").alias("r")).where(F.size("r") > 0).select("point", F.get("r", F.lit(0)).x.alias("x"), F.get("r", F.lit(0)).y.alias("y"))
    inner = points_within(corner(polygons), others, size, True).select(F.col("point").alias("id"), F.col("id").alias("other"))
    outer = points_within(corner(others), polygons, size, True).select("id", F.col("point").alias("other"))
    return met.unionByName(inner).unionByName(outer).where("id <> other").distinct()


def adjacent(polygons: DataFrame, core: DataFrame, size: float) -> DataFrame:
    """(id) of the polygons outside core that meet one of it; core is a part of them."""
    found = intersecting(polygons.join(core.select("id"), "id", "left_anti"), core, size)
    return found.select("id").distinct()
