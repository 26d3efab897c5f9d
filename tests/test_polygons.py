"""Polygons against plain geometry in whole numbers, so that borders and touching corners are exact."""

import math
import random

from lodestream.operators import polygons as P

SCHEMA = "id int, rings array<array<struct<x: double, y: double>>>"


def star(draw, x, y, corners, reach):
    """A simple ring about a point: corners at growing angles."""
    turns = sorted(draw.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + round(draw.randint(1, reach) * math.cos(t)), y + round(draw.randint(1, reach) * math.sin(t))) for t in turns]


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]


def drawn(seed, n, span):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        x, y = draw.randint(-span, span), draw.randint(-span, span)
        kind = draw.random()
        if kind < 0.4:
            w = draw.randint(2, 8)
            rings = [square(x, y, w), square(x + 1, y + 1, w - 2)] if w > 4 else [square(x, y, w)]
        else:
            rings = [star(draw, x, y, draw.randint(3, 7), 6)]
        out.append((k, rings))
    return out + [(n, []), (n + 1, None), (n + 2, [[]]), (n + 3, [square(-2 * span, -2 * span, 4 * span)])]


def lines(rings):
    return [(*p, *q) for r in rings or [] for p, q in zip(r, r[1:] + r[:1]) if p != q]


def turn(e, x, y):
    return (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])


def on(e, x, y):
    return turn(e, x, y) == 0 and min(e[0], e[2]) <= x <= max(e[0], e[2]) and min(e[1], e[3]) <= y <= max(e[1], e[3])


def inside(edges, x, y, boundary):
    if any(on(e, x, y) for e in edges):
        return boundary
    # A crossing to the right of the point, in whole numbers.
    return sum((e[1] > y) != (e[3] > y) and (turn(e, x, y) > 0) == (e[3] > e[1]) for e in edges) % 2 == 1


def meet(a, b):
    s = [turn(b, *a[:2]), turn(b, *a[2:]), turn(a, *b[:2]), turn(a, *b[2:])]
    return s[0] * s[1] < 0 and s[2] * s[3] < 0 or on(b, *a[:2]) or on(b, *a[2:]) or on(a, *b[:2]) or on(a, *b[2:])


def table(spark, shapes):
    return spark.createDataFrame([(k, rings and [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in shapes], SCHEMA)


def test_points_within(spark):
    shapes, draw = drawn(1, 120, 25), random.Random(2)
    points = [(k, float(draw.randint(-30, 30)), float(draw.randint(-30, 30))) for k in range(700)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    df, asked = table(spark, shapes), spark.createDataFrame(points, "point int, x double, y double")
    edges = {k: lines(r) for k, r in shapes}
    for boundary in (False, True):
        wanted = {(p, k) for p, x, y in points[:700] for k, e in edges.items() if inside(e, x, y, boundary)}
        for size in (0.7, 4.0, 50.0):
            got = [tuple(r) for r in P.points_within(asked, df, size, boundary).collect()]
            assert len(got) == len(set(got)) and set(got) == wanted, (boundary, size)


def test_only_border_cells_are_tested(spark):
    rows = P.edge_rows(table(spark, [(1, [square(0, 0, 100)])]), 1.0)
    kinds = {r["border"]: r["count"] for r in P.cover(rows, 1.0).groupBy("border").count().collect()}
    assert kinds[False] > 9_500 and kinds[True] < 900


def test_300_polygons_that_meet(spark):
    shapes = drawn(5, 300, 70)
    shapes.append((400, [square(-9, -9, 1), square(40, 40, 1)]))  # two parts
    edges, parts = {k: lines(r) for k, r in shapes}, dict(shapes)
    wanted = {(a, b) for a, e in edges.items() for b, f in edges.items() if a != b and e and f and (any(meet(x, y) for x in e for y in f) or any(inside(f, *r[0], True) for r in parts[a] if r) or any(inside(e, *r[0], True) for r in parts[b] if r))}
    df = table(spark, shapes)
    got = [tuple(r) for r in P.intersecting(df, df, 3.0).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 500
    core = df.where("id % 7 = 0")
    assert {r["id"] for r in P.adjacent(df, core, 3.0).collect()} == {a for a, b in wanted if a % 7 and b % 7 == 0}
