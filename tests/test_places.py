"""The quadtree cover against plain ray casting, and its size."""

from __future__ import annotations

import math
import random

from recordspine.operators import places

RINGS = "boundary_id string, rings array<array<struct<x:double,y:double>>>"


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y):
                (lx, ly), (hx, hy) = sorted([(ax, ay), (bx, by)], key=lambda p: p[1])
                n += (hx - lx) * (y - ly) - (x - lx) * (hy - ly) > 0
    return n % 2 == 1


def as_rows(shapes):
    return [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in shapes.items()]


def star(rnd, cx, cy, r, n):
    return [(cx + r * (0.4 + 0.6 * rnd.random()) * math.cos(2 * math.pi * i / n), cy + r * (0.4 + 0.6 * rnd.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def test_cover_against_ray_casting(spark):
    rnd = random.Random(5)
    lattice = [(rnd.randrange(-6, 7), rnd.randrange(-6, 7)) for _ in range(40)]  # crosses itself, corners on cell sides
    shapes = {f"star{i}": [star(rnd, rnd.uniform(-8, 8), rnd.uniform(-8, 8), rnd.uniform(0.5, 9), 60)] for i in range(6)}
    shapes |= {"holes": [[(-8, -8), (8, -8), (8, 8), (-8, 8)], [(-4, -4), (-4, 4), (4, 4), (4, -4)], [(-1, -1), (1, -1), (1, 1), (-1, 1)]], "lattice": [lattice], "fan": [[p for i in range(20) for p in ((0, 0), (5, i / 8), (5, i / 8 + 1 / 16))]]}
    points = [(i, rnd.uniform(-10, 10), rnd.uniform(-10, 10)) for i in range(700)] + [(1000 + 25 * i + j, float(i - 12) / 2, float(j - 12) / 2) for i in range(25) for j in range(25)]
    want = sorted((i, k) for i, x, y in points for k, rings in shapes.items() if inside(rings, x, y))
    p, b = spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(as_rows(shapes), RINGS)
    for most in (6, 16):
        assert sorted(map(tuple, places.locate(p, b, most).collect())) == want
    assert len(want) > 1500


def test_rows_grow_with_edges_not_with_area(spark):
    square = lambda w: [[(0, 0), (w, 0), (w, w), (0, w)]]
    ring = [[(1000 * math.cos(2 * math.pi * i / 2000), 1000 * math.sin(2 * math.pi * i / 2000)) for i in range(2000)]]
    cells, _ = places.cover(spark.createDataFrame(as_rows({"round": ring, "small": square(1), "large": square(900)}), RINGS))
    got = {r.boundary_id: (r.n, r.e) for r in cells.groupBy("boundary_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").join(cells.selectExpr("boundary_id", "size(edges) AS e").groupBy("boundary_id").max("e").withColumnRenamed("max(e)", "e"), "boundary_id").collect()}
    assert got["small"] == got["large"] == (1, 4)
    assert got["round"][0] < 2000 and got["round"][1] <= 16
    assert cells.where("boundary_id = 'round' AND size(edges) = 0").count() > 10  # inner cells


def test_odd_input(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (3, float("nan"), 0.5), (4, float("inf"), 0.5), (5, 9.0, 0.5), (1, 0.5, 0.5)], "point_id int, x double, y double")
    shapes = as_rows({"unit": [[(0, 0), (1, 0), (1, 1), (0, 1)]], "line": [[(0, 0), (1, 1)]], "none": [], "bad": [[(0, 0), (1, 0), (float("nan"), 1), (1, 1), (0, 1)]]})
    b = spark.createDataFrame(shapes + [("null", None), ("nulls", [None])], RINGS)
    assert sorted(map(tuple, places.locate(p, b).collect())) == [(1, "bad"), (1, "bad"), (1, "unit"), (1, "unit")]
    assert places.locate(p, b.limit(0)).collect() == [] and places.locate(p.limit(0), b).collect() == []


def test_places_meet_cells_by_compiled_tests(spark):
    ring = [[(math.cos(2 * math.pi * i / 60), math.sin(2 * math.pi * i / 60)) for i in range(60)]]
    p, b = spark.createDataFrame([(1, 0.5, 0.5)], "point_id int, x double, y double"), spark.createDataFrame(as_rows({"round": ring, "unit": [[(0, 0), (1, 0), (1, 1), (0, 1)]]}), RINGS)
    plan = places.locate(p, b)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "lambda" not in plan and "Broadcast" not in plan, plan
