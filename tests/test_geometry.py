"""Hand-made plans: every boundary, and a line of sight."""

import random

import pytest
from pyspark.sql import functions as F

from planwalk.functions import geometry as g
from planwalk.operators import spatial


def shapes(spark, walls=(), regions=()):
    w = spark.createDataFrame([(0, k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in enumerate(walls)], "layout long, wall long, points array<struct<x:double,y:double>>")
    r = spark.createDataFrame([(0, k, *(float(v) if isinstance(v, int) else v for v in x)) for k, x in enumerate(regions)], "layout long, id long, kind string, x double, y double, w double, h double, cfg string")
    return spatial.layout_shapes(w, r)


def route(spark, *xy):
    return spark.createDataFrame([(0, 1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "layout long, route long, i long, x double, y double")


def circles(spark, *c):
    return spark.createDataFrame([(0, k, *map(float, x)) for k, x in enumerate(c)], "layout long, ex_id long, cx double, cy double, r double")


SQUARE = [(40, 0), (60, 0), (60, 100), (40, 100)]


def test_only_the_circle_in_front_of_the_wall_is_seen(spark):
    seen = spatial.sightings(route(spark, (30, 50)), circles(spark, (20, 50, 4), (70, 50, 20)), shapes(spark, [SQUARE]))
    assert {r.ex_id: r.kind for r in seen.collect()} == {0: "visit", 1: "blocked"}


def test_radius_and_reach_are_open(spark):
    points = route(spark, (10, 0), (9, 0), (35, 0), (34.9, 0))
    seen = spatial.sightings(points, circles(spark, (0, 0, 10)), shapes(spark))
    assert {r.i: r.kind for r in seen.collect()} == {0: "visit", 1: "collision", 3: "visit"}


def test_a_collision_is_no_visit(spark):
    seen = spatial.sightings(route(spark, (1, 0)), circles(spark, (0, 0, 10)), shapes(spark))
    (r,) = spatial.exhibit_visits(seen).collect()
    assert (r.visited, r.closest) == (False, None)


def test_rectangle_sides_and_polygon_edges_count(spark):
    points = route(spark, (0, 0), (10, 10), (10.5, 5), (38, 50), (37, 50), (62, 50), (50, 50))
    flags = {r.i: r for r in spatial.point_flags(points, shapes(spark, [SQUARE], [("floor", 0, 0, 10, 10, None)])).collect()}
    assert [flags[k].outside for k in range(3)] == [False, False, True]
    assert [flags[k].wall for k in range(3, 7)] == [0, None, 0, 0]


@pytest.mark.parametrize("a,b,crosses", [((0, 5), (10, 5), True), ((0, 0), (10, 0), False), ((0, 1), (10, 1), False), ((5, -5), (5, 0), True), ((5, -5), (5, -1), False)])
def test_parallel_segments_never_cross(spark, a, b, crosses):
    lit = lambda p: [F.lit(float(x)) for x in p]
    edges = [((0, 0), (10, 0)), ((5, 0), (5, 10))] if crosses and a != (5, -5) else [((0, 0), (10, 0))]
    tests = [spark.range(1).select(g.segments_cross(*lit(a), *lit(b), *lit(c), *lit(d)).alias("x")).first().x for c, d in edges]
    assert any(tests) == crosses


def test_restricted_gallery_and_missing_must_see(spark):
    regions = spark.createDataFrame([(0, 0, "gallery", 0.0, 0.0, 5.0, 5.0, "restricted"), (0, 1, "gallery", 90.0, 90.0, 5.0, 5.0, "must_see"), (0, 2, "floor", 0.0, 0.0, 99.0, 99.0, None)], "layout long, id long, kind string, x double, y double, w double, h double, cfg string")
    held = spatial.layout_shapes(spark.createDataFrame([], "layout long, wall long, points array<struct<x:double,y:double>>"), regions)
    points = route(spark, (1, 1), (50, 50))
    flags = spatial.point_flags(points, held)
    missing = spatial.must_see_missing(flags, regions)
    seen = spatial.sightings(points, circles(spark, (50, 50, 3)), held)
    (r,) = spatial.violations(flags, seen, missing).collect()
    assert (r.n_gallery, r.n_must_see, r.n_collision, r.total, r.reasons, r.is_valid) == (1, 1, 1, 3, "collision,gallery,must_see", False)


@pytest.mark.parametrize("cell", [7, 38, 500])
def test_grid_join_is_the_nested_loop(spark, cell):
    rng = random.Random(cell)
    pts = [(rng.randrange(-50, 200), rng.randrange(-50, 200)) for _ in range(150)]
    rings = [(rng.randrange(200), rng.randrange(200), rng.randrange(1, 30)) for _ in range(40)]
    got = {(r.i, r.ex_id) for r in spatial.near_circles(route(spark, *pts), circles(spark, *rings), 11, cell).collect()}
    assert got == {(i, k) for i, (x, y) in enumerate(pts) for k, (cx, cy, rad) in enumerate(rings) if ((x - cx) ** 2 + (y - cy) ** 2) ** 0.5 < rad + 11}


def test_moving_everything_changes_nothing_and_fidelity_has_no_direction(spark):
    pts = [(0, 0), (10, 0), (10, 10), (3, 8)]
    line = route(spark, (0, 0), (12, 0), (12, 12))
    base = spatial.fidelity(route(spark, *pts), spatial.segments(line), 2.0).first()
    turned = spatial.fidelity(route(spark, *pts), spatial.segments(route(spark, (12, 12), (12, 0), (0, 0))), 2.0).first()
    moved = spatial.fidelity(route(spark, *[(x + 7, y - 3) for x, y in pts]), spatial.segments(route(spark, (7, -3), (19, -3), (19, 9))), 2.0).first()
    assert base == turned == moved
    assert (base.similarity, base.n_within, base.max_deviation) == (75.0, 3, 8.0)


def test_lengths_ends_and_bounds(spark):
    points = route(spark, (0, 0), (3, 4), (3, 10))
    assert spatial.polyline_length(points).first().length == 11
    gate = spark.createDataFrame([(0, 5, 0.0, 0.0, 0.0, 0.0)], "layout long, id long, x double, y double, w double, h double")
    r = spatial.start_end(points, gate, circles(spark, (3, 12, 2))).first()
    assert (r.start_inside, r.end_inside) == (True, True)
    r = spatial.start_end(points, gate.limit(0), circles(spark, (3, 13, 2))).first()
    assert (r.start_inside, r.end_inside) == (False, False)


def test_reach_is_cut_off(spark):
    row = spark.range(1).select(spatial.reach_pixels(F.lit(1500.0), F.lit(20.5)).alias("a"), spatial.reach_pixels(F.lit(1500.0), F.lit(0.0)).alias("b")).first()
    assert tuple(row) == (73, 25)


def test_equal_circles_meet_points_once_and_are_told_apart_after(spark):
    # exhibits 0 to 8 are alike; 9 lies elsewhere; 10 is listed twice, in two places
    rings = [(0, k, 5.0, 5.0, 2.0) for k in range(9)] + [(0, 9, 40.0, 5.0, 2.0), (0, 10, 5.0, 5.0, 2.0), (0, 10, 8.0, 5.0, 2.0)]
    held = spark.createDataFrame(rings, "layout long, ex_id long, cx double, cy double, r double")
    once = spatial.alike(held)
    assert sorted((r.cx, r.own, r.n) for r in once.collect() if r.own is None) == [(5.0, None, 9), (40.0, None, 1)]
    points = route(spark, (6, 5), (5, 9), (8, 5))
    pairs = spatial.near_circles(points, once, 0)
    assert pairs.count() == 3
    per = pairs.groupBy("layout", "route", spatial.by_circle(), "own").agg(F.count(F.lit(1)).alias("n_points"))
    got = {(r.ex_id, r.n_points) for r in spatial.each_exhibit(per, held).collect()}
    plain = spatial.near_circles(points, held, 0).groupBy("ex_id").agg(F.count(F.lit(1)).alias("n_points"))
    assert got == {(r.ex_id, r.n_points) for r in plain.collect()} == {(k, 1) for k in range(9)} | {(10, 2)}
    flags = spatial.point_flags(points, shapes(spark))
    none = spark.createDataFrame([], "layout long, id long, kind string, x double, y double, w double, h double, cfg string")
    assert [spatial.route_violations(flags, c, none).first().n_collision for c in (pairs, spatial.near_circles(points, held, 0))] == [11, 11]
