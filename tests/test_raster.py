"""Pixel kernels against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwalk.operators import extraction, lines, raster, spatial
from planwalk.plans import shared
from planwalk.sources import bindings


def pixels(spark, *routes):
    return spark.createDataFrame([(k, x, y) for k, route in enumerate(routes) for x, y in route], "route long, x long, y long")


def blobs(seed):
    rng = random.Random(seed)
    return sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(60)})


def plain_components(points):
    left, out = set(points), {}
    while left:
        stack = [min(left)]
        first = stack[0]
        while stack:
            x, y = stack.pop()
            if (x, y) in left:
                left.remove((x, y))
                out[x, y] = first
                stack += [(x + dx, y + dy) for dx, dy in raster.AROUND]
    return out


def test_components_endpoints_length(spark):
    routes = [blobs(1), blobs(2), [(k, 0) for k in range(40)], [(5, 5)]]
    df = pixels(spark, *routes)
    labelled = raster.components(df)
    got = {(r.route, r.x, r.y): (r.cx, r.cy) for r in labelled.collect()}
    assert got == {(k, *p): c for k, route in enumerate(routes) for p, c in plain_components(route).items()}
    ends = {(r.route, r.x, r.y) for r in raster.endpoints(df).collect()}
    assert ends == {(k, x, y) for k, route in enumerate(routes) for x, y in route if sum((x + dx, y + dy) in set(route) for dx, dy in raster.AROUND) == 1}
    length = {r.route: r.length for r in raster.path_length(df, labelled).collect()}
    assert length[2] == 39.0 and length[3] == 0.0


@pytest.mark.parametrize("tile,rows", [(3, 40), (32, 40), (32, 10**5)])
def test_components_are_the_same_however_pixels_are_tiled(spark, monkeypatch, tile, rows):
    monkeypatch.setattr(raster, "TILE", tile)
    monkeypatch.setattr(shared, "ROWS", rows)
    routes = [[(x * 3 - 20, y - 7) for x, y in blobs(4)], [(x - 7, y - 7) for x, y in blobs(3)], [(k, k % 2) for k in range(-40, 40)]]
    labelled = raster.components(pixels(spark, *routes))
    assert {(r.route, r.x, r.y): (r.cx, r.cy) for r in labelled.collect()} == {(k, *p): c for k, route in enumerate(routes) for p, c in plain_components(route).items()}


def test_components_of_routes_with_several_fields(spark):
    df = pixels(spark, blobs(5), blobs(6)).selectExpr("named_struct('a', route, 'b', nullif(route, 0)) AS route", "x", "y")
    got = {(r.route.a, r.x, r.y): (r.cx, r.cy) for r in raster.components(df).collect()}
    assert got == {(k, *p): c for k in (0, 1) for p, c in plain_components(blobs(5 + k)).items()}


def test_length_moves_each_pixel_once(spark):
    df = pixels(spark, *[blobs(k) for k in range(8)])
    labelled = raster.components(df)
    plan = raster.path_length(df, labelled)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Repartition") == 1


def test_no_task_makes_more_pixels_distinct_than_it_can_hold(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "ROWS", 500)
    spark.range(20_000).selectExpr("id AS event_id", "id % 300 AS user_id", "CAST(id * 7 % 24 AS DOUBLE) AS value").write.parquet(str(tmp_path / "events.parquet"))
    df = bindings.pixels(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 40
    assert df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).sum() == 600


def test_noise_is_below_a_hundredth(spark):
    big = [(x, y) for x in range(20) for y in range(15)]
    df = pixels(spark, big + [(50, 0), (50, 1), (50, 2)] + [(60, 0), (60, 1)])
    parts = {r.size: r.is_noise for r in raster.fragments(raster.components(df)).collect()}
    assert parts == {300: False, 3: False, 2: True}
    assert raster.connectivity(raster.fragments(raster.components(df))).first().n_fragments == 2


def plain_thin(mask):
    """Zhang and Suen's thinning by plain loops over a set of pixels."""
    mask = set(mask)
    while True:
        before = len(mask)
        for step in (0, 1):
            gone = set()
            for x, y in mask:
                n = [(x + dx, y + dy) in mask for dx, dy in lines.RING]
                turns = sum(not a and b for a, b in zip(n, n[1:] + n[:1]))
                ups = ((n[0] and n[2] and n[4]), (n[2] and n[4] and n[6])) if step == 0 else ((n[0] and n[2] and n[6]), (n[0] and n[4] and n[6]))
                if 2 <= sum(n) <= 6 and turns == 1 and not any(ups):
                    gone.add((x, y))
            mask -= gone
        if len(mask) == before:
            return mask


def test_thinning_and_pruning(spark):
    rng = random.Random(5)
    masks = [{(x, y) for x in range(3, 27) for y in range(3, 6)}, {(x, y) for x in range(20) for y in range(20) if rng.random() < 0.7}, {(x, y) for x in range(-9, 9) for y in range(-9, 9) if 20 < x * x + y * y < 70}]
    df = spark.createDataFrame([(k, x, y) for k, m in enumerate(masks) for x, y in m], "route long, x long, y long")
    got = {k: set() for k in range(3)}
    for r in lines.thin(df.union(df.limit(9))).collect():
        got[r.route].add((r.x, r.y))
    assert [got[k] for k in range(3)] == [plain_thin(m) for m in masks]
    straight = spark.createDataFrame([(0, x, 5) for x in range(12)], "route long, x long, y long")
    assert lines.prune(straight, 3).count() == 6 and lines.prune(straight, 20).count() == 0
    assert lines.skeletons(df.limit(0), 2).count() == 0


def plain_smooth(image, parts):
    half = len(parts) // 2
    out = np.zeros(image.shape, np.int64)
    at = lambda k, n: abs(k) if k < n else 2 * (n - 1) - k
    rows, cols = image.shape[:2]
    for y in range(rows):
        for x in range(cols):
            total = sum(a * b * image[at(y + i - half, rows), at(x + j - half, cols)] for i, a in enumerate(parts) for j, b in enumerate(parts))
            out[y, x] = (total + 32768) >> 16
    return out


@pytest.mark.parametrize("width", [1, 3, 5, 7, 9])
def test_smoothing_mirrors_borders(spark, width):
    rng = np.random.default_rng(width)
    image = np.where(rng.random((9, 11, 3)) < 0.4, rng.integers(0, 256, (9, 11, 3)), 255)
    rows = [(0, x, y, *map(int, image[y, x])) for y in range(9) for x in range(11) if (image[y, x] < 255).any()]
    df = spark.createDataFrame(rows, "route long, x long, y long, r int, g int, b int")
    sizes = spark.createDataFrame([(0, 11, 9)], "route long, w int, h int")
    got = np.full(image.shape, 255)
    for r in extraction.smoothed(df, sizes, width).collect():
        got[r.y, r.x] = r.r, r.g, r.b
    assert sum(extraction.weights(width)) == 256
    assert (got == plain_smooth(image.astype(np.int64), extraction.weights(width))).all()


def test_outlines_of_boxes_rings_and_lines(spark):
    shapes = {
        1: ({(x, y) for x in range(10) for y in range(10)}, 81.0),
        2: ({(x, y) for x in range(12) for y in range(12) if not (3 <= x < 9 and 3 <= y < 9)}, 121.0),
        3: ({(x, 4) for x in range(9)}, 0.0),
        4: ({(x, y) for x in range(7) for y in range(7) if abs(x - 3) + abs(y - 3) <= 3}, 18.0),
        5: ({(x, y) for x in range(7) for y in range(7) if abs(x - 3) + abs(y - 3) == 3}, 18.0),
        6: ({(x, x) for x in range(5)}, 0.0),
    }
    df = spark.createDataFrame([(k, x, y) for k, (s, _) in shapes.items() for x, y in s], "route long, x long, y long")
    parts = raster.components(df)
    assert {r.route: r.area for r in raster.outlines(parts).collect()} == {k: a for k, (_, a) in shapes.items()}
    assert {r.route for r in raster.outlines(parts, 100).collect()} == {2}
    hued = df.selectExpr("route", "x", "y", "60 AS h", "200 AS s", "200 AS v")
    assert [r.route for r in raster.color_boxes(hued, "entrance").collect()] == [2]


def test_walks(spark):
    points = [(0, 0), (1, 0), (2, 1), (3, 1), (9, 9)]
    dist = raster.geodesic(set(points), (0, 0))
    assert dist[3, 1] == 2 + 2**0.5 and (9, 9) not in dist
    df = pixels(spark, points)
    far = raster.farthest(df, spark.createDataFrame([(0, 0, 0)], "route long, sx long, sy long")).first()
    assert (far.x, far.y, far.length) == (3, 1, 3.41)
    assert lines.skeletons(df.union(df)).count() <= 5


def test_matching_is_greedy_and_one_to_one(spark):
    found = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 3.0, 0.0), (0, 3, 50.0, 0.0)], "img long, found_id long, x double, y double")
    drawn = spark.createDataFrame([(0, 7, 2.0, 0.0), (0, 8, 4.5, 0.0)], "img long, ann_id long, x double, y double")
    got = {r.found_id: r.ann_id for r in raster.match_circles(found, drawn, 5.0).collect()}
    assert got == {2: 7, 1: 8}


def test_colours(spark):
    rgb = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (10, 10, 10), (0, 0, 0)], "r int, g int, b int")
    got = [tuple(x.c) for x in rgb.select(raster.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect()]
    assert got == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 10), (0, 0, 0)]


def test_rasterised_routes_draw_every_stroke(spark, monkeypatch):
    """Strokes after the third are drawn as well, as by brute force over all strokes."""
    from planwalk.plans import spatial_queries

    path = [(10, 10), (14, 10), (14, 17), (9, 19), (30, 25), (30, 40), (12, 41)]
    points = spark.createDataFrame([("l", 1, i, x, y) for i, (x, y) in enumerate(path)], "layout string, route long, i long, x long, y long")
    monkeypatch.setattr(spatial_queries.b, "points", lambda spark, sf_dir: points)
    ink = set()
    for (ax, ay), (bx, by) in zip(path, path[1:]):
        n = max(abs(bx - ax), abs(by - ay), 1)
        for k in range(n + 1):
            x, y = int((ax + (bx - ax) * k / n + 0.5) // 1), int((ay + (by - ay) * k / n + 0.5) // 1)
            ink |= {(x + dx, y + dy) for dx in range(-2, 3) for dy in range(-2, 3) if dx * dx + dy * dy <= 6}
    row = spatial_queries.rasterised_routes(spark, "").first()
    assert (row.n_pixels, row.sum_x, row.sum_y) == (len(ink), sum(x for x, _ in ink), sum(y for _, y in ink))


def test_all_annotated_circles_are_matched(spark, monkeypatch):
    """Circles far from each other: each meets its own shifted one, of odd id or even."""
    from planwalk.plans import raster_queries

    circles = spark.createDataFrame([(1, k, 100.0 * k, 50.0) for k in range(1, 7)], "layout long, ex_id long, cx double, cy double")
    monkeypatch.setattr(raster_queries.b, "exhibits", lambda spark, sf_dir: circles)
    got = {(r.found_id, r.ann_id) for r in raster_queries.circle_matches(spark, "").collect()}
    assert got == {(k, k) for k in range(1, 7)}


def test_rounds_of_components_leave_one_table_of_pairs(spark, monkeypatch):
    from planwalk.plans import shared

    held, most = set(), []
    keep, drop = shared.keep, shared.drop

    def kept(df, name, outer=False):
        out = keep(df, name, outer)
        held.add(out.kept_path) if name == "pixel-pairs" else None
        most.append(len(held))
        return out

    monkeypatch.setattr(shared, "keep", kept)
    monkeypatch.setattr(shared, "drop", lambda *some: (held.difference_update(x.kept_path for x in some), drop(*some)))
    line = spark.range(60).selectExpr("1L AS route", "id AS x", "id % 2 AS y")
    assert {(r.cx, r.cy) for r in raster.components(line).collect()} == {(0, 0)}
    # the new pairs and those they are made of
    assert max(most) == 2 and not held


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_of_circles_pair_by_ids_in_few_rounds(spark, monkeypatch, seed):
    rng = random.Random(seed)
    found = [(1, k, 5 * rng.randrange(4), rng.randrange(2)) for k in rng.sample(range(500), 60)] + [(2, k, 0, 0) for k in range(40)]
    drawn = [(1, k, 5 * rng.randrange(4) + rng.randrange(-2, 3), rng.randrange(2)) for k in rng.sample(range(500), 60)] + [(2, k, (-1) ** k, 0) for k in range(30)]
    pairs = sorted((math.dist(f[2:], a[2:]), f[1], a[1], f[0]) for f in found for a in drawn if f[0] == a[0] and math.dist(f[2:], a[2:]) <= 3)
    want = set()
    for _, f, a, img in pairs:
        if not any(i == img and (f == g or a == b) for i, g, b in want):
            want.add((img, f, a))
    rounds, closest = [], raster._closest
    monkeypatch.setattr(raster, "_closest", lambda *tables: rounds.append(1) or closest(*tables))
    tables = spark.createDataFrame(found, "img long, found_id long, x long, y long"), spark.createDataFrame(drawn, "img long, ann_id long, x long, y long")
    assert {(r.img, r.found_id, r.ann_id) for r in raster.match_circles(*tables, 3.0).collect()} == want
    few = [t.where("img = 2") for t in tables]
    rounds.clear()
    assert raster.match_circles(*few, 3.0).count() == 30 and len(rounds) == 1


def test_no_pixel_table_is_broadcast(spark):
    pixels = shared.keep(spark.range(200).selectExpr("id % 2 AS route", "id AS x", "id AS y"), "test-pixels")
    plans = [raster.neighbours(pixels), raster.subtracted(pixels, pixels.where("x > 3")), raster.path_length(pixels, pixels.selectExpr("*", "x AS cx", "y AS cy"))]
    assert not any("Broadcast" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_strokes_are_drawn_without_rows_of_pixels(spark):
    """Only points are exchanged, whatever their strokes cover; runs are disjoint."""
    rng = random.Random(4)
    points = spark.createDataFrame([(0, k % 3, k, rng.randrange(90), rng.randrange(90)) for k in range(1800)], "layout long, route long, i long, x long, y long")
    runs = spatial.ink_runs(points)
    for df in (runs, spatial.stroke_pixels(points)):
        assert "generate explode" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    drawn = [(r.route, x, r.y) for r in runs.collect() for x in range(r.low, r.high + 1)]
    assert len(drawn) == len(set(drawn)) == spatial.rasterise(points).distinct().count()
