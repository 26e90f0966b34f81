"""Masks, walks, discovery, whole records and batches, against plain Python."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwalk.operators import catalogue, coverage, extraction, raster, scoring, spatial, validation
from planwalk.sources import discovery, files, images


def mask(spark, points, route=1):
    return spark.createDataFrame([(route, int(x), int(y)) for x, y in points], "route long, x long, y long")


def held(df):
    return {(r.x, r.y) for r in df.collect()}


def blob(seed, n=120, size=14):
    rng = random.Random(seed)
    return {(rng.randrange(size), rng.randrange(size)) for _ in range(n)}


def plain_dilate(points, brush):
    return {(x + dx, y + dy) for x, y in points for dx, dy in brush}


def plain_erode(points, brush):
    around = {(x - dx, y - dy) for x, y in points for dx, dy in brush}
    return {(x, y) for x, y in around if all((x + dx, y + dy) in points for dx, dy in brush)}


@pytest.mark.parametrize("seed,brush", [(1, raster.square(0, 1)), (2, raster.square(-1, 1)), (3, raster.CROSS)])
def test_masks(spark, seed, brush):
    points = blob(seed)
    df = mask(spark, [*points, *points])
    assert held(raster.dilate(df, brush)) == plain_dilate(points, brush)
    assert held(raster.erode(df, brush)) == plain_erode(points, brush)
    assert held(raster.closed(df, brush)) == plain_erode(plain_dilate(points, brush), brush)
    assert held(raster.opened(df, brush)) == plain_dilate(plain_erode(points, brush), brush)
    nothing = df.limit(0)
    assert held(raster.closed(nothing, brush)) == held(raster.morphological_skeleton(nothing)) == set()


def test_morphological_skeleton(spark):
    points, want = blob(4, 400, 16), set()
    left = points
    while left:
        less = plain_erode(left, raster.CROSS)
        want |= left - plain_dilate(less, raster.CROSS)
        left = less
    assert held(raster.morphological_skeleton(mask(spark, points))) == want


def test_drawn_mask_forgives_what_lies_near(spark):
    image = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 0), (1, 9, 0, 0), (1, 5, 5, 200)], "route long, x long, y long, gray int")
    plain = spark.createDataFrame([(1, 0, 0, 0), (1, 5, 5, 255)], "route long, x long, y long, gray int")
    assert held(raster.drawn_mask(image, plain, 10, 1)) == {(9, 0), (5, 5)}


def test_matching_in_two_passes(spark):
    found = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 9.0, 0.0)], "img long, found_id long, x double, y double")
    drawn = spark.createDataFrame([(0, 7, 4.0, 0.0), (0, 8, 8.0, 0.0)], "img long, ann_id long, x double, y double")
    for radii in ((2.0, 6.0), (6.0,)):
        assert {(r.found_id, r.ann_id) for r in raster.match_circles(found, drawn, *radii).collect()} == {(2, 8), (1, 7)}
    assert [r.found_id for r in raster.match_circles(found, drawn, 2.0).collect()] == [2]
    assert raster.match_circles(found.limit(0), drawn, 2.0, 3.0).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_matching_is_that_of_the_closest_first(spark, seed):
    rng = random.Random(seed)
    a = [(0, k, float(rng.randrange(20)), float(rng.randrange(20))) for k in range(25)]
    b = [(0, k, float(rng.randrange(20)), float(rng.randrange(20))) for k in range(25)]
    left, right, want = set(), set(), set()
    for d, i, j in sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, i, j) for _, i, x, y in a for _, j, u, v in b):
        if d <= 6 and i not in left and j not in right:
            left.add(i)
            right.add(j)
            want.add((i, j))
    found = spark.createDataFrame(a, "img long, found_id long, x double, y double")
    drawn = spark.createDataFrame(b, "img long, ann_id long, x double, y double")
    assert {(r.found_id, r.ann_id) for r in raster.match_circles(found, drawn, 6.0).collect()} == want


def test_route_ends(spark):
    line = [(x, 0) for x in range(8)] + [(3, y) for y in range(1, 4)]
    one = mask(spark, line, 1).union(mask(spark, line, 2)).union(mask(spark, line, 3)).union(mask(spark, [(0, 0), (1, 0)], 4)).union(mask(spark, [(5, 5)], 5))
    anchors = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 9.0), (2, 0.0, 0.0, 3.0, 9.0), (3, None, None, 3.0, 9.0), (4, 0.0, 0.0, None, None), (5, 0.0, 0.0, None, None)], "route long, in_x double, in_y double, out_x double, out_y double")
    connected = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "route long, is_connected boolean")
    got = {r.route: tuple(r)[1:] for r in raster.route_ends(one, anchors, connected).collect()}
    assert got[1] == (0, 0, 7, 0, 7.0)  # the longest way
    assert got[2] == (0, 0, 3, 3, pytest.approx(got[2][-1])) and got[2][-1] > 0  # nearest to the exit
    assert got[3] == (None, None, 3, 3, None)
    assert got[4] == (0, 0, 1, 0, 1.0)
    assert got[5] == (None,) * 5


def plain_distance(x, y, ax, ay, bx, by):
    long = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long)) if long else 0.0
    return ((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2) ** 0.5


@pytest.mark.parametrize("cell", [16, 2, 0.5])
def test_nearest_segments_are_found_in_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(spatial, "NEAR_CELL", cell)
    rng = random.Random(7)
    points = [(0, k % 3, i, rng.uniform(-90, 400), rng.uniform(-50, 60)) for i, k in enumerate([0] * 120 + [1] * 30 + [2] * 5)]
    made = [(0, k % 2, *(float(rng.choice([0, rng.uniform(-60, 60), 300])) for _ in range(4))) for k in range(24)] + [(0, 0, 5.0, 5.0, 5.0, 5.0), (0, 0, 7.0, -20.0, 7.0, 30.0), (0, 9, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(points, "layout long, route long, i long, x double, y double")
    lined = spark.createDataFrame(made, "layout long, route long, ax double, ay double, bx double, by double")
    got = {r.i: r.d for r in spatial.nearest_segment(df, lined).collect()}
    assert len(got) == len(points)
    for _, route, i, x, y in points:
        near = [plain_distance(x, y, *s[2:]) for s in made if s[1] == route]
        assert got[i] == (pytest.approx(min(near), abs=1e-9) if near else None)
    assert spatial.fidelity(df, lined.limit(0), 5.0).first().similarity is None
    assert spatial.nearest_segment(df.limit(0), lined).count() == 0


def test_short_routes_meet_their_segments_without_cells(spark):
    far = 10**9
    df = spark.createDataFrame([(0, 1, 0, 3.0, 4.0), (0, 2, 0, 1.0, 1.0)], "layout long, route long, i long, x double, y double")
    lined = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 0.0), (0, 1, 9.0, 9.0, float(far), 9.0)], "layout long, route long, ax double, ay double, bx double, by double")
    found = spatial.nearest_segment(df, lined)
    # a segment as long as this one would be told to 10**7 cells
    assert "gx" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.route, r.d) for r in found.collect()} == {(1, 5.0), (2, None)}


@pytest.mark.parametrize("few", [0, 64])
def test_long_and_short_routes_have_equal_distances(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW_SEGMENTS", few)
    rng = random.Random(3)
    points = [(0, k % 2, k, rng.uniform(0, 90), rng.uniform(0, 90)) for k in range(60)]
    made = [(0, int(k >= 70), *(rng.uniform(0, 90) for _ in range(4))) for k in range(75)]
    df = spark.createDataFrame(points, "layout long, route long, i long, x double, y double")
    lined = spark.createDataFrame(made, "layout long, route long, ax double, ay double, bx double, by double")
    got = {r.i: r.d for r in spatial.nearest_segment(df, lined).collect()}
    assert len(got) == 60
    for _, route, i, x, y in points:
        assert got[i] == pytest.approx(min(plain_distance(x, y, *s[2:]) for s in made if s[1] == route), abs=1e-9)


def test_selection(spark):
    paths = ["a/simple/layout_01/hard_01.json", "a/simple/layout_01/hard_02.json", "a/complex/layout_02/easy_semantic.json", "a/draft/layout_03/medium_1.json", "a/simple/layout_01/map.png"]
    listed = spark.createDataFrame([(x,) for x in paths], "path string")
    assert {tuple(r) for r in discovery.tasks(listed).collect()} == {("simple", "layout_01", "hard", "hard_01.json"), ("simple", "layout_01", "hard", "hard_02.json"), ("complex", "layout_02", "easy_semantic", "easy_semantic.json")}
    every = discovery.layouts(listed)
    assert every.count() == 3 and discovery.select(every, complexity=["simple", "complex"], layout=None).count() == 2
    for wrong in ({"layout": ""}, {"layout": []}, {"layout": "layout_09"}):
        with pytest.raises(ValueError):
            discovery.select(every, **wrong)
    assert [(r.variant, r.place) for r in discovery.variants(listed, "hard_*.json").orderBy("place").collect()] == [("hard_01", 1), ("hard_02", 2)]
    results = spark.createDataFrame([("m/hard/simple/hard_01_layout_01/x.json",), ("m/hard/simple/hard_02_layout_01/final_results.json",)], "path string")
    lost = discovery.missing_folders(discovery.tasks(listed), results)
    assert [r.path for r in lost.collect()] == ["m/easy_semantic/complex/easy_semantic_layout_02"]
    empty = files.folders_without(results, "final_results.json").selectExpr("'m' AS model", "'hard' AS difficulty", "dir AS path")
    merged = {(r.model, r.difficulty): (r.paths, r.n, r.n_folders, r.n_files) for r in scoring.missing_paths(lost, empty).collect()}
    assert merged["m", "hard"] == ("m/hard/simple/hard_01_layout_01", 1, 0, 1)


def test_batch_marks_equal_configurations(spark):
    profiles = spark.createDataFrame([(1, "sections", "S", 5, 1), (1, "materials", "m", 3, 1), (1, "materials", "rare", 1, 2), (1, "techniques", "t", 2, 1), (1, "countries", "c", 2, 1)], "layout long, attribute string, value string, cnt long, first_pos long")
    galleries = spark.createDataFrame([(1, "G")], "layout long, gallery string")
    totals = spark.createDataFrame([(1, 6)], "layout long, total long")
    spans = spark.createDataFrame([(1, "10 BC", "20", 1)], "layout long, first string, last string, rank long")
    rows = {r.task: r for r in catalogue.batch(profiles, galleries, totals, spans, {"easy_spatial": 1, "easy_semantic": 1, "medium": 4, "hard": 1}).collect()}
    assert set(rows) == {"easy_spatial", "easy_semantic", "medium_01", "medium_02", "medium_03", "medium_04", "hard"}
    assert rows["easy_spatial"].must_see == ["G"] and rows["easy_semantic"].must_see == []
    asked = [*rows["easy_semantic"].materials, *rows["easy_semantic"].techniques, *rows["easy_semantic"].countries]
    assert len(asked) == 1 and asked[0] in ("rare", "t", "c")
    # all six exhibits from the second on, and pools no longer than their windows
    assert [rows[f"medium_0{k}"].duplicate_of for k in (1, 2, 3, 4)] == [None, None, "medium_02", "medium_02"]
    assert rows["medium_01"].in_range == rows["hard"].in_range == ["10 BC", "20"]
    bare = catalogue.configs(profiles, galleries, totals, 2, "hard").collect()
    assert all(r.in_range == [] for r in bare)


def test_records_of_a_clean_route_and_of_none(spark):
    points = spark.createDataFrame([(0, 1, i, 10 + i, 10) for i in range(5)], "layout long, route long, i long, x long, y long")
    exhibits = spark.createDataFrame([(0, 7, 12, 20, 2)], "layout long, ex_id long, cx long, cy long, r long")
    walls = spark.createDataFrame([(0, 1, [(100, 100), (120, 100), (120, 120)])], "layout long, wall long, points array<struct<x:long,y:long>>")
    regions = spark.createDataFrame([(0, 1, "floor", 0, 0, 200, 200, None), (0, 2, "gallery", 5, 5, 20, 20, "must_see")], "layout long, id long, kind string, x long, y long, w long, h long, cfg string")
    zones = spark.createDataFrame([(0, "entrance", 1, "rectangle", 9, 9, 3, 3, None, None, None, None), (0, "exit", 1, "circle", None, None, None, None, 14, 10, 1, None)], "layout long, role string, id long, shape string, x long, y long, w long, h long, cx long, cy long, r long, points array<struct<x:long,y:long>>")
    connected = spark.createDataFrame([(1, True)], "route long, is_connected boolean")
    scale = spark.createDataFrame([(1, 1000, 100.0, 10**6), (2, 1000, None, 1)], "route long, see_mm long, mm_per_px double, budget_mm long")
    checks, visits = validation.spatial_checks(points, exhibits, walls, regions, zones, connected, scale)
    assert [tuple(r) for r in visits.collect()] == [(1, 7)]
    none = "array<string>"
    tasks = spark.createDataFrame([(k, 0, "hard", [], None, None, [], [], [], ["S"], [7], 1) for k in (1, 2)], f"route long, layout long, difficulty string, in_range {none}, before_year string, after_year string, materials {none}, places {none}, techniques {none}, categories {none}, specific array<long>, min_n long")
    facts = spark.createDataFrame([(0, 7, "S", "m", "t", 1, 2, "c", "d")], "layout long, ex_id long, section string, material string, technique string, year_min int, year_max int, city string, country string")
    fidelity = spark.createDataFrame([(1, 99.5), (2, 1.0)], "route long, similarity double")
    got = {r.route: r for r in validation.final_records(checks, tasks, facts, visits, fidelity).collect()}
    assert got[1].svr == {"connectivity": True, "wall_crossings": False, "exhibit_collision": False, "out_of_area_violations": False}
    assert got[1].scsr == {"start_end_location": True, "must_pass_regions": True, "restricted_area_violations": False, "distance_budget": True}
    assert all(got[1].scar.values()) and len(got[1].scar) == 4 and (got[1].similarity, got[1].status) == (99.5, "ok")
    assert (got[2].status, got[2].similarity) == ("no route", None) and got[2].svr["wall_crossings"] is True and not any(got[2].scar.values())


def test_visits_by_spot_count_as_visits_by_exhibit(spark):
    # alike exhibits of two layouts, one that both list (8) and one that is listed twice at different places (9)
    rows = [(k % 2, k, k % 3 * 40, 10, 2) for k in range(8)] + [(0, 8, 0, 10, 2), (1, 8, 40, 10, 2), (0, 9, 0, 10, 2), (0, 9, 80, 10, 3)]
    exhibits = spark.createDataFrame(rows, "layout long, ex_id long, cx long, cy long, r long")
    circles, members = spatial.spots(exhibits)
    assert (circles.count(), circles.select("spot").distinct().count(), members.count()) == (10, 8, 10)
    none = "array<string>"
    asked = [([], [], [], ["S"], [8, 9, 3]), (["m"], [], [], ["T", "U"], [0]), (["m"], ["d"], ["t"], [], [])]
    tasks = spark.createDataFrame([(k, k % 2, None, None, None, *asked[k % 3], 1 + k % 4) for k in range(12)], f"task long, layout long, in_range {none}, before_year string, after_year string, materials {none}, places {none}, techniques {none}, categories {none}, specific array<long>, min_n long")
    facts = [(k % 2, k, "STU"[k % 3], "mx"[k % 2], "t", 1, 2, "c", "dx"[k // 2 % 2]) for k in range(9)] + [(1, 8, "S", "x", "x", 1, 2, "c", "x"), (0, 9, "T", "m", "t", 1, 2, "c", "d"), (0, 9, "S", "x", "t", 1, 2, "c", "d")]
    facts = spark.createDataFrame(facts, "layout long, ex_id long, section string, material string, technique string, year_min int, year_max int, city string, country string")
    seen = circles.select("spot", "n").distinct().crossJoin(tasks.select("task")).where("pmod(hash(spot, task), 3) > 0").select("task", "spot", "n")
    visits = seen.join(members, "spot").select("task", "ex_id")
    assert seen.count() < visits.count()
    same = [sorted(map(tuple, coverage.semantic_overall(tasks, facts, *v).collect())) for v in ((visits,), (seen, members))]
    assert same[0] == same[1] and len({r[1:] for r in same[0]}) > 2


def test_extraction_of_lines_and_of_nothing(spark):
    plan = [(k, x, 0, 10, 10, 10) for k in (1, 2, 3) for x in range(60)]
    gray = [(1, x, y, 60, 60, 60) for x in range(8, 50) for y in range(20, 25)]
    red = [(3, x, y, 200, 20, 20) for x in range(8, 50) for y in range(20, 25) if x not in (30, 31)]
    kinds = "route long, x long, y long, r int, g int, b int"
    original, aligned = spark.createDataFrame(plan, kinds), spark.createDataFrame(plan + gray + red, kinds)
    sizes = spark.createDataFrame([(k, 60, 60) for k in (1, 2, 3)], "route long, w int, h int")
    anchors = spark.createDataFrame([(k, 60.0, 22.0, 0.0, 22.0) for k in (1, 2, 3)], "route long, in_x double, in_y double, out_x double, out_y double")
    answers = spark.createDataFrame([(1, 8, 22, 30, 22), (1, 30, 22, 49, 32), (2, 0, 0, 9, 9)], "route long, ax long, ay long, bx long, by long")
    found = extraction.extract(aligned, original, sizes, anchors, answers, passes=2)
    got = {r.route: r for r in found.facts.collect()}
    assert (got[1].by_color, got[3].by_color, got[2].by_color) == (False, True, False)
    assert got[1].status == got[3].status == "ok" and got[1].n_fragments == 1
    assert got[3].n_pixels == len(red) and (got[3].n_fragments, got[3].is_connected) == (2, False)
    assert got[1].sx > got[1].ex and got[1].length == pytest.approx(got[1].sx - got[1].ex, abs=2)
    assert 40 < got[1].similarity < 100 and got[1].max_deviation > 3 and got[1].n_line == found.line.where("route = 1").count()
    # no answer: nothing is like it
    assert (got[3].similarity, got[3].mean_deviation, got[3].n_within) == (0.0, None, 0)
    assert got[3].length is not None
    assert tuple(got[2])[1:] == (0, 0, 0, False, None, None, None, None, None, None, None, None, None, None, False, "no route")
    nothing = extraction.extract(aligned.limit(0), original.limit(0), sizes.limit(0), anchors, None)
    assert nothing.facts.count() == nothing.points.count() == 0


def test_extraction_in_memory_and_by_rounds(spark, monkeypatch):
    rng, aligned, original, sizes = random.Random(5), [], [], [(1, 40, 30), (2, 40, 30), (3, 25, 45), (4, 50, 34), (5, 40, 30), (6, 40, 30)]
    for k, w, h in sizes:
        dots = {(rng.randrange(w), rng.randrange(h)) for _ in range(25)}
        original += [(k, x, y, 30, 40, 50) for x, y in dots]
        ink = {(x, y): (40, 40, 40) for x, y in dots}
        for _ in range(3):
            x, y, dx, dy = rng.randrange(w), rng.randrange(h), rng.choice((-1, 0, 1)), rng.choice((-1, 1))
            for i in range(20):
                ink |= {(x + i * dx + a, y + i * dy + b): ((210, 30, 25 + k), (90, 90, 90), (20, 60, 200))[k % 3] for a in range(k % 2 + 2) for b in range(3)}
        aligned += [(k, x, y, *c) for (x, y), c in ink.items() if 0 <= x < w and 0 <= y < h]
    aligned += aligned[:30] + [(6, 50, 3, 20, 20, 20), (None, 3, 3, 1, 1, 1)]  # repeated, outside of its image, of no image
    kinds = "route long, x long, y long, r int, g int, b int"
    tables = [spark.createDataFrame(aligned, kinds), spark.createDataFrame(original, kinds), spark.createDataFrame(sizes, "route long, w int, h int")]
    anchors = spark.createDataFrame([(k, 0.0, 0.0, 40.0, 30.0) if k < 4 else (k, None, None, 5.0, 5.0) for k in range(1, 6)], "route long, in_x double, in_y double, out_x double, out_y double")
    found = []
    for most in (4_000_000, 1200, 0):
        monkeypatch.setattr(extraction, "MOST_CELLS", most)
        found.append([sorted(map(str, df.collect())) for df in extraction.extract(*tables, anchors, None, 2, 10, 1)])
    assert found[0] == found[1] == found[2] and len(found[0][2]) == 7 and any("by_color=True" in r for r in found[0][2])


def png(image, kind, filters):
    step, (height, width) = image.shape[2], image.shape[:2]
    raw, above = b"", np.zeros((width, step), np.int64)
    for y in range(height):
        row, how = image[y].astype(np.int64), filters[y % len(filters)]
        left, corner = np.vstack([np.zeros((1, step), np.int64), row[:-1]]), np.vstack([np.zeros((1, step), np.int64), above[:-1]])
        guess = [0 * row, left, above, (left + above) // 2, images._paeth(left, above, corner)][how]
        raw += bytes([how]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (6, 5, 3))
    assert (images.decode(png(image, 2, [0, 1, 2, 3, 4])) == image).all()
    gray = image[:, :, :1]
    assert (images.decode(png(gray, 0, [4, 3])) == np.repeat(gray, 3, axis=2)).all()
    clear = np.concatenate([image, image[:, :, :1]], axis=2)
    assert (images.decode(png(clear, 6, [1])) == image).all()
    assert (images.decode(b"P6\n# c\n5 6\n255\n" + image.astype(np.uint8).tobytes()) == image).all()
    for bad in (b"no", b"P5 1 1 255\n"):
        with pytest.raises(ValueError):
            images.decode(bad + b" 1 1 1 1")
    (tmp_path / "a.png").write_bytes(png(image, 2, [3]))
    rows = {(r.x, r.y): (r.r, r.g, r.b) for r in images.pixels(spark, str(tmp_path)).collect()}
    assert rows == {(x, y): tuple(image[y, x]) for y in range(6) for x in range(5)}
    (size,) = images.sizes(spark, str(tmp_path)).collect()
    assert (size.width, size.height) == (5, 6) and size.encoded.startswith("iVBOR")


def test_sinks_and_lists(spark, tmp_path):
    df = spark.createDataFrame([("t1", "said", 3, "m/x"), ("t2", None, 4, "m/x")], "task string, raw string, seconds long, model string")
    files.write_raw_output(df, f"{tmp_path}/raw")
    back = {r.task: r for r in spark.read.json(f"{tmp_path}/raw").collect()}
    assert back["t1"].metadata.seconds == 3 and back["t1"].raw == "said" and back["t2"].raw is None
    files.write_json(df, f"{tmp_path}/json", ["task"])
    assert spark.read.json(f"{tmp_path}/json").where("task = 't2'").first().seconds == 4
    (tmp_path / "list.csv").write_text('exhibit_number,Section\n3,"A, b"\nx,C\n')
    assert {tuple(r) for r in files.sections_csv(spark, f"{tmp_path}/list.csv").collect()} == {(3, "A, b"), (None, "C")}
    art = spark.createDataFrame([("1", "S", 'a "b"\nc', "307", "x", "m; n", "t")], files.ARTIFACT)
    files.write_artifacts_csv(art, f"{tmp_path}/art")
    assert [tuple(r) for r in files.artifacts_csv(spark, f"{tmp_path}/art").collect()] == [tuple(r) for r in art.collect()]
    named = spark.createDataFrame([("l", "gallery", "East"), ("l", "gallery", None), ("l", "wall", "x")], "layout string, kind string, gallery_name string")
    assert [tuple(r) for r in files.gallery_names(named).collect()] == [("l", "East")]
    path = df.limit(1).select(files.output_paths("out", F.col("model"), F.lit("hard"), F.lit("simple"), F.lit(None).cast("string"), F.lit("layout_01")).alias("p")).first().p
    assert path.result == "out/m-x/hard/simple/layout_01/final_results.json"
    config = df.limit(1).select(catalogue.base_config().alias("c")).first().c
    assert config.distance_budget_in_mm == 10**9 and config.specific_exhibit_to_cover == []
