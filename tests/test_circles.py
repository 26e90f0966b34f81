"""Circles by votes: planted ones, blank images and the order of suppression."""

import random

from planwalk.operators import circles


def disc(cx, cy, r, gray, inner=-1):
    return {(x, y): gray for x in range(cx - r, cx + r + 1) for y in range(cy - r, cy + r + 1) if inner * abs(inner) < (x - cx) ** 2 + (y - cy) ** 2 <= r * r}


def found(spark, images, radii, w=90, h=80):
    image = spark.createDataFrame([(k, x, y, g) for k, one in enumerate(images) for (x, y), g in one.items()], "route long, x long, y long, gray int")
    sizes = spark.createDataFrame([(k, w, h) for k in range(len(images))], "route long, w long, h long")
    annotated = spark.createDataFrame([(k, r) for k, some in enumerate(radii) for r in some], "route long, r long")
    out = {}
    for r in circles.circles(image, sizes, annotated).collect():
        out.setdefault(r.route, []).append((r.x, r.y, r.r))
    return out


def test_planted_circles_are_found_and_nothing_else(spark):
    stroke = {(x, 75): 0 for x in range(5, 85)}
    images = [
        disc(20, 20, 9, 0) | disc(60, 25, 12, 90) | stroke,
        disc(40, 40, 14, 30, inner=11),
        stroke,
        disc(30, 30, 10, 0),
        disc(2, 40, 15, 0) | disc(60, 40, 15, 0),
        {},
    ]
    images[4] = {p: g for p, g in images[4].items() if p[0] >= 0}
    got = found(spark, images, [[9, 12], [14], [9], [], [15], [10]])
    planted = {0: [(20, 20, 9), (60, 25, 12)], 1: [(40, 40, 14)], 4: [(2, 40, 15), (60, 40, 15)]}
    assert set(got) == set(planted)
    for k, wanted in planted.items():
        assert len(got[k]) == len(wanted)
        for have, want in zip(sorted(got[k]), sorted(wanted)):
            assert all(abs(a - b) <= 1 for a, b in zip(have, want)), (have, want)


def test_radius_window_follows_the_median(spark):
    got = {r.route: (r.low, r.high, r.apart) for r in circles.windows(spark.createDataFrame([(1, 10), (1, 40), (1, 50), (2, 4), (3, None)], "route long, r long")).collect()}
    assert got == {1: (16, 64, 32), 2: (5, 30, 10)}


def test_suppression_takes_the_most_voted_first(spark):
    rng = random.Random(4)
    rows = [(k, x, y, rng.randrange(21, 40)) for k in range(3) for x, y in {(rng.randrange(60), rng.randrange(60)) for _ in range(70)}]
    window = spark.createDataFrame([(k, 5, 30, 10 + k) for k in range(3)], "route long, low int, high int, apart int")
    got = sorted(tuple(r) for r in circles.spaced(spark.createDataFrame(rows, "route long, x long, y long, votes long"), window).collect())
    want = []
    for k in range(3):
        kept = []
        for _, x, y, v in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], r[1], r[2])):
            if all((x - a) ** 2 + (y - b) ** 2 >= (10 + k) ** 2 for a, b, _ in kept):
                kept.append((x, y, v))
        want += [(k, *c) for c in kept]
    assert got == sorted(want)


def test_tables_without_rows(spark):
    image = spark.createDataFrame([], "route long, x long, y long, gray int")
    sizes = spark.createDataFrame([], "route long, w long, h long")
    assert circles.circles(image, sizes, spark.createDataFrame([], "route long, r long")).count() == 0
