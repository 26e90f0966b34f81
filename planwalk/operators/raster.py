"""Routes as pixels: rows (route, x, y). Neighbours are the eight around a pixel.

Adjacency is an equi-join on shifted coordinates, but inside of small tiles, which a task has whole. Masks that brushes grow or shrink are dealt by route before, so that only
their own pixels move and not what the brushes make of them. Geodesic walks, which would take a round for each step, run
for one route at a time; a route's line is what one task holds. Thinning and pruning are in `lines`.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.functions import geometry
from planwalk.plans import shared

AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]
#: Columns and rows of a tile, inside of which a task joins pixels to parts.
TILE = 32


def neighbours(pixels: DataFrame, around: list[tuple[int, int]] = AROUND) -> DataFrame:
    """(route, x, y, nx, ny): each pair of neighbouring pixels in both directions."""
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in around])
    near = pixels.select("route", "x", "y", F.explode(shifts).alias("o")).select("route", "x", "y", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    return shared.meet(near, pixels.select("route", F.col("x").alias("nx"), F.col("y").alias("ny")), ["route", "nx", "ny"]).select("route", "x", "y", "nx", "ny")


def endpoints(pixels: DataFrame) -> DataFrame:
    """Pixels with exactly one neighbour; nothing lies beyond the image's border."""
    return neighbours(pixels).groupBy("route", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("route", "x", "y")


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """Numbers that tell values apart, one array for each field of structs."""
    if pa.types.is_struct(column.type):
        return [k for field in column.flatten() for k in _numbers(field)]
    return [column.dictionary_encode(null_encoding="encode").indices.to_numpy()]


def joined(key: np.ndarray, steps: list[int]) -> np.ndarray:
    """For each of the sorted numbers, the place of the first that it is joined with; numbers that lie a step apart are joined."""
    ends = []
    for step in steps:
        near = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        one = np.flatnonzero(key[near] == key + step)
        ends.append((one, near[one]))
    a, b = (np.concatenate(side) for side in zip(*ends))
    part = np.arange(len(key))
    while len(a):
        np.minimum.at(part, np.maximum(part[a], part[b]), np.minimum(part[a], part[b]))
        while (part[part] != part).any():
            part = part[part]
        apart = part[a] != part[b]
        a, b = a[apart], b[apart]
    return part


def _tile_parts(table: pa.Table, around: list[tuple[int, int]], size: int) -> pa.Table:
    """Adds to distinct pixels of whole tiles the least (x, y) that each is connected with inside its tile."""
    routes = _numbers(table.column("route").combine_chunks())
    x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
    order = np.lexsort((y, x, y // size, x // size, *routes))
    x, y = x[order], y[order]
    new = np.any([np.diff(k) != 0 for k in (x // size, y // size, *(r[order] for r in routes))], axis=0)
    # a number tells tile and place; tiles have a margin, so no step leads into another one
    wide = size + 2
    key = (np.append(0, np.cumsum(new)) * wide + x % size + 1) * wide + y % size + 1
    part = joined(key, [dx * wide + dy for dx, dy in around if (dx, dy) > (0, 0)])
    out = table.take(pa.array(order))
    return out.append_column("cx", pa.array(x[part], out.schema.field("x").type)).append_column("cy", pa.array(y[part], out.schema.field("y").type))


def components(pixels: DataFrame, around: list[tuple[int, int]] = AROUND) -> DataFrame:
    """(route, x, y, cx, cy): each pixel with the least (x, y) of its connected pixels.

    Pixels move once, to tiles of TILE by TILE, each whole in one group of many; there they are joined to parts. What is left
    are pairs of parts that touch across a border, if there are any. In each round every part joins the one around it that
    comes first in a hashed order, and goes on to what that one joins, up to four steps; pairs of what has become one go.
    Ways down in a hashed order are short, whatever the parts' shape, so rounds are few and pairs dwindle fast. Pairs and
    moves are stored, and parts follow all moves at the end."""
    pixels = pixels.select("route", "x", "y").distinct().where("route IS NOT NULL")
    size = TILE
    name = lambda x, y: F.struct(F.xxhash64(x, y).alias("h"), F.col(x).alias("x"), F.col(y).alias("y"))
    tile = lambda x, y: [F.floor(F.col(c) / size) for c in (x, y)]
    with shared.scratch():
        stored = shared.keep(pixels, "pixels")
        whole = stored.where("x IS NOT NULL AND y IS NOT NULL")
        groups = -(-stored.count() // shared.ROWS)
        kinds = ", ".join(f"{c} {stored.schema[k].dataType.simpleString()}" for c, k in (("route", "route"), ("x", "x"), ("y", "y"), ("cx", "x"), ("cy", "y")))
        dealt = whole.groupBy(F.pmod(F.xxhash64("route", *tile("x", "y")), F.lit(max(groups, 1))))
        parts = dealt.applyInArrow(lambda table: _tile_parts(table, around, size), kinds)
        alone = stored.where("x IS NULL OR y IS NULL").select("route", "x", "y", F.col("x").alias("cx"), F.col("y").alias("cy"))
        labels = shared.keep(parts.unionByName(alone), "pixel-components", outer=True)
        edge = labels.where(" OR ".join(f"pmod({c}, {size}) IN (0, {size - 1})" for c in "xy"))
        beyond = edge.withColumn("o", F.explode(_offsets(around))).withColumn("nx", F.col("x") + F.col("o.dx")).withColumn("ny", F.col("y") + F.col("o.dy"))
        beyond = beyond.where(F.array(*tile("x", "y")) != F.array(*tile("nx", "ny"))).select("route", "nx", "ny", name("cx", "cy").alias("a"))
        other = edge.select("route", F.col("x").alias("nx"), F.col("y").alias("ny"), name("cx", "cy").alias("b"))
        pairs = shared.keep(shared.meet(beyond, other, ["route", "nx", "ny"]).select("route", "a", "b").distinct(), "pixel-pairs")
        if pairs.isEmpty():
            return labels
        ends, moves = shared.keep(pairs.select("route", "a", F.col("a").alias("c")).distinct(), "pixel-parts"), []
        while not pairs.isEmpty():
            low = shared.keep(pairs.groupBy("route", "a").agg(F.min("b").alias("b")).select("route", "a", F.least("a", "b").alias("to")), "pixel-moves")
            for _ in range(2):
                low = shared.meet(low, low.select("route", F.col("a").alias("to"), F.col("to").alias("far")), ["route", "to"]).select("route", "a", F.col("far").alias("to"))
            moved = shared.keep(low, "pixel-moves")
            moves.append(moved.withColumnRenamed("a", "c"))
            new = shared.meet(shared.meet(pairs, moved.withColumnRenamed("to", "na"), ["route", "a"]), moved.select("route", F.col("a").alias("b"), F.col("to").alias("nb")), ["route", "b"])
            less = shared.keep(new.where("na <> nb").select("route", F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "pixel-pairs")
            shared.drop(pairs)
            pairs = less
        for moved in moves:
            ends = shared.meet(ends, moved, ["route", "c"], "left").select("route", "a", F.coalesce("to", "c").alias("c"))
        ends = shared.keep(ends, "pixel-parts")
        least = ends.groupBy("route", "c").agg(F.min(F.struct("a.x", "a.y")).alias("m"))
        ends = shared.meet(ends, least, ["route", "c"]).select("route", F.col("a.x").alias("cx"), F.col("a.y").alias("cy"), "m")
        whole = shared.meet(labels, ends, ["route", "cx", "cy"], "left")
        found = shared.keep(whole.select("route", "x", "y", F.coalesce("m.x", "cx").alias("cx"), F.coalesce("m.y", "cy").alias("cy")), "pixel-components", outer=True)
        shared.drop(labels)
        return found


def fragments(labelled: DataFrame) -> DataFrame:
    """(route, cx, cy, size, mid_x, mid_y, is_noise): each component's size and centroid; noise is smaller than a
    hundredth of the route's largest, and never a single-pixel limit below 1."""
    each = labelled.groupBy("route", "cx", "cy").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("x"), 1).alias("mid_x"), F.round(F.avg("y"), 1).alias("mid_y"))
    main = F.max("size").over(Window.partitionBy("route"))
    return each.withColumn("is_noise", F.col("size") < F.greatest(F.lit(1), F.floor(main * 0.01)))


def by_size(parts: DataFrame) -> DataFrame:
    """parts with `place`: from 1 in each route, the largest first, ties by least pixel."""
    return parts.withColumn("place", F.row_number().over(Window.partitionBy("route").orderBy(F.desc("size"), "cx", "cy")).cast("bigint"))


def connectivity(parts: DataFrame) -> DataFrame:
    """(route, n_fragments, main_size, is_connected) without noise."""
    good = parts.where("NOT is_noise").groupBy("route").agg(F.count(F.lit(1)).alias("n_fragments"), F.max("size").alias("main_size"))
    return good.withColumn("is_connected", F.col("n_fragments") == 1)


def path_length(pixels: DataFrame, labelled: DataFrame) -> DataFrame:
    """(route, length): every neighbouring pair once, 1 or the root of 2 long, rounded to 2 places per component and summed."""
    # a pixel tells what it is part of to itself, and the four places ahead that it is there, straight or aslant
    told = lambda dx, dy: F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
    sent = shared.dealt(labelled.where("x IS NOT NULL AND y IS NOT NULL")).withColumn("o", F.explode(F.array(told(0, 0), *[told(*o) for o in AROUND if o > (0, 0)])))
    own, straight = (F.col("o.dx") == 0) & (F.col("o.dy") == 0), (F.col("o.dx") == 0) | (F.col("o.dy") == 0)
    sent = sent.select("route", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.when(own, F.col("cx")).alias("cx"), F.when(own, F.col("cy")).alias("cy"), (straight & ~own).cast("bigint").alias("straight"), (~straight).cast("bigint").alias("aslant"))
    met = sent.groupBy("route", "x", "y").agg(F.max("cx").alias("cx"), F.max("cy").alias("cy"), F.sum("straight").alias("straight"), F.sum("aslant").alias("aslant")).where("cx IS NOT NULL")
    each = met.groupBy("route", "cx", "cy").agg(F.round(F.sum("straight") + F.sum("aslant") * F.sqrt(F.lit(2.0)), 2).alias("part"))
    total = each.groupBy("route").agg(F.round(F.sum("part"), 2).alias("length"))
    return shared.meet(pixels.select("route").distinct(), total, "route", "left").fillna(0.0, ["length"])


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h, s, v) with hue in half degrees (0 to 179) and the others to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(top - low, F.lit(0))
    hue = F.when(top == r, 60.0 * (g - b) / span).when(top == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span)
    half = F.round(F.when(hue < 0, hue + 360).otherwise(hue) / 2)
    return F.struct(F.coalesce(F.when(half >= 180, half - 180).otherwise(half), F.lit(0.0)).cast("int").alias("h"), F.coalesce(F.round(255.0 * (top - low) / F.nullif(top, F.lit(0))), F.lit(0.0)).cast("int").alias("s"), top.cast("int").alias("v"))


def color_bin() -> Column:
    """Number of a pixel's bin: 36 hues by 8 saturations by 4 values."""
    return F.floor(F.col("h") / 5) * 32 + F.floor(F.col("s") / 32) * 4 + F.floor(F.col("v") / 64)


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img", color_bin().alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def in_bin(number: Column, h: Column, s: Column, v: Column) -> Column:
    """Whether a colour lies in a bin's range: 10 hues, 35 saturations and 50 values around its centre, hues closing to a circle."""
    hc, sc, vc = F.floor(number / 32) * 5 + 2.5, F.floor(number % 32 / 4) * 32 + 16, number % 4 * 64 + 32
    # whole hues, cut off towards zero
    low, high = (hc - 10).cast("int"), (hc + 10).cast("int")
    hue = F.when(hc - 10 < 0, (h >= low + 180) | (h <= high)).when(hc + 10 > 179, (h >= low) | (h <= high - 180)).otherwise(h.between(low, high))
    return hue & (F.abs(s - sc) <= 35) & (F.abs(v - vc) <= 50)


def dominant_bin(candidates: DataFrame, original: DataFrame, presence: float = 0.01, least_saturation: int = 50, sizes: DataFrame | None = None) -> DataFrame:
    """(img, bin, cnt, share): the most frequent bin of the candidate pixels that is coloured and rare in the original image.

    Bins below 5 pixels are ignored; an image whose first bin has less than a tenth of its pixels has none. A bin's range
    is in_bin()'s. sizes(img, size): the pixels of the original images, if the table lacks some (white ones). The original
    image is reduced to its distinct colours first."""
    bins = histogram(candidates)
    total = F.sum("cnt").over(Window.partitionBy("img"))
    place = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("cnt"), "bin"))
    ranked = bins.withColumn("share", F.col("cnt") / total).withColumn("rank", place).withColumn("top", F.max("share").over(Window.partitionBy("img")))
    centre = ranked.where("top >= 0.1 AND cnt >= 5").select("img", "bin", "cnt", "share", "rank").where(F.floor(F.col("bin") % 32 / 4) * 32 + 16 >= least_saturation)
    colors = original.groupBy("img", "h", "s", "v").agg(F.count(F.lit(1)).alias("n"))
    size = colors.groupBy("img").agg(F.sum("n").alias("size")) if sizes is None else sizes
    near = centre.join(colors, "img").where(in_bin(F.col("bin"), F.col("h"), F.col("s"), F.col("v")))
    common = near.groupBy("img", "bin").agg(F.sum("n").alias("n"))
    tested = centre.join(common, ["img", "bin"], "left").join(size, "img").where(F.coalesce("n", F.lit(0)) / F.col("size") <= presence)
    return tested.groupBy("img").agg(F.min_by(F.struct("bin", "cnt", "share"), "rank").alias("b")).select("img", "b.bin", "b.cnt", F.round("b.share", 4).alias("share"))


def geodesic(points: set[tuple[int, int]], start: tuple[int, int]) -> dict[tuple[int, int], float]:
    """Length of the path with the fewest steps from start to each pixel it reaches; of equal ones the first found, as pixels
    look around by columns and each column from above."""
    dist, queue = {start: 0.0}, deque([start])
    while queue:
        x, y = queue.popleft()
        for dx, dy in AROUND:
            at = x + dx, y + dy
            if at in points and at not in dist:
                dist[at] = dist[x, y] + (2**0.5 if dx and dy else 1.0)
                queue.append(at)
    return dist


def farthest(pixels: DataFrame, starts: DataFrame) -> DataFrame:
    """(route, x, y, length): the pixel farthest from the route's start along its pixels; ties by (x, y). starts(route, sx, sy)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = set(zip(pdf["x"].tolist(), pdf["y"].tolist()))
        start = int(pdf["sx"].iloc[0]), int(pdf["sy"].iloc[0])
        dist = geodesic(points, start)
        (x, y), far = min(dist.items(), key=lambda d: (-d[1], d[0]))
        return pd.DataFrame({"route": [pdf["route"].iloc[0]], "x": [x], "y": [y], "length": [round(far, 2)]})

    return shared.meet(pixels, starts, "route").select("route", "x", "y", "sx", "sy").groupBy("route").applyInPandas(run, "route bigint, x bigint, y bigint, length double")


_FOUND_AT, _ANN_AT = ["img", "fx", "fy"], ["img", "ax", "ay"]


def match_circles(found: DataFrame, annotated: DataFrame, *radii: float) -> DataFrame:
    """(img, found_id, ann_id, dist): detected circles (img, found_id, x, y) to annotated ones (img, ann_id, x, y), each used
    once, the closest pairs first and none farther than the radius; ties by ids, which are an image's own. Several radii are
    passes one after the other, each over what the ones before have left. Candidates come from a grid join.

    Circles at one place are as far from others as each other, so places are paired, not circles, and a round takes all
    images' next pairs at once; see _closest()."""
    out = None
    with shared.scratch():
        left = shared.keep(found.select("img", "found_id", F.col("x").alias("fx"), F.col("y").alias("fy")).distinct(), "circles-found")
        ann = shared.keep(annotated.select("img", "ann_id", F.col("x").alias("ax"), F.col("y").alias("ay")).distinct(), "circles-annotated")
        for radius in radii:
            places = shared.keep(_near_places(left.select(*_FOUND_AT).distinct(), ann.select(*_ANN_AT).distinct(), radius), "circle-places")
            while not places.isEmpty():
                taken = shared.keep(_closest(places, left, ann), "circle-matches", outer=True)
                out = taken if out is None else out.unionByName(taken)
                left = shared.keep(shared.meet(left, taken, ["img", "found_id"], "left_anti"), "circles-found")
                ann = shared.keep(shared.meet(ann, taken, ["img", "ann_id"], "left_anti"), "circles-annotated")
                rest = shared.meet(places, left.select(*_FOUND_AT).distinct(), _FOUND_AT, "left_semi")
                places = shared.keep(shared.meet(rest, ann.select(*_ANN_AT).distinct(), _ANN_AT, "left_semi"), "circle-places")
    return out if out is not None else found.join(annotated.select("img", "ann_id"), "img").select("img", "found_id", "ann_id", F.lit(0.0).alias("dist")).limit(0)


def _closest(places: DataFrame, left: DataFrame, ann: DataFrame) -> DataFrame:
    """Pairs of circles that taking the closest pairs one by one takes, too, at least one where there are any.

    Where a place and its closest ones (several, if equally far) have no other closest place, their circles pair in the order
    of their ids. Elsewhere the first circle of one place and that of another pair if each is the other's first."""
    firsts = shared.meet(places, left.groupBy(*_FOUND_AT).agg(F.min("found_id").alias("f1")), _FOUND_AT)
    firsts = shared.meet(firsts, ann.groupBy(*_ANN_AT).agg(F.min("ann_id").alias("a1")), _ANN_AT)
    f, a = Window.partitionBy(*_FOUND_AT), Window.partitionBy(*_ANN_AT)
    of_f, of_a = F.col("dist") == F.col("df"), F.col("dist") == F.col("da")
    seen = firsts.withColumn("df", F.min("dist").over(f)).withColumn("nf", F.count(F.when(of_f, 1)).over(f)).withColumn("first_a", F.min(F.when(of_f, F.col("a1"))).over(f))
    seen = seen.withColumn("da", F.min("dist").over(a)).withColumn("na", F.count(F.when(of_a, 1)).over(a)).withColumn("first_f", F.min(F.when(of_a, F.col("f1"))).over(a))
    seen = seen.withColumn("one_f", F.min(F.when(of_a, of_f & (F.col("nf") == 1))).over(a)).withColumn("one_a", F.min(F.when(of_f, of_a & (F.col("na") == 1))).over(f))
    mutual = seen.where(of_f & of_a)
    key = lambda side, at: F.struct(F.lit(side).alias("side"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(at)])
    alone = mutual.where("one_a OR one_f").withColumn("star", F.when(F.col("one_a"), key(0, _FOUND_AT)).otherwise(key(1, _ANN_AT)))
    alone = shared.keep(alone.select("star", *_FOUND_AT, "ax", "ay", "dist"), "circle-stars")
    ranked = lambda circles, at, name: shared.meet(circles, alone.select("star", "dist", *at).distinct(), at).withColumn("rank", F.row_number().over(Window.partitionBy("star").orderBy(name))).select("star", "rank", "img", name, "dist")
    zipped = shared.meet(ranked(left, _FOUND_AT, "found_id"), ranked(ann, _ANN_AT, "ann_id").drop("img", "dist"), ["star", "rank"])
    single = mutual.where("NOT (one_a OR one_f) AND a1 = first_a AND f1 = first_f")
    return zipped.select("img", "found_id", "ann_id", "dist").unionByName(single.select("img", F.col("f1").alias("found_id"), F.col("a1").alias("ann_id"), "dist"))


def _near_places(found: DataFrame, annotated: DataFrame, radius: float) -> DataFrame:
    """(img, fx, fy, ax, ay, dist) of places within the radius."""
    cell = F.lit(float(radius))
    spread = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = found.withColumn("gx", F.floor(F.col("fx") / cell)).withColumn("gy", F.floor(F.col("fy") / cell))
    b = annotated.withColumn("ox", spread).withColumn("oy", spread)
    b = b.withColumn("gx", F.floor(F.col("ax") / cell) + F.col("ox")).withColumn("gy", F.floor(F.col("ay") / cell) + F.col("oy")).drop("ox", "oy")
    pairs = shared.meet(a, b, ["img", "gx", "gy"]).withColumn("dist", F.sqrt((F.col("fx") - F.col("ax")) ** 2 + (F.col("fy") - F.col("ay")) ** 2)).where(F.col("dist") <= radius)
    return pairs.select(*_FOUND_AT, "ax", "ay", "dist")


def scale_estimate(matches: DataFrame) -> DataFrame:
    """(img, sx, sy): the median ratio of the annotated to the detected coordinate over matched circles (img, x, y, ax, ay)."""
    ratio = lambda a, d: F.percentile(F.col(a) / F.greatest(F.col(d), F.lit(1)), F.lit(0.5))
    return matches.groupBy("img").agg(ratio("ax", "x").alias("sx"), ratio("ay", "y").alias("sy"))


def _offsets(brush: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in brush])


def square(low: int, high: int) -> list[tuple[int, int]]:
    """The offsets of a square brush."""
    return [(dx, dy) for dx in range(low, high + 1) for dy in range(low, high + 1)]


def ellipse(radius: int) -> list[tuple[int, int]]:
    """The offsets of a round brush: in each row as many as the circle is wide there, rounded."""
    reach = lambda dy: round(math.sqrt(radius * radius - dy * dy))
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-reach(dy), reach(dy) + 1)]


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def dilate(pixels: DataFrame, brush: list[tuple[int, int]]) -> DataFrame:
    """The pixels that the brush covers as it is laid on each pixel."""
    return pixels.select("route", "x", "y", F.explode(_offsets(brush)).alias("o")).select("route", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()


def erode(pixels: DataFrame, brush: list[tuple[int, int]]) -> DataFrame:
    """The pixels on which the brush covers pixels only; nothing lies beyond an image's border."""
    moved = pixels.select("route", "x", "y").distinct().select("route", "x", "y", F.explode(_offsets(brush)).alias("o")).select("route", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"))
    return moved.groupBy("route", "x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(brush)).select("route", "x", "y")


def closed(pixels: DataFrame, brush: list[tuple[int, int]]) -> DataFrame:
    """Small gaps filled: dilation, then erosion."""
    return erode(dilate(pixels, brush), brush)


def opened(pixels: DataFrame, brush: list[tuple[int, int]]) -> DataFrame:
    """Small specks removed: erosion, then dilation."""
    return dilate(erode(pixels, brush), brush)


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pixels of either mask."""
    return one.select("route", "x", "y").unionByName(other.select("route", "x", "y")).distinct()


def subtracted(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pixels of the first mask that the second lacks."""
    return one.select("route", "x", "y").distinct().transform(lambda held: shared.meet(held, other.select("route", "x", "y"), ["route", "x", "y"], "left_anti"))


def morphological_skeleton(pixels: DataFrame, brush: list[tuple[int, int]] | None = None) -> DataFrame:
    """The pixels that an opening takes from the mask or from any of its erosions, until nothing is left; erosions are stored."""
    brush = brush or CROSS
    with shared.scratch():
        mask, out = shared.keep(pixels.select("route", "x", "y").distinct(), "skeleton-mask"), None
        while not mask.isEmpty():
            less = shared.keep(erode(shared.dealt(mask), brush), "skeleton-mask")
            ends = subtracted(mask, dilate(shared.dealt(less), brush))
            out = ends if out is None else out.unionByName(ends)
            mask = less
        # a pixel may be left over by several erosions
        return shared.keep(out.distinct() if out is not None else mask, "skeleton", outer=True)


def drawn_mask(aligned: DataFrame, original: DataFrame, threshold: int = 10, tolerance: int = 3) -> DataFrame:
    """(route, x, y): what was drawn on an original image, both as (route, x, y, gray), 0 dark to 255.

    Ink is darker than 255 - threshold. Drawn is ink farther than `tolerance` from the original's ink, and what differs by
    more than the threshold there. Pixels that an image lacks are white. Images come smoothed; for coloured ones see `extraction`."""
    ink = lambda df: df.where(F.col("gray") <= 255 - threshold)
    both = shared.meet(aligned.select("route", "x", "y", F.col("gray").alias("a")), original.select("route", "x", "y", F.col("gray").alias("o")), ["route", "x", "y"], "full_outer").fillna(255, ["a", "o"])
    differs = both.where(F.abs(F.col("a") - F.col("o")) > threshold)
    return subtracted(merged(ink(aligned), differs), dilate(ink(original), ellipse(tolerance)))


# Fixed ranges of the two colours (hue, saturation, value, both ends included) that mark an entrance and an exit.
BOX_COLORS = {"entrance": ((35, 85), (60, 255), (60, 255)), "exit": ((20, 35), (80, 255), (80, 255))}


def outlines(labelled: DataFrame, least_area: float = 0) -> DataFrame:
    """(route, cx, cy, area, n_pixels, x, y, w, h) of the components (route, x, y, cx, cy) that may have least_area.

    area: that of the polygon through the centres of a component's outer border, so a box of w by h pixels has
    (w - 1) * (h - 1), a line none, and holes count. Holes are what a flood of the background, side by side from
    around the component, doesn't reach. Of every square of four centres the polygon holds all, if they are all filled, half
    if three are, else nothing."""
    key = ["route", "cx", "cy"]
    boxes = labelled.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pixels"), *[fn(c).alias(n + c) for c in "xy" for n, fn in (("l", F.min), ("h", F.max))])
    boxes = boxes.where((F.col("hx") - F.col("lx")) * (F.col("hy") - F.col("ly")) >= least_area)
    own = shared.meet(labelled, boxes, key, "left_semi").select(F.struct(*key).alias("route"), "x", "y")
    framed = boxes.select(F.struct(*key).alias("route"), "lx", "ly", "hy", F.explode(F.sequence(F.col("lx") - 1, F.col("hx") + 1)).alias("x"))
    framed = framed.select("route", "lx", "ly", "x", F.explode(F.sequence(F.col("ly") - 1, F.col("hy") + 1)).alias("y"))
    flooded = components(shared.meet(framed, own, ["route", "x", "y"], "left_anti"), FOUR)
    corner = boxes.select(F.struct(*key).alias("route"), (F.col("lx") - 1).alias("cx"), (F.col("ly") - 1).alias("cy"))
    filled = own.unionByName(shared.meet(flooded, corner, ["route", "cx", "cy"], "left_anti").select("route", "x", "y"))
    squares = square_counts(filled)
    area = squares.groupBy("route").agg(F.sum(F.when(F.col("n") == 4, 1.0).when(F.col("n") == 3, 0.5).otherwise(0.0)).alias("area")).select("route.*", "area")
    out = shared.meet(boxes, area, key).where(F.col("area") >= least_area)
    return out.select(*key, "area", "n_pixels", F.col("lx").alias("x"), F.col("ly").alias("y"), (F.col("hx") - F.col("lx") + 1).alias("w"), (F.col("hy") - F.col("ly") + 1).alias("h"))


def square_counts(pixels: DataFrame) -> DataFrame:
    """(route, x, y, n): how many of the four pixels (x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1) there are, where any is."""
    spread = pixels.select("route", "x", "y", F.explode(_offsets(square(-1, 0))).alias("o"))
    return spread.select("route", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).groupBy("route", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def color_boxes(pixels: DataFrame, role: str, least_area: float = 100) -> DataFrame:
    """(route, x, y, w, h, area): the bounding box of each image's largest part in the role's colour.

    pixels(route, x, y, h, s, v). Gaps are closed by a brush of five, twice, and specks taken off by it once; an image
    without a part whose outline has least_area (see outlines()) has no box. Ties go to the part with the least first pixel."""
    (h1, h2), (s1, s2), (v1, v2) = BOX_COLORS[role]
    mask = pixels.where(F.col("h").between(h1, h2) & F.col("s").between(s1, s2) & F.col("v").between(v1, v2)).select("route", "x", "y")
    five, nine = square(-2, 2), square(-4, 4)  # twice a brush of five is one of nine
    with shared.scratch():
        mask = shared.dealt(shared.keep(mask, "box-colour"))
        parts = shared.keep(components(shared.keep(opened(erode(dilate(mask, nine), nine), five), "box-mask")), "box-parts")
        best = outlines(parts, least_area).groupBy("route").agg(F.min_by(F.struct("x", "y", "w", "h", "area"), F.struct(-F.col("area"), "cx", "cy")).alias("b"))
        return shared.keep(best.select("route", "b.*"), "boxes", outer=True)


def box_anchors(boxes: dict[str, DataFrame], zones: DataFrame) -> DataFrame:
    """(route, role, corner, x, y, zx, zy): the corners of detected boxes, by role, beside those of the annotated rectangle
    zones(route, role, shape, x, y, w, h); zones of another shape give no anchors. Corners go round from the upper left."""
    out = None
    for role, found in boxes.items():
        rect = zones.where((F.col("role") == role) & (F.col("shape") == "rectangle")).select("route", geometry.rectangle_corners(F.struct("x", "y", "w", "h")).alias("z"))
        seen = found.select("route", geometry.rectangle_corners(F.struct("x", "y", "w", "h")).alias("b"))
        one = seen.join(rect, "route").select("route", F.lit(role).alias("role"), F.posexplode(F.arrays_zip("b", "z")).alias("corner", "p")).select("route", "role", "corner", "p.b.x", "p.b.y", F.col("p.z.x").alias("zx"), F.col("p.z.y").alias("zy"))
        out = one if out is None else out.unionByName(one)
    return out


def line_ends(points: set[tuple[int, int]], in_x: float, in_y: float, out_x: float, out_y: float, connected: bool) -> tuple:
    """(sx, sy, ex, ey, length) of one route's thinned pixels; see route_ends()."""
    ends = sorted(p for p in points if sum((p[0] + dx, p[1] + dy) in points for dx, dy in AROUND) == 1)
    near = lambda some, x, y: min(some, key=lambda p: ((p[0] - x) ** 2 + (p[1] - y) ** 2, p))
    start = near(ends, in_x, in_y) if ends and not pd.isna(in_x) else None
    rest = [p for p in ends if p != start]
    dist = geodesic(points, start) if start else {}
    end = None
    if len(rest) == 1:
        end = rest[0]
    elif rest and start and connected:
        met = [p for p in rest if p in dist]
        end = min(met, key=lambda p: (-dist[p], p)) if met else None
    elif rest and not pd.isna(out_x):
        end = near(rest, out_x, out_y)
    return *(start or (None, None)), *(end or (None, None)), round(dist[end], 2) if end in dist else None


def route_ends(pixels: DataFrame, anchors: DataFrame, connected: DataFrame) -> DataFrame:
    """(route, sx, sy, ex, ey, length): where a thinned route starts and ends.

    anchors(route, in_x, in_y, out_x, out_y): centres of entrance and exit, null if not known; connected(route,
    is_connected). The start is the end pixel nearest to the entrance. The end is the only other one; of several, in a
    connected route the one with the longest way from the start, else the one nearest to the exit. Ties go by (x, y).
    Without an entrance there is no start, and with several ends then no end but by the exit. length: the way from start
    to end along the pixels, null where there is none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        found = line_ends(set(zip(pdf["x"].tolist(), pdf["y"].tolist())), row["in_x"], row["in_y"], row["out_x"], row["out_y"], bool(row["is_connected"]))
        return pd.DataFrame({"route": [row["route"]], **{c: [v] for c, v in zip(("sx", "sy", "ex", "ey", "length"), found)}})

    held = shared.meet(shared.meet(pixels, anchors, "route", "left"), connected.select("route", "is_connected"), "route", "left").fillna(False, ["is_connected"])
    return held.select("route", "x", "y", "in_x", "in_y", "out_x", "out_y", "is_connected").groupBy("route").applyInPandas(run, "route bigint, sx bigint, sy bigint, ex bigint, ey bigint, length double")
