"""Circles in images by votes: every edge pixel votes for the centres that it may lie around, and the most voted ones win.

Images are pixel tables (route, x, y, gray) of many images at once; pixels that a table lacks are white.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwalk.operators import extraction, raster
from planwalk.plans import shared

#: Gradient from which a pixel is an edge, votes and edge pixels that a circle must exceed: fixed values.
STRONG, LEAST_VOTES = 60, 20
_PIXEL = ["route", "x", "y"]


def windows(annotated: DataFrame) -> DataFrame:
    """(route, low, high, apart): least and greatest radius to look for and least distance of centres, by the median radius of
    annotated circles (route, r). An image without any gets no row, and no circle is looked for in it."""
    median = F.percentile("r", F.lit(0.5))
    whole = lambda share, least: F.greatest(F.lit(least), (F.col("m") * share).cast("int"))
    return annotated.groupBy("route").agg(median.alias("m")).where("m IS NOT NULL").select("route", whole(0.4, 5).alias("low"), whole(1.6, 30).alias("high"), whole(0.8, 10).alias("apart"))


def gradients(image: DataFrame, sizes: DataFrame, width: int = 5) -> DataFrame:
    """(route, x, y, gx, gy) of smoothed images where it isn't zero, by weights of 1, 2 and 1 across; borders mirror."""
    dark = shared.meet(extraction.smoothed(image, sizes, width, ("gray",)), sizes.select("route", "w", "h"), "route").select(*_PIXEL, "w", "h", (255 - F.col("gray")).alias("d")).where("d > 0")
    for axis, size in (("x", "w"), ("y", "h")):
        at, end = F.col(axis), F.col(size)
        dark = dark.withColumn(f"p{axis}", F.explode(F.array_distinct(F.array(at, -at, 2 * (end - 1) - at)))).where(F.col(f"p{axis}").between(-1, end))
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    spread = dark.withColumn("o", F.explode(around)).withColumn("x", F.col("px") + F.col("o.dx")).withColumn("y", F.col("py") + F.col("o.dy"))
    inside = spread.where("x BETWEEN 0 AND w - 1 AND y BETWEEN 0 AND h - 1")
    across = lambda a, b: F.sum(F.col("d") * F.col(a) * (2 - F.abs(F.col(b))))
    return inside.groupBy(*_PIXEL).agg(across("o.dx", "o.dy").alias("gx"), across("o.dy", "o.dx").alias("gy")).where("gx <> 0 OR gy <> 0")


def edges(slopes: DataFrame) -> DataFrame:
    """slopes where they are steepest along their direction and strong, or half as strong and hanging on such pixels.

    The direction is one of four; of equally steep neighbours the one to the left of, or above, the other counts."""
    gx, gy, m = F.col("gx"), F.col("gy"), F.abs("gx") + F.abs("gy")
    flat, steep = F.abs(gx) * 1000 > F.abs(gy) * 2414, F.abs(gy) * 1000 > F.abs(gx) * 2414
    ux = F.when(steep, 0).otherwise(1)
    uy = F.when(flat, 0).when(steep, 1).when(gx * gy > 0, 1).otherwise(-1)
    held = slopes.select(*_PIXEL, "gx", "gy", m.alias("m"), ux.alias("ux"), uy.alias("uy"))
    weak = held.where(F.col("m") * 2 > STRONG)
    before = held.select("route", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("m").alias("before"))
    after = held.select("route", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("m").alias("after"))
    weak = shared.meet(weak.withColumn("bx", F.col("x") - F.col("ux")).withColumn("by", F.col("y") - F.col("uy")), before, ["route", "bx", "by"], "left")
    weak = shared.meet(weak.withColumn("ax", F.col("x") + F.col("ux")).withColumn("ay", F.col("y") + F.col("uy")), after, ["route", "ax", "ay"], "left")
    thin = weak.where("m > coalesce(before, 0) AND m >= coalesce(after, 0)").select(*_PIXEL, "gx", "gy", "m")
    with shared.scratch():
        thin = shared.keep(thin, "edge-pixels")
        parts = raster.components(thin.select(*_PIXEL))
        strong = shared.meet(parts, thin.where(F.col("m") > STRONG), _PIXEL, "left_semi").select("route", "cx", "cy").distinct()
        hung = shared.meet(parts, strong, ["route", "cx", "cy"], "left_semi").select(*_PIXEL)
        return shared.keep(shared.meet(thin, hung, _PIXEL, "left_semi").select(*_PIXEL, "gx", "gy"), "edges", outer=True)


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5)


def votes(edge: DataFrame, sizes: DataFrame, window: DataFrame) -> DataFrame:
    """(route, x, y, votes): how many edge pixels may lie around a pixel, up or down their slope, at a radius of the window."""
    # what an edge pixel votes for is dealt with it
    held = shared.meet(shared.meet(shared.dealt(edge, 16), window.select("route", "low", "high"), "route"), sizes.select("route", "w", "h"), "route")
    steps = held.withColumn("k", F.explode(F.flatten(F.array(F.sequence(-F.col("high"), -F.col("low")), F.sequence("low", "high")))))
    length = F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))
    at = lambda c: _whole(F.col(c) + F.col("k") * F.col(f"g{c}") / length)
    cells = steps.select("route", "w", "h", at("x").alias("x"), at("y").alias("y")).where("x BETWEEN 0 AND w - 1 AND y BETWEEN 0 AND h - 1")
    return cells.groupBy(*_PIXEL).agg(F.count(F.lit(1)).alias("votes"))


def peaks(voted: DataFrame) -> DataFrame:
    """voted with more votes than LEAST_VOTES and than the pixels to the left and above, and no fewer than those to the right and below."""
    many = voted.where(F.col("votes") > LEAST_VOTES)
    sides = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for dx, dy, k in ((0, 0, 0), (1, 0, 1), (0, 1, 1), (-1, 0, 2), (0, -1, 2))])
    told = many.withColumn("o", F.explode(sides)).select("route", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("o.k").alias("k"), "votes")
    most = lambda k: F.max(F.when(F.col("k") == k, F.col("votes")))
    met = told.groupBy(*_PIXEL).agg(most(0).alias("votes"), F.coalesce(most(1), F.lit(0)).alias("less"), F.coalesce(most(2), F.lit(0)).alias("least"))
    return met.where("votes > less AND votes >= least").select(*_PIXEL, "votes")


def spaced(found: DataFrame, window: DataFrame) -> DataFrame:
    """found (route, x, y, votes) without those nearer than `apart` to one taken before, the most voted first, ties by x and y.

    A round takes all that no stronger one left is near to, over all images, and stores what they leave; near ones meet in
    cells. Peaks are local, so few of them are near to each other."""
    names = [*_PIXEL, "votes"]
    with shared.scratch():
        held = shared.keep(shared.meet(found, window.select("route", "apart"), "route"), "circle-peaks")
        placed = held.withColumn("gx", F.floor(F.col("x") / F.col("apart"))).withColumn("gy", F.floor(F.col("y") / F.col("apart")))
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        other = placed.select("route", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("votes").alias("ov"), "gx", "gy").withColumn("i", around).withColumn("j", around)
        other = other.withColumn("gx", F.col("gx") + F.col("i")).withColumn("gy", F.col("gy") + F.col("j")).drop("i", "j")
        near = shared.meet(placed, other, ["route", "gx", "gy"]).where("(x - ox) * (x - ox) + (y - oy) * (y - oy) < apart * apart AND (-votes, x, y) < (-ov, ox, oy)")
        near = shared.keep(near.select(*_PIXEL, "ox", "oy"), "circle-near")
        out, left = None, held.select(*names)
        while out is None or not left.isEmpty():
            live = shared.meet(near, left, _PIXEL, "left_semi")
            under = live.select("route", F.col("ox").alias("x"), F.col("oy").alias("y")).distinct()
            taken = shared.keep(shared.meet(left, under, _PIXEL, "left_anti"), "circle-taken", outer=True)
            out = taken if out is None else out.unionByName(taken)
            gone = shared.meet(near, taken, _PIXEL, "left_semi").select("route", F.col("ox").alias("x"), F.col("oy").alias("y"))
            left = shared.keep(shared.meet(shared.meet(left, taken, _PIXEL, "left_anti"), gone, _PIXEL, "left_anti"), "circle-left")
        return out


def circles(image: DataFrame, sizes: DataFrame, annotated: DataFrame) -> DataFrame:
    """(route, x, y, r, votes, n_edge): circles of images (route, x, y, gray); sizes(route, w, h), annotated(route, r).

    A centre's radius is the one of its window that most edge pixels have for their distance, in proportion to it, the
    smaller one if equal; LEAST_VOTES or fewer such pixels make no circle. Blank images have none."""
    window = windows(annotated)
    image = shared.keep(image.select(*_PIXEL, "gray"), "circle-images")
    edge = edges(gradients(image, sizes))
    centres = shared.meet(spaced(peaks(votes(edge, sizes, window)), window), window, "route")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    dealt = centres.withColumn("i", around).withColumn("j", around).withColumn("gx", F.floor(F.col("x") / F.col("high")) + F.col("i")).withColumn("gy", F.floor(F.col("y") / F.col("high")) + F.col("j"))
    rim = shared.meet(edge, window.select("route", "high"), "route").select("route", F.col("x").alias("ex"), F.col("y").alias("ey"), F.floor(F.col("x") / F.col("high")).alias("gx"), F.floor(F.col("y") / F.col("high")).alias("gy"))
    far = F.sqrt(((F.col("ex") - F.col("x")) * (F.col("ex") - F.col("x")) + (F.col("ey") - F.col("y")) * (F.col("ey") - F.col("y"))).cast("double"))
    rings = shared.meet(dealt, rim, ["route", "gx", "gy"]).select(*_PIXEL, "votes", "low", "high", _whole(far).alias("r")).where("r BETWEEN low AND high")
    counted = rings.groupBy(*_PIXEL, "votes", "r").agg(F.count(F.lit(1)).alias("n_edge"))
    best = F.max_by(F.struct("r", "n_edge"), F.struct(F.col("n_edge") / F.col("r"), -F.col("r")))
    return counted.groupBy(*_PIXEL, "votes").agg(best.alias("b")).select(*_PIXEL, "b.r", "votes", "b.n_edge").where(F.col("n_edge") > LEAST_VOTES)
