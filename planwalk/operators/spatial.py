"""Routes against annotated floor plans, for any number of layouts and routes in one plan.

Points are rows (layout, route, i, x, y). Exhibits are circles (layout, ex_id, cx, cy, r) and may be many: they meet
points in an equi-join on grid cells. A layout's other annotations (walls, rectangles) are few and travel as arrays in
one row a layout, so a point is tested against all of them without multiplying rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.functions import geometry as g
from planwalk.plans import shared

#: Distance beyond an exhibit's edge from which it can be seen, when a task's scale is unknown.
DEFAULT_REACH = 25
CELL = 32
#: Most rows of circles in cells that every task gets whole where pairs are to stay with their route.
MOST_TOLD = 1_000_000


def layout_shapes(walls: DataFrame, regions: DataFrame) -> DataFrame:
    """One row a layout: walls, floors, forbidden, galleries as arrays in the order of their ids.

    walls(layout, wall, points) with points array<struct<x, y>>; regions(layout, id, kind, x, y, w, h, cfg).
    """
    outline = g.edges(F.col("points")).alias("outline")
    sides = [fn(F.col("points")[c]).alias(n) for n, fn, c in (("lx", F.array_min, "x"), ("hx", F.array_max, "x"), ("ly", F.array_min, "y"), ("hy", F.array_max, "y"))]
    outlines = walls.groupBy("layout").agg(F.sort_array(F.collect_list(F.struct("wall", *sides, outline))).alias("walls"))
    rect = F.struct("id", "x", "y", "w", "h", F.coalesce("cfg", F.lit("normal")).alias("cfg"))
    rects = regions.groupBy("layout").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, rect))).alias(n) for k, n in (("floor", "floors"), ("forbidden", "forbidden"), ("gallery", "galleries"))])
    return outlines.join(rects, "layout", "full_outer").select("layout", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in {**dict(outlines.dtypes), **dict(rects.dtypes)}.items() if c != "layout"])


def _near_box(x: Column, y: Column, box: Column, reach: Column | int) -> Column:
    return x.between(box["lx"] - reach, box["hx"] + reach) & y.between(box["ly"] - reach, box["hy"] + reach)


def near_circles(points: DataFrame, circles: DataFrame, reach: float | str, cell: int = CELL, stay: bool = False) -> DataFrame:
    """points x circles of one layout closer than r + reach, with their distance `dist`; reach may name a column of points.

    Each circle is copied to the grid cells that its reach touches, once for each reach of its layout; a point lies in
    one cell, so no pair appears twice. stay: points aren't dealt anew to meet circles, if these are few enough to be told to
    every task, so that what then groups points dealt by route moves no pair.
    """
    keys = ["layout", "gx", "gy"]
    if isinstance(reach, str):
        keys.append(reach)
        circles = circles.join(points.select("layout", reach).distinct(), "layout")
        wide = F.col("r") + F.col(reach)
    else:
        wide = F.col("r") + reach
    span = lambda c: F.sequence(F.floor((F.col(c) - wide) / cell), F.floor((F.col(c) + wide) / cell))
    dealt = circles.withColumn("gx", F.explode(span("cx"))).withColumn("gy", F.explode(span("cy")))
    if stay and dealt.count() <= MOST_TOLD:
        dealt = dealt.hint("broadcast")
    placed = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    pairs = placed.join(dealt, keys).drop("gx", "gy")
    return pairs.withColumn("dist", g.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))).where(F.col("dist") < wide)


def sightings(points: DataFrame, circles: DataFrame, shapes: DataFrame, reach: float | str = DEFAULT_REACH, stay: bool = False) -> DataFrame:
    """Each close pair of point and exhibit with `kind`: collision (inside the circle), visit, or blocked by a wall.

    A colliding point never counts as a visit. A point brings the outline edges that a line of the greatest length from it
    can meet; most have none, so few pairs are tested against edges. stay: as in near_circles()."""
    farthest = circles.groupBy("layout").agg(F.max("r").alias("far_"))
    held = shapes.select("layout", "walls").join(farthest, "layout", "left")
    x, y, far = F.col("x"), F.col("y"), F.col("far_") + (F.col(reach) if isinstance(reach, str) else reach)
    edges = F.flatten(F.transform(F.filter("walls", lambda w: _near_box(x, y, w, far)), lambda w: w["outline"]))
    close = F.filter(edges, lambda e: x.between(F.least(e["a"]["x"], e["b"]["x"]) - far, F.greatest(e["a"]["x"], e["b"]["x"]) + far) & y.between(F.least(e["a"]["y"], e["b"]["y"]) - far, F.greatest(e["a"]["y"], e["b"]["y"]) + far))
    placed = points.join(held, "layout", "left").select(*points.columns, close.alias("edges_"))
    free = near_circles(placed.where("coalesce(size(edges_), 0) = 0").drop("edges_"), circles, reach, stay=stay).withColumn("hidden_", F.lit(False))
    shut = near_circles(placed.where("size(edges_) > 0"), circles, reach, stay=stay)
    shut = shut.withColumn("hidden_", g.crosses_outline(x, y, F.col("cx"), F.col("cy"), F.col("edges_"))).drop("edges_")
    kind = F.when(F.col("dist") < F.col("r"), "collision").when(F.coalesce("hidden_", F.lit(False)), "blocked").otherwise("visit")
    return free.unionByName(shut).withColumn("kind", kind).drop("hidden_")


def marked(circles: DataFrame) -> DataFrame:
    """circles with `own`: the ex_id of an exhibit that its layout lists several times, else null."""
    return circles.withColumn("own", F.when(F.count(F.lit(1)).over(Window.partitionBy("layout", "ex_id")) > 1, F.col("ex_id")))


def alike(circles: DataFrame) -> DataFrame:
    """(layout, cx, cy, r, own, n): n equal circles as one, so that points meet each different circle once; see marked().

    What is found for a circle holds for its n exhibits, or for the exhibit `own`; each_exhibit() names them."""
    return marked(circles).groupBy("layout", "cx", "cy", "r", "own").agg(F.count(F.lit(1)).alias("n"))


def spots(circles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layout, cx, cy, r, spot, n) and (spot, ex_id): different circles, numbered, and the exhibits that each stands for.

    Who sees a spot sees its n exhibits. An exhibit that is listed several times, in whatever layouts, is one spot of all its
    circles, so an exhibit belongs to one spot only."""
    listed = circles.withColumn("own", F.when(F.count(F.lit(1)).over(Window.partitionBy("ex_id")) > 1, F.col("ex_id")))
    at = ["layout", "cx", "cy", "r"]
    single, own = listed.where("own IS NULL"), listed.where("own IS NOT NULL")
    every = single.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.lit(None).cast(circles.schema["ex_id"].dataType))
    every = every.unionByName(own.select("own").distinct().withColumn("n", F.lit(1)), allowMissingColumns=True)
    every = shared.keep(every.withColumn("spot", F.monotonically_increasing_id()), "spots", outer=True)
    alone, named = every.where("own IS NULL").drop("own"), every.where("own IS NOT NULL").select("own", "spot", "n")
    shown = alone.select(*at, "spot", "n").unionByName(shared.meet(own.select(*at, "own"), named, "own").select(*at, "spot", "n"))
    members = shared.meet(single.select(*at, "ex_id"), alone.select(*at, "spot"), at).select("spot", "ex_id")
    return shown, members.unionByName(named.select("spot", F.col("own").alias("ex_id")))


def by_circle() -> Column:
    """Of pairs with circles of alike(): what to group by for one row an exhibit or n alike ones; null if `own` tells it."""
    return F.when(F.col("own").isNull(), F.struct("cx", "cy", "r")).alias("circle")


def each_exhibit(per: DataFrame, circles: DataFrame) -> DataFrame:
    """per(layout, circle, own, ...), grouped by by_circle(), as a row for each exhibit: layout, ex_id and the other columns."""
    more = [c for c in per.columns if c not in ("layout", "circle", "own")]
    single = marked(circles).where("own IS NULL").select("layout", "cx", "cy", "r", "ex_id")
    told = per.where("own IS NULL").select("layout", "circle.*", *more).join(single, ["layout", "cx", "cy", "r"]).select("layout", "ex_id", *more)
    return told.unionByName(per.where("own IS NOT NULL").select("layout", F.col("own").alias("ex_id"), *more))


def exhibit_visits(seen: DataFrame) -> DataFrame:
    """(layout, route, ex_id, visited, closest): whether a route visits an exhibit, and its least distance in a visit; null if none."""
    visit = F.col("kind") == "visit"
    return seen.groupBy("layout", "route", "ex_id").agg(F.bool_or(visit).alias("visited"), F.min(F.when(visit, F.col("dist"))).alias("closest"))


def point_flags(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """points with what each breaks or visits: outside, wall (the first one's id), forbidden, visited (gallery ids), restricted."""
    x, y = F.col("x"), F.col("y")
    inside = lambda rect: g.in_rectangle(x, y, rect)
    placed = points.join(shapes, "layout", "left")
    galleries = F.filter("galleries", inside)
    return placed.select(
        *points.columns,
        (~F.coalesce(F.exists("floors", inside), F.lit(False))).alias("outside"),
        F.get(F.filter("walls", lambda w: _near_box(x, y, w, g.EDGE_TOLERANCE) & g.in_polygon(x, y, w["outline"])), F.lit(0))["wall"].alias("wall"),
        F.coalesce(F.exists("forbidden", inside), F.lit(False)).alias("forbidden"),
        F.transform(galleries, lambda r: r["id"]).alias("visited"),
        F.exists(galleries, lambda r: r["cfg"] == "restricted").alias("restricted"),
    )


def must_see_missing(flags: DataFrame, regions: DataFrame) -> DataFrame:
    """(layout, route, id) of must-see galleries in which a route has no point."""
    wanted = regions.where("kind = 'gallery' AND cfg = 'must_see'").select("layout", "id")
    routes = flags.select("layout", "route").distinct()
    seen = flags.select("layout", "route", F.explode("visited").alias("id")).distinct()
    return routes.join(wanted, "layout").join(seen, ["layout", "route", "id"], "left_anti")


def point_class(collides: Column) -> Column:
    """The first that holds of wall, forbidden, gallery, exhibit, floor, else valid."""
    return F.when(F.col("wall").isNotNull(), "wall").when(F.col("forbidden"), "forbidden").when(F.col("restricted"), "gallery").when(collides, "exhibit").when(F.col("outside"), "floor").otherwise("valid")


def _counted(flags: DataFrame, collisions: DataFrame, *more: Column) -> DataFrame:
    per = flags.groupBy("layout", "route").agg(F.count_if("outside").alias("n_outside"), F.count("wall").alias("n_wall"), F.count_if("forbidden").alias("n_forbidden"), F.count_if("restricted").alias("n_gallery"), *more)
    many = F.sum("n") if "n" in collisions.columns else F.count(F.lit(1))
    hit = collisions.groupBy("layout", "route").agg(many.alias("n_collision"))
    return per.join(hit, ["layout", "route"], "left").fillna(0, ["n_collision"])


def _summed(every: DataFrame) -> DataFrame:
    kinds = ["collision", "forbidden", "gallery", "must_see", "outside", "wall"]
    total = sum((F.col(f"n_{k}") for k in kinds[1:]), F.col("n_collision"))
    reasons = F.concat_ws(",", *[F.when(F.col(f"n_{k}") > 0, k) for k in kinds])
    return every.select("layout", "route", *[f"n_{k}" for k in kinds], total.alias("total"), (total == 0).alias("is_valid"), reasons.alias("reasons"))


def violations(flags: DataFrame, seen: DataFrame, missing: DataFrame) -> DataFrame:
    """(layout, route, n_outside, n_wall, n_collision, n_forbidden, n_gallery, n_must_see, total, is_valid, reasons), from
    `point_flags`, `sightings` and `must_see_missing`, where these are there anyway."""
    lost = missing.groupBy("layout", "route").agg(F.count(F.lit(1)).alias("n_must_see"))
    return _summed(_counted(flags, seen.where("kind = 'collision'")).join(lost, ["layout", "route"], "left").fillna(0, ["n_must_see"]))


def route_violations(flags: DataFrame, collisions: DataFrame, regions: DataFrame) -> DataFrame:
    """The result of `violations` in one pass over the flags, without sight lines.

    collisions: a row (layout, route, ...) for each pair of a point and an exhibit that it lies in, or n of them with a column n."""
    wanted = regions.where("kind = 'gallery' AND cfg = 'must_see'").groupBy("layout").agg(F.collect_set("id").alias("must_see"))
    every = _counted(flags, collisions, F.flatten(F.collect_set("visited")).alias("seen")).join(wanted, "layout", "left")
    return _summed(every.withColumn("n_must_see", F.coalesce(F.size(F.array_except("must_see", "seen")).cast("bigint"), F.lit(0))))


def segments(points: DataFrame) -> DataFrame:
    """Consecutive points of each route as (layout, route, i, ax, ay, bx, by)."""
    path = Window.partitionBy("layout", "route").orderBy("i")
    ends = points.select("layout", "route", "i", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(path).alias("bx"), F.lead("y").over(path).alias("by"))
    return ends.where("bx IS NOT NULL")


def polyline_length(points: DataFrame) -> DataFrame:
    return segments(points).groupBy("layout", "route").agg(F.sum(g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("length"))


#: Width of the first cells in which points look for segments; how much wider the next ones are.
NEAR_CELL, WIDER = 16, 4
#: Most segments of a route that meet its points as one array.
FEW_SEGMENTS = 64


def _around_cells(lines: DataFrame, cell: float) -> DataFrame:
    """lines with gx, gy: a row for each cell that a segment crosses or that borders on such a cell."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    low, high = F.least(ax, bx), F.greatest(ax, bx)
    columns = lines.withColumn("gx", F.explode(F.sequence(F.floor(low / cell) - 1, F.floor(high / cell) + 1)))
    # the part of the segment in this column of cells and its two neighbours, a little longer than it is
    at = lambda x: F.when(ax == bx, None).otherwise(ay + (by - ay) * (x - ax) / F.nullif(bx - ax, F.lit(0)))
    y1, y2 = at(F.greatest(low, (F.col("gx") - 1) * cell)), at(F.least(high, (F.col("gx") + 2) * cell))
    down, up = F.least(F.coalesce(y1, ay), F.coalesce(y2, by)) - 1e-6 * cell, F.greatest(F.coalesce(y1, ay), F.coalesce(y2, by)) + 1e-6 * cell
    return columns.withColumn("gy", F.explode(F.sequence(F.floor(down / cell) - 1, F.floor(up / cell) + 1)))


def nearest_segment(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(layout, route, i, d): each point's distance to the nearest segment of its route, null if the route has none.

    lines(layout, route, ax, ay, bx, by). A route of at most FEW_SEGMENTS meets its points as one array, and no row is
    multiplied. Points and segments of longer routes meet in cells: see _nearest_in_cells()."""
    keys = ["layout", "route"]
    counted = lines.select(*keys, "ax", "ay", "bx", "by").withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    held = counted.groupBy(*keys).agg(F.max("n_").alias("n_"), F.collect_list(F.when(F.col("n_") <= FEW_SEGMENTS, F.struct("ax", "ay", "bx", "by"))).alias("lines_"))
    far = F.array_min(F.transform("lines_", lambda s: g.segment_distance(F.col("x"), F.col("y"), s["ax"], s["ay"], s["bx"], s["by"])))
    # not broadcast: what is told of a route is as large as all routes together
    met = points.select(*keys, "i", "x", "y").join(held.hint("merge"), keys, "left")
    out = met.where(F.coalesce("n_", F.lit(0)) <= FEW_SEGMENTS).select(*keys, "i", far.cast("double").alias("d"))
    many = counted.where(F.col("n_") > FEW_SEGMENTS)
    if many.isEmpty():
        return out
    return out.unionByName(_nearest_in_cells(points.join(many.select(*keys).distinct(), keys, "left_semi"), many))


def _nearest_in_cells(points: DataFrame, lines: DataFrame) -> DataFrame:
    """nearest_segment() of routes that all have segments.

    A point sees what crosses its cell or a neighbour, so what it finds within a cell's width is the nearest. Points that
    find nothing so near look again in cells WIDER times as wide, and so on until a cell is as wide as everything. What a
    round leaves open is stored. A segment is told to many cells, so Spark mustn't take it for a small table to broadcast."""
    keys = ["layout", "route"]
    one, other = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first(), lines.agg(F.min(F.least("ax", "bx")), F.max(F.greatest("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ay", "by"))).first()
    ends = [(x, y) for x, y in zip(one, other) if x is not None and y is not None]
    wide = max((max(*b) - min(*a) for a, b in (ends[:2], ends[2:])), default=0) if len(ends) == 4 else 0
    far = g.segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    out, rest, cell, last = None, points.select(*keys, "i", "x", "y"), NEAR_CELL, False
    with shared.scratch():
        while not last:
            last = cell >= wide
            placed = rest.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
            met = placed.join(_around_cells(lines.select(*keys, "ax", "ay", "bx", "by"), cell).hint("merge"), [*keys, "gx", "gy"], "left")
            near = met.groupBy(*keys, "i", "x", "y").agg(F.min(F.when(F.col("ax").isNotNull(), far)).alias("d"))
            near = shared.keep(near, "nearest-segment", outer=True)
            settled = F.col("d").isNotNull() & (F.lit(last) | (F.col("d") <= cell))
            found = near.where(settled).select(*keys, "i", "d")
            out = found if out is None else out.unionByName(found)
            rest = near.where(~settled).drop("d")
            last = last or rest.isEmpty()
            cell *= WIDER
    return out


def fidelity(points: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """How close a route's points lie to its polyline(s) `lines` (as `segments` gives them): share within tolerance in
    percent, mean and largest deviation, counts. A route without a line has null figures. See nearest_segment()."""
    return nearest_segment(points, lines).groupBy("layout", "route").agg(
        F.round(100.0 * F.count_if(F.col("d") <= tolerance) / F.nullif(F.count("d"), F.lit(0)), 2).alias("similarity"),
        F.round(F.avg("d"), 3).alias("mean_deviation"),
        F.round(F.max("d"), 3).alias("max_deviation"),
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(F.col("d") <= tolerance).alias("n_within"),
    )


def bounds(walls: DataFrame, circles: DataFrame) -> DataFrame:
    """(layout, min_x, min_y, max_x, max_y) over wall points and exhibit circles."""
    corners = walls.select("layout", F.explode("points").alias("p")).select("layout", F.col("p.x").alias("lx"), F.col("p.y").alias("ly"), F.col("p.x").alias("hx"), F.col("p.y").alias("hy"))
    round_ = circles.select("layout", (F.col("cx") - F.col("r")).alias("lx"), (F.col("cy") - F.col("r")).alias("ly"), (F.col("cx") + F.col("r")).alias("hx"), (F.col("cy") + F.col("r")).alias("hy"))
    return corners.unionByName(round_).groupBy("layout").agg(F.min("lx").alias("min_x"), F.min("ly").alias("min_y"), F.max("hx").alias("max_x"), F.max("hy").alias("max_y"))


def start_end(points: DataFrame, entrance: DataFrame, exit_: DataFrame) -> DataFrame:
    """(layout, route, start_inside, end_inside): whether a route's first point is in the layout's first entrance
    (a rectangle) and its last in its first exit (a circle); false where there is none."""
    ends = points.groupBy("layout", "route").agg(F.min_by(F.struct("x", "y"), "i").alias("s"), F.max_by(F.struct("x", "y"), "i").alias("e"))
    rect = entrance.groupBy("layout").agg(F.min_by(F.struct("x", "y", "w", "h"), "id").alias("rect"))
    ring = exit_.groupBy("layout").agg(F.min_by(F.struct("cx", "cy", "r"), "ex_id").alias("ring"))
    held = ends.join(rect, "layout", "left").join(ring, "layout", "left")
    inside = g.in_rectangle(F.col("s.x"), F.col("s.y"), F.col("rect"))
    near = g.distance(F.col("e.x"), F.col("e.y"), F.col("ring.cx"), F.col("ring.cy")) <= F.col("ring.r")
    return held.select("layout", "route", F.coalesce(inside, F.lit(False)).alias("start_inside"), F.coalesce(near, F.lit(False)).alias("end_inside"))


def ends_in_zones(ends: DataFrame, zones: DataFrame) -> DataFrame:
    """(layout, route, entrance_violation, exit_violation, start_end_ok) of ends(layout, route, sx, sy, ex, ey).

    zones(layout, role, id, shape, x, y, w, h, cx, cy, r, points) with role `entrance` or `exit`; a layout's first one by id
    counts. A rectangle, circle or polygon must hold its end; another shape, or no zone, lets every end pass. A route
    without an end (null) violates."""

    def first(role: str) -> DataFrame:
        return zones.where(F.col("role") == role).groupBy("layout").agg(F.min_by(F.struct("shape", "x", "y", "w", "h", "cx", "cy", "r", g.edges(F.col("points")).alias("outline")), "id").alias(role))

    def lost(x: str, y: str, role: str) -> Column:
        px, py, z = F.col(x), F.col(y), F.col(role)
        inside = F.when(z["shape"] == "rectangle", g.in_rectangle(px, py, z)).when(z["shape"] == "circle", g.distance(px, py, z["cx"], z["cy"]) <= z["r"]).when(z["shape"] == "polygon", g.in_polygon(px, py, z["outline"]))
        return px.isNull() | ~F.coalesce(inside, F.lit(True))

    held = ends.join(first("entrance"), "layout", "left").join(first("exit"), "layout", "left")
    marked = held.select("layout", "route", lost("sx", "sy", "entrance").alias("entrance_violation"), lost("ex", "ey", "exit").alias("exit_violation"))
    return marked.withColumn("start_end_ok", ~F.col("entrance_violation") & ~F.col("exit_violation"))


def nearest_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(layout, route, start_region, end_region): the region whose centre is nearest to a route's first and last point; ties go to the smaller id."""
    ends = points.groupBy("layout", "route").agg(F.min_by(F.struct("x", "y"), "i").alias("s"), F.max_by(F.struct("x", "y"), "i").alias("e"))
    rects = regions.groupBy("layout").agg(F.collect_list(F.struct("id", "x", "y", "w", "h")).alias("rects"))

    def nearest(end: str) -> Column:
        at = F.col(end)
        return F.array_min(F.transform("rects", lambda r: F.struct(g.distance(at["x"], at["y"], r["x"] + r["w"] / 2, r["y"] + r["h"] / 2).alias("d"), r["id"].alias("id"))))["id"]

    return ends.join(rects, "layout").select("layout", "route", nearest("s").alias("start_region"), nearest("e").alias("end_region"))


def reach_pixels(see_mm: Column, mm_per_px: Column) -> Column:
    """Whole pixels of a viewing distance, cut off; DEFAULT_REACH without a scale."""
    return F.coalesce(F.when(mm_per_px > 0, (see_mm / mm_per_px).cast("int")), F.lit(DEFAULT_REACH))


#: Strokes that are drawn at a time.
STROKES = 500


def _runs(owner: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, row, low, high) with the runs of each owner's row put together where they meet."""
    if not len(row):
        return owner, row, low, high
    wide, tall = int(high.max() - low.min()) + 2, int(row.max() - row.min()) + 1
    if (int(owner.max()) + 1) * wide * tall < 2**62:
        order = np.argsort((owner * tall + (row - row.min())) * wide + (low - low.min()))
    else:
        order = np.lexsort((low, row, owner))
    owner, row, low, high = owner[order], row[order], low[order], high[order]
    other = np.append(True, (np.diff(owner) != 0) | (np.diff(row) != 0))
    shift = np.cumsum(other) * wide - low.min()
    far = np.maximum.accumulate(high + shift)
    begins = np.flatnonzero(other | np.append(True, (low + shift)[1:] > far[:-1] + 1))
    return owner[begins], row[begins], low[begins], (far - shift)[np.append(begins[1:], len(row)) - 1]


def _stroke_runs(owner: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """What strokes `width` pixels wide cover, as _runs()."""
    n = np.maximum(np.maximum(np.abs(bx - ax), np.abs(by - ay)), 1)
    many = n.astype(np.int64) + 1
    of = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    x, y = (np.floor(a[of] + (b - a)[of] * k / n[of] + 0.5).astype(np.int64) for a, b in ((ax, bx), (ay, by)))
    # dots side by side in a row are one run
    first = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(y) != 0) | (np.abs(np.diff(x)) > 1))[: len(of)])
    last = np.append(first[1:], len(of))[: len(first)] - 1
    low, high, y, owner = np.minimum(x[first], x[last]), np.maximum(x[first], x[last]), y[first], owner[of[first]]
    half = width // 2
    reach = [(dy, max(dx for dx in range(half + 1) if dx * dx + dy * dy <= half * half + half)) for dy in range(-half, half + 1)]
    return _runs(np.tile(owner, len(reach)), *(np.concatenate(c) for c in ([y + dy for dy, _ in reach], [low - r for _, r in reach], [high + r for _, r in reach])))


def _ends_of(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    return [table.column(c).to_numpy() if isinstance(table, pa.Table) else table.column(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")]


def ink_runs(points: DataFrame, width: int = 5) -> DataFrame:
    """(layout, route, y, low, high): the pixels of each route's polyline drawn `width` pixels wide, as disjoint runs of rows.

    A task draws one route at a time, some strokes after the others; its pixels are never rows."""
    strokes = segments(points).select("layout", "route", "ax", "ay", "bx", "by").dropna()

    def run(table: pa.Table) -> pa.Table:
        ends, held = _ends_of(table), (np.zeros(0, np.int64),) * 4
        for k in range(0, table.num_rows, STROKES):
            some = [c[k : k + STROKES] for c in ends]
            held = _runs(*(np.concatenate(c) for c in zip(held, _stroke_runs(np.zeros(len(some[0]), np.int64), *some, width))))
        _, row, low, high = held
        same = lambda c: pa.array([table.column(c)[0].as_py()] * len(row), table.schema.field(c).type)
        return pa.table({"layout": same("layout"), "route": same("route"), "y": row, "low": low, "high": high})

    kinds = {f.name: f.dataType.simpleString() for f in strokes.schema}
    return strokes.groupBy("layout", "route").applyInArrow(run, f"layout {kinds['layout']}, route {kinds['route']}, y bigint, low bigint, high bigint")


def rasterise(points: DataFrame, width: int = 5) -> DataFrame:
    """(layout, route, x, y): the distinct pixels of each route's polyline drawn `width` pixels wide."""
    return ink_runs(points, width).select("layout", "route", F.explode(F.sequence("low", "high")).alias("x"), "y")


def zone_centres(zones: DataFrame) -> DataFrame:
    """(layout, role, x, y): the centre of a layout's first zone of each role by id; zones as in `ends_in_zones`."""
    mid = g.centre(F.col("z.points"))
    x = F.when(F.col("z.shape") == "rectangle", F.col("z.x") + F.col("z.w") / 2).when(F.col("z.shape") == "circle", F.col("z.cx")).otherwise(mid["x"])
    y = F.when(F.col("z.shape") == "rectangle", F.col("z.y") + F.col("z.h") / 2).when(F.col("z.shape") == "circle", F.col("z.cy")).otherwise(mid["y"])
    first = zones.groupBy("layout", "role").agg(F.min_by(F.struct("shape", "x", "y", "w", "h", "cx", "cy", "points"), "id").alias("z"))
    return first.select("layout", "role", x.cast("double").alias("x"), y.cast("double").alias("y"))


def stroke_pixels(points: DataFrame, width: int = 5) -> DataFrame:
    """(layout, route, i, n_pixels): how many pixels the stroke from point i to the next one covers. Strokes are counted where they lie."""
    strokes = segments(points).select("layout", "route", "i", "ax", "ay", "bx", "by").dropna(subset=["ax", "ay", "bx", "by"])

    def run(batches):
        for batch in batches:
            ends, counts = _ends_of(batch), np.zeros(batch.num_rows, np.int64)
            for k in range(0, batch.num_rows, STROKES):
                some = [c[k : k + STROKES] for c in ends]
                owner, _, low, high = _stroke_runs(np.arange(k, k + len(some[0])), *some, width)
                np.add.at(counts, owner, high - low + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("layout", "route", "i")), pa.array(counts)], names=["layout", "route", "i", "n_pixels"])

    kinds = {f.name: f.dataType.simpleString() for f in strokes.schema}
    return strokes.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("layout", "route", "i")) + ", n_pixels bigint")
