"""Routes against floor plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwalk.operators import scoring, spatial
from planwalk.plans.oracle import seg_dist
from planwalk.plans.registry import query
from planwalk.sources import bindings as b

#: Pixels within which a point counts as on the polyline.
TOLERANCE = 20.0


def _visited():
    """How many exhibits are visited (v), from rows by spatial.by_circle()."""
    return F.sum(F.when(~F.col("v"), F.lit(0)).when(F.col("own").isNull(), F.col("n")).otherwise(1))


def _shapes(spark, sf_dir):
    return spatial.layout_shapes(b.walls(spark, sf_dir), b.regions(spark, sf_dir))


def _seen(spark, sf_dir):
    return spatial.sightings(b.points(spark, sf_dir), spatial.alike(b.exhibits(spark, sf_dir)), _shapes(spark, sf_dir))


def _flags(spark, sf_dir):
    return spatial.point_flags(b.points(spark, sf_dir), _shapes(spark, sf_dir))


def _hit(spark, sf_dir):
    return spatial.near_circles(b.points(spark, sf_dir), spatial.alike(b.exhibits(spark, sf_dir)), 0)


def _violations(spark, sf_dir):
    return spatial.route_violations(_flags(spark, sf_dir), _hit(spark, sf_dir), b.regions(spark, sf_dir))


@query("pts exh wal wed seen", "SELECT layout, route, count(DISTINCT CASE WHEN kind = 'visit' THEN ex_id END) AS n_visited, count(*) FILTER (WHERE kind = 'collision') AS n_collisions, count(*) FILTER (WHERE kind = 'blocked') AS n_blocked FROM seen GROUP BY layout, route")
def visit_los(spark, sf_dir):
    pairs = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    per = _seen(spark, sf_dir).groupBy("layout", "route", spatial.by_circle(), "own").agg(F.bool_or(F.col("kind") == "visit").alias("v"), pairs("collision").alias("c"), pairs("blocked").alias("b"), F.max("n").alias("n"))
    return per.groupBy("layout", "route").agg(_visited().alias("n_visited"), F.sum("c").alias("n_collisions"), F.sum("b").alias("n_blocked"))


@query("pts exh wal wed seen", "SELECT layout, route, ex_id, bool_or(kind = 'visit') AS visited, round(min(CASE WHEN kind = 'visit' THEN dist END), 4) AS closest FROM seen GROUP BY layout, route, ex_id")
def exhibit_closest(spark, sf_dir):
    visit = F.col("kind") == "visit"
    per = _seen(spark, sf_dir).groupBy("layout", "route", spatial.by_circle(), "own").agg(F.bool_or(visit).alias("visited"), F.round(F.min(F.when(visit, F.col("dist"))), 4).alias("closest"))
    return spatial.each_exhibit(per, b.exhibits(spark, sf_dir)).select("layout", "route", "ex_id", "visited", "closest")


@query("pts exh", "SELECT p.layout, p.route, e.ex_id, count(*) AS n_points FROM pts p JOIN exh e ON p.layout = e.layout AND sqrt((p.x - e.cx) * (p.x - e.cx) + (p.y - e.cy) * (p.y - e.cy)) < e.r GROUP BY p.layout, p.route, e.ex_id")
def collisions(spark, sf_dir):
    per = _hit(spark, sf_dir).groupBy("layout", "route", spatial.by_circle(), "own").agg(F.sum(F.when(F.col("own").isNull(), F.lit(1)).otherwise(F.col("n"))).alias("n_points"))
    return spatial.each_exhibit(per, b.exhibits(spark, sf_dir)).select("layout", "route", "ex_id", "n_points")


@query("pts wal wed reg whit inr flags", "SELECT layout, route, i FROM flags WHERE outside")
def floor_violations(spark, sf_dir):
    return _flags(spark, sf_dir).where("outside").select("layout", "route", "i")


@query("pts wal wed whit", "SELECT layout, route, wall, count(*) AS n_points FROM whit GROUP BY layout, route, wall")
def wall_hits(spark, sf_dir):
    return _flags(spark, sf_dir).where("wall IS NOT NULL").groupBy("layout", "route", "wall").agg(F.count(F.lit(1)).alias("n_points"))


@query("pts wal wed reg whit inr flags", "SELECT layout, route, count(*) AS n_points FROM flags WHERE forbidden GROUP BY layout, route")
def forbidden_hits(spark, sf_dir):
    return _flags(spark, sf_dir).where("forbidden").groupBy("layout", "route").agg(F.count(F.lit(1)).alias("n_points"))


@query("pts reg inr", "SELECT layout, route, id AS gallery, cfg, count(*) AS n_points FROM inr WHERE kind = 'gallery' GROUP BY layout, route, id, cfg")
def gallery_visits(spark, sf_dir):
    seen = _flags(spark, sf_dir).select("layout", "route", F.explode("visited").alias("gallery")).groupBy("layout", "route", "gallery").agg(F.count(F.lit(1)).alias("n_points"))
    return seen.join(b.regions(spark, sf_dir).select("layout", F.col("id").alias("gallery"), F.coalesce("cfg", F.lit("normal")).alias("cfg")), ["layout", "gallery"])


@query("pts reg inr lost", "SELECT layout, route, id AS gallery FROM lost")
def must_see_missing(spark, sf_dir):
    return spatial.must_see_missing(_flags(spark, sf_dir), b.regions(spark, sf_dir)).withColumnRenamed("id", "gallery")


_TOTAL = "n_collision + n_forbidden + n_gallery + n_must_see + n_outside + n_wall"


@query("pts exh wal wed reg seen whit inr flags lost viol", f"SELECT layout, route, n_collision, n_forbidden, n_gallery, n_must_see, n_outside, n_wall, {_TOTAL} AS total, {_TOTAL} = 0 AS is_valid, concat_ws(',', CASE WHEN n_collision > 0 THEN 'collision' END, CASE WHEN n_forbidden > 0 THEN 'forbidden' END, CASE WHEN n_gallery > 0 THEN 'gallery' END, CASE WHEN n_must_see > 0 THEN 'must_see' END, CASE WHEN n_outside > 0 THEN 'outside' END, CASE WHEN n_wall > 0 THEN 'wall' END) AS reasons FROM viol")
def violation_summary(spark, sf_dir):
    return _violations(spark, sf_dir)


@query("pts exh wal wed reg whit inr flags", "SELECT layout, route, cls, count(*) AS n_points FROM (SELECT f.layout, f.route, CASE WHEN f.wall IS NOT NULL THEN 'wall' WHEN f.forbidden THEN 'forbidden' WHEN f.restricted THEN 'gallery' WHEN EXISTS (SELECT 1 FROM exh e WHERE e.layout = p.layout AND sqrt((p.x - e.cx) * (p.x - e.cx) + (p.y - e.cy) * (p.y - e.cy)) < e.r) THEN 'exhibit' WHEN f.outside THEN 'floor' ELSE 'valid' END AS cls FROM flags f JOIN pts p ON f.route = p.route AND f.i = p.i) GROUP BY layout, route, cls")
def point_classes(spark, sf_dir):
    hit = _hit(spark, sf_dir).select("layout", "route", "i").distinct().withColumn("hit", F.lit(True))
    flags = _flags(spark, sf_dir).join(hit, ["layout", "route", "i"], "left")
    return flags.groupBy("layout", "route", spatial.point_class(F.coalesce("hit", F.lit(False))).alias("cls")).agg(F.count(F.lit(1)).alias("n_points"))


_MM_PER_PX = 20.5


@query("pts exh wal wed reg seen whit inr flags lost viol seg", f"SELECT v.layout, v.route, n_wall > 0 AS wall_crossings, n_collision > 0 AS exhibit_collision, n_outside > 0 AS out_of_area_violations, n_must_see = 0 AS must_pass_regions, n_forbidden > 0 AS restricted_area_violations, s.len * CASE WHEN v.route % 3 > 0 THEN {_MM_PER_PX}::DOUBLE END < 200000 AS distance_budget, CASE WHEN v.route % 3 > 0 THEN CAST(trunc(1500 / {_MM_PER_PX}::DOUBLE) AS INT) ELSE 25 END AS reach_px FROM viol v LEFT JOIN (SELECT route, sum(sqrt((ax - bx) * (ax - bx) + (ay - ey) * (ay - ey))) AS len FROM seg GROUP BY route) s ON v.route = s.route")
def svr_scsr(spark, sf_dir):
    found = _violations(spark, sf_dir).join(spatial.polyline_length(b.points(spark, sf_dir)), ["layout", "route"], "left")
    scale = F.when(F.col("route") % 3 > 0, F.lit(_MM_PER_PX))
    return found.select("layout", "route", (F.col("n_wall") > 0).alias("wall_crossings"), (F.col("n_collision") > 0).alias("exhibit_collision"), (F.col("n_outside") > 0).alias("out_of_area_violations"), (F.col("n_must_see") == 0).alias("must_pass_regions"), (F.col("n_forbidden") > 0).alias("restricted_area_violations"), (F.col("length") * scale < 200000).alias("distance_budget"), spatial.reach_pixels(F.lit(1500.0), scale).alias("reach_px"))


@query("wal wed exh", "SELECT layout, min(lx) AS min_x, min(ly) AS min_y, max(hx) AS max_x, max(hy) AS max_y FROM (SELECT layout, ax AS lx, ay AS ly, ax AS hx, ay AS hy FROM wed UNION ALL SELECT layout, cx - r, cy - r, cx + r, cy + r FROM exh) GROUP BY layout")
def museum_bounds(spark, sf_dir):
    return spatial.bounds(b.walls(spark, sf_dir), b.exhibits(spark, sf_dir))


@query("pts reg exh", "SELECT p.layout, p.route, coalesce(p.sx BETWEEN r.x AND r.x + r.w AND p.sy BETWEEN r.y AND r.y + r.h, false) AS start_inside, coalesce(sqrt((p.ex - c.cx) * (p.ex - c.cx) + (p.ey - c.cy) * (p.ey - c.cy)) <= c.r, false) AS end_inside FROM (SELECT layout, route, arg_min(x, i) AS sx, arg_min(y, i) AS sy, arg_max(x, i) AS ex, arg_max(y, i) AS ey FROM pts GROUP BY layout, route) p LEFT JOIN (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY layout ORDER BY id) = 1) r ON p.layout = r.layout LEFT JOIN (SELECT layout, ex_id, cx, cy, r * 20 AS r FROM exh QUALIFY row_number() OVER (PARTITION BY layout ORDER BY ex_id) = 1) c ON p.layout = c.layout")
def start_end(spark, sf_dir):
    return spatial.start_end(b.points(spark, sf_dir), b.regions(spark, sf_dir), b.exhibits(spark, sf_dir).withColumn("r", F.col("r") * 20))


@query("pts reg", "SELECT p.layout, p.route, arg_min(r.id, struct_pack(d := sqrt((p.sx - (r.x + r.w / 2)) * (p.sx - (r.x + r.w / 2)) + (p.sy - (r.y + r.h / 2)) * (p.sy - (r.y + r.h / 2))), id := r.id)) AS start_region, arg_min(r.id, struct_pack(d := sqrt((p.ex - (r.x + r.w / 2)) * (p.ex - (r.x + r.w / 2)) + (p.ey - (r.y + r.h / 2)) * (p.ey - (r.y + r.h / 2))), id := r.id)) AS end_region FROM (SELECT layout, route, arg_min(x, i) AS sx, arg_min(y, i) AS sy, arg_max(x, i) AS ex, arg_max(y, i) AS ey FROM pts GROUP BY layout, route) p JOIN reg r ON p.layout = r.layout GROUP BY p.layout, p.route")
def nearest_region(spark, sf_dir):
    return spatial.nearest_region(b.points(spark, sf_dir), b.regions(spark, sf_dir))


@query("pts seg", "SELECT layout, route, round(sum(sqrt((ax - bx) * (ax - bx) + (ay - ey) * (ay - ey))), 4) AS length FROM seg GROUP BY layout, route")
def polyline_length(spark, sf_dir):
    return spatial.polyline_length(b.points(spark, sf_dir)).withColumn("length", F.round("length", 4))


def _line(points):
    """The polyline through every fourth point of a route."""
    return spatial.segments(points.where("i % 4 = 0"))


_LINE = "line AS (SELECT * FROM (SELECT layout, route, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by FROM pts WHERE i % 4 = 0 WINDOW w AS (PARTITION BY route ORDER BY i)) WHERE bx IS NOT NULL), near AS (SELECT p.layout, p.route, p.i, min(" + seg_dist("p.x", "p.y", "l.ax", "l.ay", "l.bx", "l.by") + ") AS d FROM pts p LEFT JOIN line l ON p.route = l.route GROUP BY p.layout, p.route, p.i), fid AS (SELECT layout, route, round(100.0::DOUBLE * count(*) FILTER (WHERE d <= 20) / nullif(count(d), 0), 2) AS similarity, round(avg(d), 3) AS mean_deviation, round(max(d), 3) AS max_deviation, count(*) AS n_points, count(*) FILTER (WHERE d <= 20) AS n_within FROM near GROUP BY layout, route)"


def _fidelity(spark, sf_dir):
    points = b.points(spark, sf_dir)
    return spatial.fidelity(points, _line(points), TOLERANCE)


@query("pts", f"WITH {_LINE} SELECT * FROM fid")
def fidelity(spark, sf_dir):
    return _fidelity(spark, sf_dir)


def _by_model(spark, sf_dir):
    return _fidelity(spark, sf_dir).selectExpr("concat('m', route % 5) AS model", "concat('d', route div 5 % 3) AS difficulty", "CASE WHEN route % 7 > 0 THEN similarity END AS similarity")


_BY_MODEL = _LINE + ", bm AS (SELECT 'm' || (route % 5) AS model, 'd' || (route // 5 % 3) AS difficulty, CASE WHEN route % 7 > 0 THEN similarity END AS similarity FROM fid)"


@query("pts", f"WITH {_BY_MODEL} SELECT model, CASE WHEN grouping(difficulty) = 1 THEN 'All' ELSE difficulty END AS difficulty, round(avg(similarity), 4) AS mean, count(similarity) AS n_found, count(*) FILTER (WHERE similarity IS NULL) AS n_skipped FROM bm GROUP BY GROUPING SETS ((model, difficulty), (model))")
def fidelity_micro(spark, sf_dir):
    return scoring.micro_average(_by_model(spark, sf_dir), "similarity")


@query("pts", f"WITH {_BY_MODEL} SELECT difficulty, round(avg(m), 4) AS mean, count(m) AS n_models FROM (SELECT model, difficulty, avg(similarity) AS m FROM bm GROUP BY model, difficulty) GROUP BY difficulty")
def fidelity_macro(spark, sf_dir):
    return scoring.macro_average(_by_model(spark, sf_dir), "similarity")


@query("pts seg", "WITH dots AS (SELECT DISTINCT layout, route, i, CAST(floor(ax + (bx - ax) * k / CAST(n AS DOUBLE) + 0.5) AS BIGINT) AS x, CAST(floor(ay + (ey - ay) * k / CAST(n AS DOUBLE) + 0.5) AS BIGINT) AS y FROM (SELECT *, greatest(abs(bx - ax), abs(ey - ay), 1) AS n, unnest(range(0, greatest(abs(bx - ax), abs(ey - ay), 1) + 1)) AS k FROM seg)) SELECT layout, route, i, count(DISTINCT (x + dx) * 10000 + y + dy) AS n_pixels FROM dots CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS dx) CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS dy) WHERE dx * dx + dy * dy <= 6 GROUP BY layout, route, i")
def rasterised_strokes(spark, sf_dir):
    """Pixels of every stroke of each route."""
    return spatial.stroke_pixels(b.points(spark, sf_dir))


@query("pts seg", "WITH dots AS (SELECT DISTINCT route, layout, CAST(floor(ax + (bx - ax) * k / CAST(n AS DOUBLE) + 0.5) AS BIGINT) AS x, CAST(floor(ay + (ey - ay) * k / CAST(n AS DOUBLE) + 0.5) AS BIGINT) AS y FROM (SELECT *, greatest(abs(bx - ax), abs(ey - ay), 1) AS n, unnest(range(0, greatest(abs(bx - ax), abs(ey - ay), 1) + 1)) AS k FROM seg)), ink AS (SELECT DISTINCT layout, route, x + dx AS x, y + dy AS y FROM dots CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS dx) CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS dy) WHERE dx * dx + dy * dy <= 6) SELECT layout, route, count(*) AS n_pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM ink GROUP BY layout, route")
def rasterised_routes(spark, sf_dir):
    """Pixels of each whole route."""
    many = F.col("high") - F.col("low") + 1
    runs = spatial.ink_runs(b.points(spark, sf_dir)).select("layout", "route", many.alias("n"), F.expr("(low + high) * (high - low + 1) div 2").alias("sx"), (F.col("y") * many).alias("sy"))
    return runs.groupBy("layout", "route").agg(F.sum("n").alias("n_pixels"), F.sum("sx").alias("sum_x"), F.sum("sy").alias("sum_y"))


def _zones(spark, sf_dir):
    """Entrances and exits of all shapes, a layout's first region as rectangle, circle, polygon or an unknown shape by turns."""
    r = b.regions(spark, sf_dir)
    shapes = F.array(*[F.lit(x) for x in ("rectangle", "circle", "polygon", "star")])
    near = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0, 0), (250, 20), (200, 300), (-20, 150))])
    at = lambda turn: F.get(shapes, ((F.col("layout") + turn) % 4).cast("int")).alias("shape")
    made = [r.select("layout", F.lit(role).alias("role"), "id", at(turn), "x", "y", "w", "h", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("w").alias("r"), near.alias("points")) for turn, role in enumerate(("entrance", "exit"))]
    return made[0].unionByName(made[1])


_ENDS = "SELECT layout, route, arg_min(x, i) AS sx, arg_min(y, i) AS sy, CASE WHEN route % 9 > 0 THEN arg_max(x, i) END AS ex, CASE WHEN route % 9 > 0 THEN arg_max(y, i) END AS ey FROM pts GROUP BY layout, route"
_CORNERS = "(VALUES (0, 0, 250, 20), (250, 20, 200, 300), (200, 300, -20, 150), (-20, 150, 0, 0)) AS c(a, b, c, d)"


def _lost(x: str, y: str, turn: int) -> str:
    ray = f"(z.y + b > {y}) <> (z.y + d > {y}) AND {x} < (c - a) * ({y} - (z.y + b)) / CAST(d - b AS DOUBLE) + z.x + a"
    polygon = f"(SELECT count(*) FILTER (WHERE {ray}) % 2 = 1 OR min({seg_dist(x, y, '(z.x + a)', '(z.y + b)', '(z.x + c)', '(z.y + d)')}) <= 2 FROM {_CORNERS})"
    kind = f"(e.layout + {turn}) % 4"
    return f"({x} IS NULL OR NOT coalesce(CASE {kind} WHEN 0 THEN {x} BETWEEN z.x AND z.x + z.w AND {y} BETWEEN z.y AND z.y + z.h WHEN 1 THEN sqrt(({x} - z.x) * ({x} - z.x) + ({y} - z.y) * ({y} - z.y)) <= z.w WHEN 2 THEN {polygon} END, true))"


@query("pts reg", f"WITH ends AS ({_ENDS}), z AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY layout ORDER BY id) = 1) SELECT *, NOT entrance_violation AND NOT exit_violation AS start_end_ok FROM (SELECT e.layout, e.route, {_lost('e.sx', 'e.sy', 0)} AS entrance_violation, {_lost('e.ex', 'e.ey', 1)} AS exit_violation FROM ends e JOIN z ON e.layout = z.layout)")
def zone_ends(spark, sf_dir):
    """Starts and ends against zones of every shape; every ninth route has no end."""
    ends = b.points(spark, sf_dir).groupBy("layout", "route").agg(F.min_by(F.struct("x", "y"), "i").alias("s"), F.max_by(F.struct("x", "y"), "i").alias("e"))
    last = F.when(F.col("route") % 9 > 0, F.col("e"))
    ends = ends.select("layout", "route", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), last["x"].alias("ex"), last["y"].alias("ey"))
    return spatial.ends_in_zones(ends, _zones(spark, sf_dir))


def _reach():
    """A task's viewing distance in pixels; every third route's plan has no scale."""
    return spatial.reach_pixels(1000 + F.col("route") % 4 * 250, F.when(F.col("route") % 3 > 0, F.lit(_MM_PER_PX)))


@query("pts exh wal wed seer", "SELECT layout, route, reach, count(DISTINCT CASE WHEN kind = 'visit' THEN ex_id END) AS n_visited FROM seer GROUP BY layout, route, reach")
def visits_by_reach(spark, sf_dir):
    """Exhibits visited at each task's own viewing distance."""
    points = b.points(spark, sf_dir).withColumn("reach", _reach())
    seen = spatial.sightings(points, spatial.alike(b.exhibits(spark, sf_dir)), _shapes(spark, sf_dir), "reach")
    per = seen.groupBy("layout", "route", "reach", spatial.by_circle(), "own").agg(F.bool_or(F.col("kind") == "visit").alias("v"), F.max("n").alias("n"))
    return per.groupBy("layout", "route", "reach").agg(_visited().alias("n_visited"))


_CENTRE = "CASE (layout + {1}) % 4 WHEN 0 THEN {0} + {2} / 2 WHEN 1 THEN {0} ELSE {0} + {3}::DOUBLE END"


@query("reg", f"WITH z AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY layout ORDER BY id) = 1) SELECT layout, 'entrance' AS role, CAST({_CENTRE.format('x', 0, 'w', 107.5)} AS DOUBLE) AS x, CAST({_CENTRE.format('y', 0, 'h', 117.5)} AS DOUBLE) AS y FROM z UNION ALL SELECT layout, 'exit', CAST({_CENTRE.format('x', 1, 'w', 107.5)} AS DOUBLE), CAST({_CENTRE.format('y', 1, 'h', 117.5)} AS DOUBLE) FROM z")
def zone_centres(spark, sf_dir):
    return spatial.zone_centres(_zones(spark, sf_dir))
