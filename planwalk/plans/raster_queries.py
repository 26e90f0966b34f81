"""Routes as pixels, colours, and nearest vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwalk.operators import lines, raster
from planwalk.plans import pixel_sql as px
from planwalk.plans import shared
from planwalk.plans.registry import query
from planwalk.sources import bindings as b

#: Labels whose centres may be part of a plan.
MOST_LABELS = 256


@query("drawn bins", "SELECT * FROM bins")
def hsv_histogram(spark, sf_dir):
    return raster.histogram(b.colors(spark, sf_dir, False))


@query("drawn orig bins", "WITH rk AS (SELECT img, bin, cnt, cnt / CAST(sum(cnt) OVER (PARTITION BY img) AS DOUBLE) AS share, row_number() OVER (PARTITION BY img ORDER BY cnt DESC, bin) AS rank FROM bins), ok AS (SELECT img FROM rk WHERE rank = 1 AND share >= 0.1), ce AS (SELECT img, bin, cnt, share, rank, bin // 32 * 5 + 2.5::DOUBLE AS hc, bin % 32 // 4 * 32 + 16 AS sc, bin % 4 * 64 + 32 AS vc FROM rk WHERE cnt >= 5 AND img IN (SELECT img FROM ok)), pr AS (SELECT c.img, c.bin, c.cnt, c.share, c.rank, count(*) FILTER (WHERE abs(o.s - c.sc) <= 35 AND abs(o.v - c.vc) <= 50 AND CASE WHEN c.hc - 10 < 0 THEN o.h >= trunc(c.hc - 10) + 180 OR o.h <= trunc(c.hc + 10) WHEN c.hc + 10 > 179 THEN o.h >= trunc(c.hc - 10) OR o.h <= trunc(c.hc + 10) - 180 ELSE o.h BETWEEN trunc(c.hc - 10) AND trunc(c.hc + 10) END) / CAST(count(*) AS DOUBLE) AS presence FROM ce c JOIN orig o ON c.img = o.img WHERE c.sc >= 50 GROUP BY c.img, c.bin, c.cnt, c.share, c.rank) SELECT img, bin, cnt, round(share, 4) AS share FROM pr WHERE presence <= 0.01 QUALIFY row_number() OVER (PARTITION BY img ORDER BY rank) = 1")
def dominant_bin(spark, sf_dir):
    return raster.dominant_bin(b.colors(spark, sf_dir, False), b.colors(spark, sf_dir, True))


@query("pix nbr", "SELECT route, x, y FROM nbr GROUP BY route, x, y HAVING count(*) = 1")
def pixel_endpoints(spark, sf_dir):
    return raster.endpoints(b.pixels(spark, sf_dir))


_CLOSE = "WITH RECURSIVE walk AS (SELECT route, x, y, x * 1000 + y AS c FROM pix UNION SELECT n.route, n.nx, n.ny, w.c FROM walk w JOIN nbr n ON n.route = w.route AND n.x = w.x AND n.y = w.y), lab AS (SELECT route, x, y, min(c) // 1000 AS cx, min(c) % 1000 AS cy FROM walk GROUP BY route, x, y)"


@query("pix nbr", f"{_CLOSE}, fr AS (SELECT route, cx, cy, count(*) AS size, round(avg(x), 1) AS mid_x, round(avg(y), 1) AS mid_y FROM lab GROUP BY route, cx, cy) SELECT *, size < greatest(1, floor(max(size) OVER (PARTITION BY route) * 0.01)) AS is_noise FROM fr")
def pixel_components(spark, sf_dir):
    return raster.fragments(raster.components(b.pixels(spark, sf_dir)))


@query("pix nbr", f"{_CLOSE}, fr AS (SELECT route, cx, cy, count(*) AS size FROM lab GROUP BY route, cx, cy) SELECT route, count(*) AS n_fragments, max(size) AS main_size, count(*) = 1 AS is_connected FROM (SELECT *, size < greatest(1, floor(max(size) OVER (PARTITION BY route) * 0.01)) AS noise FROM fr) WHERE NOT noise GROUP BY route")
def route_connectivity(spark, sf_dir):
    return raster.connectivity(raster.fragments(raster.components(b.pixels(spark, sf_dir))))


@query("pix nbr", f"{_CLOSE}, pt AS (SELECT l.route, l.cx, l.cy, round(sum(CASE WHEN n.x = n.nx OR n.y = n.ny THEN 1.0::DOUBLE ELSE sqrt(2.0::DOUBLE) END), 2) AS part FROM nbr n JOIN lab l ON n.route = l.route AND n.x = l.x AND n.y = l.y WHERE (n.x, n.y) < (n.nx, n.ny) GROUP BY l.route, l.cx, l.cy) SELECT r.route, coalesce(round(sum(part), 2), 0.0::DOUBLE) AS length FROM (SELECT DISTINCT route FROM pix) r LEFT JOIN pt ON r.route = pt.route GROUP BY r.route")
def pixel_length(spark, sf_dir):
    pixels = b.pixels(spark, sf_dir)
    return raster.path_length(pixels, raster.components(pixels))


@query("pix", f"WITH RECURSIVE {px.thinned('pix', 'thn')}, {px.pruned('thn', 'line', 2)} SELECT * FROM line")
def skeleton_pixels(spark, sf_dir):
    """Thinned and pruned routes."""
    return lines.skeletons(b.pixels(spark, sf_dir), 2)


@query("pix", f"WITH RECURSIVE beg AS (SELECT route, min(x * 1000 + y) // 1000 AS x, min(x * 1000 + y) % 1000 AS y FROM pix GROUP BY route), {px.walked('pix', 'beg', 'way')} SELECT route, x, y, round(len, 2) AS length FROM way QUALIFY row_number() OVER (PARTITION BY route ORDER BY -len, x, y) = 1")
def farthest_pixel(spark, sf_dir):
    """The end of the longest walk along a route from its least pixel."""
    pixels = b.pixels(spark, sf_dir)
    starts = pixels.groupBy("route").agg(F.min(F.struct("x", "y")).alias("s")).select("route", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"))
    return raster.farthest(pixels, starts)


@query()
def circle_matches(spark, sf_dir):
    """Parts' circles matched one to one with those of the shifted plan; greedy matching is tested on its own."""
    found = b.exhibits(spark, sf_dir).selectExpr("layout AS img", "ex_id AS found_id", "cx AS x", "cy AS y")
    drawn = b.exhibits(spark, sf_dir).selectExpr("layout AS img", "ex_id AS ann_id", "cx + ex_id % 7 - 3 AS x", "cy + ex_id % 5 - 2 AS y")
    return raster.match_circles(found, drawn, 2.4, 4.0)


@query("", "SELECT a.vec_id, arg_min(c.label, struct_pack(d := round(list_distance(CAST(a.embedding AS DOUBLE[]), c.m), 9), l := c.label)) AS nearest FROM embeddings a CROSS JOIN (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label) c GROUP BY a.vec_id")
def nearest_vector(spark, sf_dir):
    """Nearest label centre of each vector. Labels are few: their number is checked, and their centres are in the plan."""
    v = b.vectors(spark, sf_dir)
    flat = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = flat.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m")).limit(MOST_LABELS + 1).collect()
    if len(centres) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    dist = lambda m: F.sqrt(F.aggregate(F.zip_with("v", F.array(*map(F.lit, m)), lambda a, c: (a - c) * (a - c)), F.lit(0.0), lambda s, d: s + d))
    near = [F.struct(F.round(dist(c["m"]), 9).alias("d"), F.lit(c["label"]).alias("l")) for c in centres]
    best = F.array_min(F.array(*near))["l"] if near else F.lit(None).cast("bigint")
    return v.select("vec_id", best.alias("nearest"))


_BRUSH = "(SELECT unnest(range({0}, {1} + 1)) AS dx) CROSS JOIN (SELECT unnest(range({0}, {1} + 1)) AS dy)"


def _dilated(mask: str, low: int, high: int) -> str:
    return f"SELECT DISTINCT route, x + dx AS x, y + dy AS y FROM {mask} CROSS JOIN {_BRUSH.format(low, high)}"


def _eroded(mask: str, low: int, high: int) -> str:
    return f"SELECT route, x - dx AS x, y - dy AS y FROM {mask} CROSS JOIN {_BRUSH.format(low, high)} GROUP BY 1, 2, 3 HAVING count(*) = {(high - low + 1) ** 2}"


@query("pix", f"WITH cd AS ({_dilated('pix', 0, 1)}), cl AS ({_eroded('cd', 0, 1)}), oe AS ({_eroded('cl', 0, 1)}), op AS ({_dilated('oe', 0, 1)}) SELECT route, count(*) AS n_pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM op GROUP BY route")
def closed_opened(spark, sf_dir):
    """Routes with gaps closed and specks taken off by a brush of two."""
    two = raster.square(0, 1)
    done = raster.opened(raster.closed(shared.dealt(shared.keep(b.pixels(spark, sf_dir), "pixels")), two), two)
    return done.groupBy("route").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query("pix", "SELECT route, count(*) FILTER (WHERE a OR o) AS n_merged, count(*) FILTER (WHERE a AND NOT o) AS n_left FROM (SELECT route, x, y, bool_or(k = 0) AS a, bool_or(k = 1) AS o FROM (SELECT route, x, y, 0 AS k FROM pix UNION ALL SELECT route, x + 1, y, 1 FROM pix) GROUP BY route, x, y) GROUP BY route")
def mask_sets(spark, sf_dir):
    """A mask and its shift by one pixel: how many pixels they have together, and how many are left of the first."""
    one = b.pixels(spark, sf_dir)
    other = one.withColumn("x", F.col("x") + 1)
    both = raster.merged(one, other).groupBy("route").agg(F.count(F.lit(1)).alias("n_merged"))
    left = raster.subtracted(one, other).groupBy("route").agg(F.count(F.lit(1)).alias("n_left"))
    return both.join(left, "route", "left").fillna(0, ["n_left"])


_GRAY = "gr AS (SELECT route, x, y, min((x * 37 + y * 91 + route) % 256) AS a FROM pix GROUP BY route, x, y), go AS (SELECT route, x, y, CASE WHEN (x + y) % 3 = 0 THEN 255 - a ELSE a END AS o FROM gr WHERE x % 5 > 0)"


@query("pix", f"WITH {_GRAY}, fat AS (SELECT DISTINCT route, x + dx AS x, y + dy AS y FROM go CROSS JOIN {_BRUSH.format(-1, 1)} WHERE dx * dx + dy * dy <= 1 AND o <= 155), new AS (SELECT coalesce(g.route, o.route) AS route, coalesce(g.x, o.x) AS x, coalesce(g.y, o.y) AS y FROM gr g FULL JOIN go o ON g.route = o.route AND g.x = o.x AND g.y = o.y WHERE coalesce(a, 255) <= 155 OR abs(coalesce(a, 255) - coalesce(o, 255)) > 100) SELECT route, x, y FROM new n WHERE NOT EXISTS (SELECT 1 FROM fat f WHERE f.route = n.route AND f.x = n.x AND f.y = n.y)")
def drawn_mask(spark, sf_dir):
    """What an image has more than its original, which lacks some pixels and has others the other way round."""
    image = b.pixels(spark, sf_dir).withColumn("gray", (F.col("x") * 37 + F.col("y") * 91 + F.col("route")) % 256)
    plain = image.where("x % 5 > 0").withColumn("gray", F.when((F.col("x") + F.col("y")) % 3 == 0, 255 - F.col("gray")).otherwise(F.col("gray")))
    return raster.drawn_mask(image, plain, 100, 1)


_GREEN = "CASE WHEN route % 8 = 7 THEN x BETWEEN 2 AND 26 AND y BETWEEN 3 AND 27 + route % 5 AND NOT (x BETWEEN 9 AND 19 AND y BETWEEN 10 AND 20) WHEN route % 8 >= 5 THEN x BETWEEN 5 AND 4 + (16 - route % 8) AND y BETWEEN 4 AND 3 + (16 - route % 8) ELSE x BETWEEN 3 + route % 4 AND 18 + route % 4 AND y BETWEEN 4 AND 18 + route % 5 AND NOT (x = 10 AND y = 10) END"
_HUE = f"CASE WHEN {_GREEN} THEN 60 WHEN x BETWEEN 31 AND 39 + route % 7 AND y BETWEEN 12 AND 25 AND NOT (x = 35 AND y = 20) AND route % 6 > 0 THEN 25 WHEN y > 40 AND (x * 7 + y * 13 + route) % 97 = 0 THEN 60 ELSE 120 END"


def _coloured(spark, sf_dir):
    """Images with a green and a yellow box: solid, as a ring, with a hole, at the least size and below it; and specks."""
    n = b.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS route")
    grid = n.selectExpr("route", "explode(sequence(0L, 49L)) AS x").selectExpr("route", "x", "explode(sequence(0L, 59L)) AS y")
    return grid.selectExpr("route", "x", "y", f"{_HUE} AS h", "200 AS s", "180 AS v")


def _box_sql(role: str, hue: int) -> str:
    """The largest part of a hue, closed, opened and outlined, as r_{role} (route, x, y, w, h, area)."""
    t = role[:2] + "_"
    return f"""{t}m AS (SELECT route, x, y FROM img WHERE h = {hue}), {t}a AS ({px.dilated(t + 'm', px.brush(-4, 4))}), {t}b AS ({px.eroded(t + 'a', px.brush(-4, 4))}), {t}c AS ({px.eroded(t + 'b', px.brush(-2, 2))}), {t}d AS ({px.dilated(t + 'c', px.brush(-2, 2))}),
    {px.labelled(t + 'd', t + 'l')}, {px.outlined(t + 'l', t + 'o', 100)}, r_{role} AS (SELECT route, x, y, w, h, area FROM {t}o QUALIFY row_number() OVER (PARTITION BY route ORDER BY area DESC, cx, cy) = 1)"""


_IMAGES = f"img AS (SELECT route, x, y, {_HUE} AS h FROM (SELECT s_suppkey AS route FROM supplier) CROSS JOIN (SELECT unnest(range(50)) AS x) CROSS JOIN (SELECT unnest(range(60)) AS y))"


@query("", f"WITH RECURSIVE {_IMAGES}, {_box_sql('entrance', 60)}, {_box_sql('exit', 25)} SELECT *, 'entrance' AS role FROM r_entrance UNION ALL SELECT *, 'exit' FROM r_exit")
def color_boxes(spark, sf_dir):
    """The boxes of entrances and exits, found by their colour with holes closed and specks off, large enough by their outline."""
    pixels = _coloured(spark, sf_dir)
    found = [raster.color_boxes(pixels, role).withColumn("role", F.lit(role)) for role in raster.BOX_COLORS]
    return found[0].unionByName(found[1])


@query("", f"WITH RECURSIVE {_IMAGES}, {_box_sql('entrance', 60)} SELECT route, corner::BIGINT AS corner, x + CASE WHEN corner IN (1, 2) THEN w ELSE 0 END AS x, y + CASE WHEN corner >= 2 THEN h ELSE 0 END AS y, 5 + CASE WHEN corner IN (1, 2) THEN 20 ELSE 0 END AS zx, 6 + CASE WHEN corner >= 2 THEN 18 ELSE 0 END AS zy FROM r_entrance CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS corner)")
def box_anchors(spark, sf_dir):
    """Corners of detected entrances beside the annotated ones; exits are annotated as polygons and give none."""
    pixels = _coloured(spark, sf_dir)
    boxes = {role: raster.color_boxes(pixels, role) for role in raster.BOX_COLORS}
    routes = pixels.select("route").distinct()
    zones = routes.selectExpr("route", "'entrance' AS role", "'rectangle' AS shape", "5L AS x", "6L AS y", "20L AS w", "18L AS h").unionByName(routes.selectExpr("route", "'exit' AS role", "'polygon' AS shape", "0L AS x", "0L AS y", "9L AS w", "9L AS h"))
    return raster.box_anchors(boxes, zones).select("route", F.col("corner").cast("bigint").alias("corner"), "x", "y", "zx", "zy")


@query("exh", "SELECT layout AS img, round(median((cx + ex_id % 7 - 3) / CAST(greatest(cx, 1) AS DOUBLE)), 6) AS sx, round(median((cy + ex_id % 5 - 2) / CAST(greatest(cy, 1) AS DOUBLE)), 6) AS sy FROM exh GROUP BY layout")
def scale_estimates(spark, sf_dir):
    pairs = b.exhibits(spark, sf_dir).selectExpr("layout AS img", "cx AS x", "cy AS y", "cx + ex_id % 7 - 3 AS ax", "cy + ex_id % 5 - 2 AS ay")
    return raster.scale_estimate(pairs).select("img", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@query("drawn", "SELECT count(*) AS n, CAST(sum(h) AS BIGINT) AS sum_h, CAST(sum(s) AS BIGINT) AS sum_s, CAST(sum(v) AS BIGINT) AS sum_v FROM (SELECT CASE WHEN half >= 180 THEN half - 180 ELSE half END AS h, s, v FROM (SELECT round(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2) AS half, round(255.0::DOUBLE * d / m) AS s, m AS v FROM (SELECT *, greatest(r, g, b) AS m, greatest(r, g, b) - least(r, g, b) AS d, CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) = r THEN 60.0::DOUBLE * (g - b) / (greatest(r, g, b) - least(r, g, b)) WHEN greatest(r, g, b) = g THEN 120 + 60.0::DOUBLE * (b - r) / (greatest(r, g, b) - least(r, g, b)) ELSE 240 + 60.0::DOUBLE * (r - g) / (greatest(r, g, b) - least(r, g, b)) END AS hue FROM (SELECT h + 60 AS r, s AS g, v AS b FROM drawn)) WHERE m > 0))")
def hsv_conversion(spark, sf_dir):
    """Hues, saturations and values of colours given as red, green and blue."""
    rgb = b.colors(spark, sf_dir, False).select((F.col("h") + 60).alias("r"), F.col("s").alias("g"), F.col("v").alias("b")).where("greatest(r, g, b) > 0")
    done = rgb.select(raster.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    return done.agg(F.count(F.lit(1)).alias("n"), F.sum("c.h").alias("sum_h"), F.sum("c.s").alias("sum_s"), F.sum("c.v").alias("sum_v"))


@query("pix nbr", f"{_CLOSE}, fr AS (SELECT route, cx, cy, count(*) AS size FROM lab GROUP BY route, cx, cy) SELECT route, cx, cy, size, row_number() OVER (PARTITION BY route ORDER BY size DESC, cx, cy) AS place FROM fr")
def fragment_order(spark, sf_dir):
    """Connected parts of each route, the largest first."""
    parts = raster.fragments(raster.components(b.pixels(spark, sf_dir)))
    return raster.by_size(parts).select("route", "cx", "cy", "size", "place")


@query("pix", f"WITH RECURSIVE fat AS ({px.dilated('pix', px.CROSS)}), {px.skeleton('fat', 'msk')} SELECT * FROM msk")
def morphological_skeletons(spark, sf_dir):
    """What openings take from widened routes and their erosions."""
    return raster.morphological_skeleton(raster.dilate(b.pixels(spark, sf_dir), raster.CROSS))


_ANCHORS = "anc AS (SELECT DISTINCT route, CASE WHEN route % 10 > 0 THEN 0.0 END AS in_x, CASE WHEN route % 10 > 0 THEN 0.0 END AS in_y, CASE WHEN route % 7 > 0 THEN 23.0 END AS out_x, CASE WHEN route % 7 > 0 THEN 23.0 END AS out_y FROM pix)"
_CONNECTED = f"{px.labelled('pix', 'lab')}, con AS (SELECT route, count(*) = 1 AS is_connected FROM (SELECT *, size < greatest(1, floor(max(size) OVER (PARTITION BY route) * 0.01)) AS noise FROM (SELECT route, cx, cy, count(*) AS size FROM lab GROUP BY ALL)) WHERE NOT noise GROUP BY route)"


@query("pix", f"WITH RECURSIVE {px.thinned('pix', 'thn')}, {px.pruned('thn', 'line', 1)}, {_ANCHORS}, {_CONNECTED}, {px.ended('line', 'anc', 'con', 'ends')} SELECT * FROM ends")
def route_ends(spark, sf_dir):
    """Starts and ends of thinned routes."""
    pixels = b.pixels(spark, sf_dir)
    anchors = pixels.select("route").distinct().selectExpr("route", "CASE WHEN route % 10 > 0 THEN 0.0D END AS in_x", "CASE WHEN route % 10 > 0 THEN 0.0D END AS in_y", "CASE WHEN route % 7 > 0 THEN 23.0D END AS out_x", "CASE WHEN route % 7 > 0 THEN 23.0D END AS out_y")
    connected = raster.connectivity(raster.fragments(raster.components(pixels)))
    return raster.route_ends(lines.skeletons(pixels, 1), anchors, connected)
