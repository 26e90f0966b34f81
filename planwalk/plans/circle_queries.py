"""Circles found in images, with the same votes in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwalk.operators import circles
from planwalk.plans import pixel_sql as px
from planwalk.plans.registry import query
from planwalk.sources import bindings as b

_WIDE, _HIGH = 68, 64
#: Two discs and a stroke in every image, darkest first.
_GRAY = "CASE WHEN (x - 47 - route % 3) * (x - 47 - route % 3) + (y - 44 - route % 5) * (y - 44 - route % 5) <= (7 + route % 3) * (7 + route % 3) THEN 20 WHEN (x - 18 - route % 5) * (x - 18 - route % 5) + (y - 22 - route % 7) * (y - 22 - route % 7) <= (8 + route % 4) * (8 + route % 4) THEN 40 + route % 3 * 30 WHEN y = 6 AND x BETWEEN 6 AND 58 THEN 100 END"

_BELL = "(VALUES (-2, 16), (-1, 64), (0, 96), (1, 64), (2, 16)) AS k(d, wt)"
_SLOPES = f"""img AS (SELECT * FROM (SELECT route, x, y, {_GRAY} AS gray FROM (SELECT s_suppkey AS route FROM supplier) CROSS JOIN (SELECT unnest(range({_WIDE})) AS x) CROSS JOIN (SELECT unnest(range({_HIGH})) AS y)) WHERE gray IS NOT NULL),
win AS (SELECT route, greatest(5, trunc(m * 0.4::DOUBLE))::BIGINT AS low, greatest(30, trunc(m * 1.6::DOUBLE))::BIGINT AS high, greatest(10, trunc(m * 0.8::DOUBLE))::BIGINT AS apart FROM (SELECT s_suppkey AS route, (8 + s_suppkey % 4 + 7 + s_suppkey % 3) / 2.0::DOUBLE AS m FROM supplier WHERE s_suppkey % 9 > 0)),
b1 AS (SELECT route, x + d AS x, y, sum((255 - gray) * wt)::BIGINT AS v FROM img CROSS JOIN {_BELL} GROUP BY ALL),
b2 AS (SELECT route, x, y + d AS y, sum(v * wt)::BIGINT AS v FROM b1 CROSS JOIN {_BELL} GROUP BY ALL),
dk AS (SELECT route, x, y, 255 - ((255 * 65536 + 32768 - v) >> 16) AS d FROM b2),
sl AS (SELECT route, x + dx AS x, y + dy AS y, sum(dk.d * dx * (2 - abs(dy)))::BIGINT AS gx, sum(dk.d * dy * (2 - abs(dx)))::BIGINT AS gy FROM dk CROSS JOIN {px.brush(-1, 1).removesuffix(' AS d')} AS o GROUP BY ALL),
dr AS (SELECT *, abs(gx) + abs(gy) AS m, CASE WHEN abs(gy) * 1000 > abs(gx) * 2414 THEN 0 ELSE 1 END AS ux, CASE WHEN abs(gx) * 1000 > abs(gy) * 2414 THEN 0 WHEN abs(gy) * 1000 > abs(gx) * 2414 OR gx * gy > 0 THEN 1 ELSE -1 END AS uy FROM sl),
th AS (SELECT a.route, a.x, a.y, a.gx, a.gy, a.m FROM dr a LEFT JOIN dr p ON p.route = a.route AND p.x = a.x - a.ux AND p.y = a.y - a.uy LEFT JOIN dr n ON n.route = a.route AND n.x = a.x + a.ux AND n.y = a.y + a.uy WHERE a.m > 30 AND a.m > coalesce(p.m, 0) AND a.m >= coalesce(n.m, 0))"""
_EDGES = f"{px.labelled('th', 'lb')}, edg AS (SELECT route, x, y, gx, gy FROM (SELECT th.*, max(m) OVER (PARTITION BY route, cx, cy) AS most FROM th JOIN lb USING (route, x, y)) WHERE most > {circles.STRONG})"
_VOTES = f"""vot AS (SELECT route, x, y, count(*) AS votes FROM (SELECT route, floor(x + k * gx / sqrt((gx * gx + gy * gy)::DOUBLE) + 0.5)::BIGINT AS x, floor(y + k * gy / sqrt((gx * gx + gy * gy)::DOUBLE) + 0.5)::BIGINT AS y FROM (SELECT edg.*, unnest(list_concat(range(low, high + 1), range(-high, 1 - low))) AS k FROM edg JOIN win USING (route))) WHERE x BETWEEN 0 AND {_WIDE - 1} AND y BETWEEN 0 AND {_HIGH - 1} GROUP BY ALL HAVING count(*) > {circles.LEAST_VOTES}),
top AS (SELECT a.route, a.x, a.y, a.votes, row_number() OVER (PARTITION BY a.route ORDER BY a.votes DESC, a.x, a.y) AS place FROM vot a WHERE NOT EXISTS (SELECT 1 FROM vot o WHERE o.route = a.route AND abs(o.x - a.x) + abs(o.y - a.y) = 1 AND (o.votes > a.votes OR o.votes = a.votes AND (o.x < a.x OR o.y < a.y)))),
go AS (SELECT DISTINCT route, 0::BIGINT AS place, [struct_pack(x := 0::BIGINT, y := 0::BIGINT, v := 0::BIGINT)][1:0] AS kept FROM top UNION ALL SELECT g.route, t.place, CASE WHEN len(list_filter(g.kept, lambda c: (c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y) < w.apart * w.apart)) > 0 THEN g.kept ELSE list_append(g.kept, struct_pack(x := t.x, y := t.y, v := t.votes)) END FROM go g JOIN top t ON t.route = g.route AND t.place = g.place + 1 JOIN win w ON w.route = g.route),
cen AS (SELECT route, c.x AS x, c.y AS y, c.v AS votes FROM (SELECT route, unnest(kept) AS c FROM (SELECT * FROM go QUALIFY row_number() OVER (PARTITION BY route ORDER BY place DESC) = 1)))"""


@query("", f"WITH RECURSIVE {_SLOPES}, {_EDGES}, {_VOTES} SELECT route, x, y, r, votes, n AS n_edge FROM (SELECT c.route, c.x, c.y, c.votes, low, high, floor(sqrt(((e.x - c.x) * (e.x - c.x) + (e.y - c.y) * (e.y - c.y))::DOUBLE) + 0.5)::BIGINT AS r, count(*) AS n FROM cen c JOIN win USING (route) JOIN edg e ON e.route = c.route GROUP BY ALL) WHERE r BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY route, x, y ORDER BY n / r::DOUBLE DESC, r) = 1 AND n > {circles.LEAST_VOTES}")
def plan_circles(spark, sf_dir):
    """Circles that edge pixels vote for, in images of two discs and a stroke; a ninth of them have no annotated circles."""
    n = b.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS route")
    grid = n.selectExpr("route", f"explode(sequence(0L, {_WIDE - 1}L)) AS x").selectExpr("route", "x", f"explode(sequence(0L, {_HIGH - 1}L)) AS y")
    image = grid.selectExpr("route", "x", "y", f"{_GRAY} AS gray").where("gray IS NOT NULL")
    sizes = n.select("route", F.lit(_WIDE).cast("bigint").alias("w"), F.lit(_HIGH).cast("bigint").alias("h"))
    annotated = n.where("route % 9 > 0").selectExpr("route", "explode(array(8 + route % 4, 7 + route % 3)) AS r")
    return circles.circles(image, sizes, annotated)
