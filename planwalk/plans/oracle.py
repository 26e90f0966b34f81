"""DuckDB views for the oracle side of the queries, written apart from the Spark side."""

from __future__ import annotations


def cross(ax, ay, bx, by, cx, cy, dx, dy) -> str:
    den = f"(({bx}-{ax})*({dy}-{cy})-({by}-{ay})*({dx}-{cx}))"
    t = f"(({cx}-{ax})*({dy}-{cy})-({cy}-{ay})*({dx}-{cx}))/CAST({den} AS DOUBLE)"
    u = f"(({cx}-{ax})*({by}-{ay})-({cy}-{ay})*({bx}-{ax}))/CAST({den} AS DOUBLE)"
    return f"(CASE WHEN abs({den})<1e-10 THEN false ELSE {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1 END)"


def seg_dist(px, py, ax, ay, bx, by) -> str:
    long = f"(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay}))"
    t = f"greatest(0.0::DOUBLE,least(1.0::DOUBLE,CASE WHEN {long}=0 THEN 0 ELSE (({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/CAST({long} AS DOUBLE) END))"
    return f"sqrt(({px}-({ax}+{t}*({bx}-{ax})))*({px}-({ax}+{t}*({bx}-{ax})))+({py}-({ay}+{t}*({by}-{ay})))*({py}-({ay}+{t}*({by}-{ay}))))"


_SIGHT = cross("p.x", "p.y", "e.cx", "e.cy", "w.ax", "w.ay", "w.bx", "w.by")
_RAY = "(w.ay > p.y) <> (w.by > p.y) AND p.x < (w.bx - w.ax) * (p.y - w.ay) / CAST(w.by - w.ay AS DOUBLE) + w.ax"
_INSIDE = "p.x BETWEEN r.x AND r.x + r.w AND p.y BETWEEN r.y AND r.y + r.h"

VIEWS = {
    "pts": "SELECT user_id % 4 AS layout, user_id AS route, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(floor(value) AS BIGINT) * 7 % 500 AS x, event_id % 500 AS y FROM events",
    "exh": "SELECT p_partkey % 4 AS layout, p_partkey AS ex_id, p_partkey * 37 % 500 AS cx, p_partkey * 91 % 500 AS cy, CAST(3 + p_size % 10 AS BIGINT) AS r, p_type AS section FROM part",
    "wal": "SELECT n % 4 AS layout, n AS wall, n * 83 % 400 AS x, n * 59 % 450 AS y FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_linenumber <= 7)",
    "wed": "SELECT layout, wall, x + a AS ax, y + b AS ay, x + c AS bx, y + d AS by FROM wal CROSS JOIN (VALUES (0, 0, 40, 5), (40, 5, 35, 30), (35, 30, 5, 25), (5, 25, 0, 0)) AS e(a, b, c, d)",
    "reg": "SELECT k % 4 AS layout, k AS id, CASE (k // 4) % 3 WHEN 0 THEN 'floor' WHEN 1 THEN 'forbidden' ELSE 'gallery' END AS kind, k * 53 % 300 AS x, k * 97 % 300 AS y, 120 + k % 5 * 30 AS w, 100 + k % 4 * 30 AS h, CASE g WHEN 0 THEN 'must_see' WHEN 1 THEN 'restricted' WHEN 2 THEN 'normal' END AS cfg FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, n_regionkey AS g FROM nation)",
    "seen": f"SELECT p.layout, p.route, p.i, e.ex_id, sqrt((p.x - e.cx) * (p.x - e.cx) + (p.y - e.cy) * (p.y - e.cy)) AS dist, CASE WHEN sqrt((p.x - e.cx) * (p.x - e.cx) + (p.y - e.cy) * (p.y - e.cy)) < e.r THEN 'collision' WHEN EXISTS (SELECT 1 FROM wed w WHERE w.layout = p.layout AND {_SIGHT}) THEN 'blocked' ELSE 'visit' END AS kind FROM pts p JOIN exh e ON p.layout = e.layout AND sqrt((p.x - e.cx) * (p.x - e.cx) + (p.y - e.cy) * (p.y - e.cy)) < e.r + 25",
    "seer": f"SELECT p.layout, p.route, p.i, p.reach, e.ex_id, CASE WHEN sqrt((p.x - e.cx) * (p.x - e.cx) + (p.y - e.cy) * (p.y - e.cy)) < e.r THEN 'collision' WHEN EXISTS (SELECT 1 FROM wed w WHERE w.layout = p.layout AND {_SIGHT}) THEN 'blocked' ELSE 'visit' END AS kind FROM (SELECT *, CASE WHEN route % 3 > 0 THEN CAST(trunc((1000 + route % 4 * 250) / 20.5::DOUBLE) AS INT) ELSE 25 END AS reach FROM pts) p JOIN exh e ON p.layout = e.layout AND sqrt((p.x - e.cx) * (p.x - e.cx) + (p.y - e.cy) * (p.y - e.cy)) < e.r + p.reach",
    "whit": f"SELECT layout, route, i, min(wall) AS wall FROM (SELECT p.layout, p.route, p.i, w.wall FROM pts p JOIN wed w ON p.layout = w.layout GROUP BY p.layout, p.route, p.i, w.wall HAVING count(*) FILTER (WHERE {_RAY}) % 2 = 1 OR min({seg_dist('p.x', 'p.y', 'w.ax', 'w.ay', 'w.bx', 'w.by')}) <= 2) GROUP BY layout, route, i",
    "inr": f"SELECT p.layout, p.route, p.i, r.id, r.kind, coalesce(r.cfg, 'normal') AS cfg FROM pts p JOIN reg r ON p.layout = r.layout AND {_INSIDE}",
    "flags": "SELECT p.layout, p.route, p.i, count(*) FILTER (WHERE n.kind = 'floor') = 0 AS outside, any_value(h.wall) AS wall, count(*) FILTER (WHERE n.kind = 'forbidden') > 0 AS forbidden, count(*) FILTER (WHERE n.kind = 'gallery' AND n.cfg = 'restricted') > 0 AS restricted FROM pts p LEFT JOIN inr n ON p.layout = n.layout AND p.route = n.route AND p.i = n.i LEFT JOIN whit h ON p.layout = h.layout AND p.route = h.route AND p.i = h.i GROUP BY p.layout, p.route, p.i",
    "lost": "SELECT a.layout, a.route, r.id FROM (SELECT DISTINCT layout, route FROM pts) a JOIN reg r ON a.layout = r.layout AND r.kind = 'gallery' AND r.cfg = 'must_see' WHERE NOT EXISTS (SELECT 1 FROM inr n WHERE n.layout = a.layout AND n.route = a.route AND n.id = r.id)",
    "seg": "SELECT layout, route, i, x AS ax, y AS ay, bx, ey FROM (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS ey FROM pts WINDOW w AS (PARTITION BY route ORDER BY i)) WHERE bx IS NOT NULL",
    "viol": "SELECT f.layout, f.route, f.n_outside, f.n_wall, f.n_forbidden, f.n_gallery, coalesce(c.n, 0) AS n_collision, coalesce(l.n, 0) AS n_must_see FROM (SELECT layout, route, count(*) FILTER (WHERE outside) AS n_outside, count(wall) AS n_wall, count(*) FILTER (WHERE forbidden) AS n_forbidden, count(*) FILTER (WHERE restricted) AS n_gallery FROM flags GROUP BY layout, route) f LEFT JOIN (SELECT route, count(*) AS n FROM seen WHERE kind = 'collision' GROUP BY route) c ON f.route = c.route LEFT JOIN (SELECT route, count(*) AS n FROM lost GROUP BY route) l ON f.route = l.route",
    "art": "SELECT k % 20 AS layout, k AS id, p_type AS section, replace(p_name, ' ', '; ') AS materials, p_brand AS technique, CASE k % 7 WHEN 0 THEN (500 + k % 100) || 'BC-' || (400 + k % 100) || 'BC' WHEN 1 THEN '' || (100 + k % 900) WHEN 2 THEN (200 + k % 50) || ' AD' WHEN 3 THEN (k % 900 + 1) || '-' || (k % 900 + 50) || ' (about)' WHEN 4 THEN (k % 21 + 1) || 'thC' WHEN 6 THEN (300 + k % 200) || ' BC' END AS production_date, CASE k % 5 WHEN 0 THEN 'Excavated/Findspot: NATION_' || (k % 25) || ' (said to be)' WHEN 1 THEN 'Found/Acquired: NATION_' || (k % 25) WHEN 2 THEN 'findspot:  nation_' || (k % 25) || ' , north' WHEN 3 THEN 'Bought: Somewhere-' || chr(CAST(97 + k % 26 AS INT)) || ' possibly old' END AS find_spot FROM (SELECT *, p_partkey AS k FROM part)",
    "dim": "SELECT CAST(n_nationkey AS BIGINT) AS ord, n_name AS city, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey",
    "plain": r"SELECT *, trim(regexp_replace(trim(production_date), '\s*\([^)]+\)', '', 'g')) AS d FROM art",
    "dated": r"SELECT layout, id, section, materials, technique, find_spot, production_date, CASE WHEN is_range THEN least(a, b) WHEN is_year THEN y END AS year_min, CASE WHEN is_range THEN greatest(a, b) WHEN is_year THEN y END AS year_max, is_range, CASE WHEN is_range OR is_year THEN 'success' ELSE 'failed' END AS date_status FROM (SELECT *, coalesce(regexp_matches(d, '^(\d+)\s*(BC|AD)?\s*-\s*(\d+)\s*(BC|AD)?$', 'i'), false) AS is_range, coalesce(regexp_matches(d, '^(\d+)\s*(BC|AD)?$', 'i'), false) AS is_year, TRY_CAST(regexp_extract(d, '^(\d+)', 1) AS INT) * CASE WHEN regexp_matches(d, '^\d+\s*BC', 'i') THEN -1 ELSE 1 END AS a, TRY_CAST(regexp_extract(d, '-\s*(\d+)', 1) AS INT) * CASE WHEN regexp_matches(d, 'BC$', 'i') THEN -1 ELSE 1 END AS b, TRY_CAST(regexp_extract(d, '^(\d+)', 1) AS INT) * CASE WHEN regexp_matches(d, 'BC$', 'i') THEN -1 ELSE 1 END AS y FROM plain)",
    "spots": r"SELECT *, coalesce(nullif(trim(regexp_replace(trim(regexp_extract(find_spot, '(?:Excavated/Findspot|Found/Acquired|Findspot):\s*([^(,;]+)', 1, 'i')), '\s+(said to be|possibly|probably|modern|historic).*$', '', 'i')), ''), nullif(trim(regexp_replace(trim(regexp_extract(find_spot, ':\s*([A-Za-z\s\-]+)', 1)), '\s+(said to be|possibly|probably|modern|historic).*$', '', 'i')), '')) AS city FROM dated",
    "named": "SELECT city, country FROM (SELECT s.city, d.country, row_number() OVER (PARTITION BY s.city ORDER BY CASE WHEN s.city = d.city THEN 0 WHEN lower(s.city) = lower(d.city) THEN 1 ELSE 2 END, d.ord) AS rn FROM (SELECT DISTINCT city FROM spots WHERE city IS NOT NULL) s JOIN dim d ON contains(lower(s.city), lower(d.city)) OR contains(lower(d.city), lower(s.city))) WHERE rn = 1",
    "facts": "SELECT s.*, n.country, CASE WHEN s.city IS NULL THEN 'failed' WHEN n.country IS NULL THEN 'unknown' ELSE 'success' END AS place_status FROM spots s LEFT JOIN named n ON s.city = n.city",
    "vis": "SELECT DISTINCT l_suppkey AS task, l_partkey AS ex_id FROM lineitem",
    "tasks": "SELECT k AS task, k % 20 AS layout, k % 4 <> 2 AS has_date, CASE k % 4 WHEN 0 THEN -(480 + k % 40) WHEN 1 THEN 150 END AS lo, CASE k % 4 WHEN 0 THEN 100 + k % 300 WHEN 1 THEN 900 END AS hi, CASE WHEN k % 4 = 3 THEN -(200 + k % 100) END AS before_y, CASE WHEN k % 8 = 3 THEN -450 END AS after_y, CASE k % 3 WHEN 0 THEN ['red', 'steel'] WHEN 1 THEN ['bolt'] ELSE [] END AS mats, CASE k % 5 WHEN 0 THEN ['nation_' || (k % 25)] WHEN 1 THEN ['asia', 'somewhere-c'] ELSE [] END AS places, CASE k % 2 WHEN 0 THEN ['brand#' || (1 + k % 25)] ELSE [] END AS techs, CASE k % 3 WHEN 0 THEN ['ECONOMY'] WHEN 1 THEN ['SMALL', 'NO SUCH'] ELSE [] END AS cats, CASE k % 4 WHEN 0 THEN [k % 200, k * 7 % 200, k % 200] WHEN 1 THEN [k * 13 % 200] ELSE [] END AS specific, 1 + k % 40 AS min_n FROM (SELECT s_suppkey AS k FROM supplier)",
    "match": "SELECT t.task, f.id AS ex_id, t.has_date, len(t.mats) > 0 AS has_mat, len(t.places) > 0 AS has_place, len(t.techs) > 0 AS has_tech, coalesce((t.lo IS NULL OR (f.year_min >= t.lo AND f.year_max <= t.hi)) AND (t.before_y IS NULL OR f.year_max < t.before_y) AND (t.after_y IS NULL OR f.year_min > t.after_y), false) AS m_date, coalesce(len(list_filter(t.mats, lambda x: contains(lower(f.materials), x))) > 0, false) AS m_mat, coalesce(len(list_filter(t.places, lambda x: coalesce(contains(lower(f.city), x), false) OR coalesce(contains(lower(f.country), x), false))) > 0, false) AS m_place, coalesce(len(list_filter(t.techs, lambda x: contains(lower(f.technique), x))) > 0, false) AS m_tech FROM tasks t JOIN facts f ON t.layout = f.layout",
    "need": "SELECT task, ex_id, 'date' AS kind FROM match WHERE has_date AND m_date UNION ALL SELECT task, ex_id, 'material' FROM match WHERE has_mat AND m_mat UNION ALL SELECT task, ex_id, 'place' FROM match WHERE has_place AND m_place UNION ALL SELECT task, ex_id, 'technique' FROM match WHERE has_tech AND m_tech UNION ALL SELECT task, ex_id, 'combined' FROM match WHERE (has_date OR has_mat OR has_place OR has_tech) AND (NOT has_date OR m_date) AND (NOT has_mat OR m_mat) AND (NOT has_place OR m_place) AND (NOT has_tech OR m_tech)",
    "cover": "SELECT t.task, k.kind, count(n.ex_id) AS n_required, count(v.ex_id) AS n_visited, CASE WHEN count(n.ex_id) = 0 THEN 100.0::DOUBLE ELSE round(100.0::DOUBLE * count(v.ex_id) / count(n.ex_id), 2) END AS pct, count(n.ex_id) = count(v.ex_id) AS valid FROM tasks t CROSS JOIN (VALUES ('date'), ('material'), ('place'), ('technique'), ('combined')) AS k(kind) LEFT JOIN need n ON t.task = n.task AND k.kind = n.kind LEFT JOIN vis v ON n.task = v.task AND n.ex_id = v.ex_id GROUP BY t.task, k.kind",
    "cats": "SELECT w.task, w.category, count(f.id) AS n_members, count(v.ex_id) AS n_visited, count(f.id) > 0 AND count(f.id) = count(v.ex_id) AS valid FROM (SELECT task, layout, unnest(cats) AS category FROM tasks) w LEFT JOIN facts f ON w.layout = f.layout AND w.category = f.section LEFT JOIN vis v ON w.task = v.task AND f.id = v.ex_id GROUP BY w.task, w.category",
    "spec": "SELECT t.task, count(v.ex_id) AS n_found, coalesce(string_agg(CASE WHEN w.ex_id IS NOT NULL AND v.ex_id IS NULL THEN CAST(w.ex_id AS VARCHAR) END, ',' ORDER BY w.ex_id), '') AS missing, CASE WHEN len(any_value(t.specific)) = 0 THEN 100.0::DOUBLE ELSE round(100.0::DOUBLE * count(v.ex_id) / len(any_value(t.specific)), 2) END AS pct, count(w.ex_id) = count(v.ex_id) AS valid FROM tasks t LEFT JOIN (SELECT DISTINCT task, unnest(specific) AS ex_id FROM tasks) w ON t.task = w.task LEFT JOIN vis v ON w.task = v.task AND w.ex_id = v.ex_id GROUP BY t.task",
    "least": "SELECT t.task, count(v.ex_id) AS n_visited, round(100.0::DOUBLE * count(v.ex_id) / t.min_n, 2) AS pct, count(v.ex_id) >= t.min_n AS valid FROM tasks t LEFT JOIN vis v ON t.task = v.task GROUP BY t.task, t.min_n",
    "overall": "SELECT t.task, bool_and(c.valid) FILTER (WHERE c.kind = 'date') AS date_ok, bool_and(c.valid) FILTER (WHERE c.kind = 'material') AS material_ok, bool_and(c.valid) FILTER (WHERE c.kind = 'place') AS place_ok, bool_and(c.valid) FILTER (WHERE c.kind = 'technique') AS technique_ok, bool_and(c.valid) FILTER (WHERE c.kind = 'combined') AS combined_ok, coalesce((SELECT bool_and(valid) FROM cats WHERE cats.task = t.task), true) AS category_ok, (SELECT valid FROM spec WHERE spec.task = t.task) AS specific_ok, (SELECT valid FROM least WHERE least.task = t.task) AS count_ok FROM tasks t JOIN cover c ON t.task = c.task GROUP BY t.task",
    "res": "SELECT k, 'm' || (o_custkey % 5) AS model, o_orderpriority AS difficulty, o_orderstatus AS complexity, k % 48 AS layout, k % 2 = 0 AS connectivity, k % 3 = 0 AS wall, k % 5 = 0 AS collision, k % 7 = 0 AS area, k % 4 <> 0 AS full_scsr, k % 11 <> 0 AS start_end, k % 5 <> 0 AS must_pass, k % 6 = 0 AS restricted, CASE WHEN k % 13 <> 0 THEN k % 9 <> 0 END AS budget, k % 10 <> 0 AS has_scar, k % 3 <> 1 AS specific, k % 4 <> 1 AS attributes, CASE WHEN k % 17 <> 0 THEN round(o_totalprice % 100, 2) END AS fidelity FROM (SELECT *, o_orderkey AS k FROM orders)",
    "score": "SELECT *, CAST(connectivity AS INT) + CAST(NOT wall AS INT) + CAST(NOT collision AS INT) + CAST(NOT area AS INT) AS svr_passed, CAST(start_end AS INT) + CASE WHEN full_scsr THEN CAST(must_pass AS INT) + CAST(NOT restricted AS INT) + CAST(coalesce(budget, false) AS INT) ELSE 0 END AS scsr_passed, CASE WHEN full_scsr THEN 4 ELSE 1 END AS scsr_total, CASE WHEN has_scar THEN CAST(specific AS INT) + CAST(attributes AS INT) ELSE 0 END AS scar_passed, CASE WHEN has_scar THEN 2 ELSE 0 END AS scar_total FROM res",
    "bin": "SELECT *, CASE WHEN svr_passed = 4 THEN 1 ELSE 0 END AS svr, CASE WHEN scsr_passed = scsr_total THEN 1 ELSE 0 END AS scsr, CASE WHEN scar_total > 0 AND scar_passed = scar_total THEN 1 ELSE 0 END AS scar FROM score",
    "logs": "SELECT user_id AS task, event_id AS line_no, CASE WHEN event_id % 9 = 0 THEN '  continued ' || event_type ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - INFO - ' || event_type END AS line FROM events",
    "span": r"SELECT task, CASE WHEN count(*) >= 2 THEN CAST(epoch(arg_max(t, line_no)) - epoch(arg_min(t, line_no)) AS DOUBLE) END AS seconds FROM (SELECT task, line_no, TRY_CAST(nullif(regexp_extract(line, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})', 1), '') AS TIMESTAMP) AS t FROM logs) WHERE t IS NOT NULL GROUP BY task",
    "ans": "SELECT id, x + 7 < 500 AND y + 3 < 500 AS fits, CASE id % 6 WHEN 0 THEN r WHEN 1 THEN '```json' || chr(10) || r || chr(10) || '```' WHEN 2 THEN 'The route is ' || r || ' as asked.' WHEN 3 THEN '[[' || x || ',' || y || ']]' WHEN 4 THEN 'no route' ELSE '[[' || x || ',' || y || '],[' || (x + 900) || ',' || y || ']]' END AS txt FROM (SELECT *, '[[' || x || ',' || y || '],[' || (x + 7) || ',' || (y + 3) || '],[' || y || ',' || x || ']]' AS r FROM (SELECT event_id AS id, CAST(floor(value) AS BIGINT) * 7 % 500 AS x, event_id % 500 AS y FROM events))",
    "pick": "SELECT k AS id, CASE k % 4 WHEN 0 THEN '[' || (k % 50) || ', ' || (k * 7 % 50) || ']' WHEN 1 THEN 'I choose [' || (k % 50) || ', ' || (k * 7 % 50) || '] [x]' WHEN 2 THEN 'none' ELSE '[' || (k % 50) || ']' END AS txt FROM (SELECT o_orderkey AS k FROM orders)",
    "pix": "SELECT DISTINCT user_id AS route, CAST(floor(value) AS BIGINT) % 24 AS x, event_id % 24 AS y FROM events",
    "nbr": "SELECT a.route, a.x, a.y, b.x AS nx, b.y AS ny FROM pix a JOIN pix b ON a.route = b.route AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y)",
    "drawn": "SELECT img, CASE WHEN c <= 4 THEN img * 5 % 180 ELSE b % 180 END AS h, CASE WHEN c <= 3 THEN 200 + c ELSE a % 256 END AS s, CASE WHEN c <= 4 THEN 210 ELSE b % 256 END AS v FROM (SELECT l_suppkey AS img, l_orderkey AS a, l_partkey AS b, l_linenumber AS c FROM lineitem)",
    "orig": "SELECT img, (b * 11 + c) % 180 AS h, a % 120 AS s, (a + b) % 256 AS v FROM (SELECT l_suppkey AS img, l_orderkey AS a, l_partkey AS b, l_linenumber AS c FROM lineitem)",
    "bins": "SELECT img, h // 5 * 32 + s // 32 * 4 + v // 64 AS bin, count(*) AS cnt FROM drawn GROUP BY img, bin",
    "lines": "SELECT k % 50 AS layout, k AS line_no, CASE k % 5 WHEN 0 THEN (k % 30) || '-' || (k % 30 + k % 4) || ': ' || s WHEN 1 THEN (k % 40) || ':' || s WHEN 2 THEN '# comment: 3' WHEN 3 THEN (k % 9) || ' - ' || (k % 9 + 2) || ' :  ' || s ELSE 'x-2: nothing' END AS line FROM (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Economy' WHEN 1 THEN 'SMALL' ELSE 'large' END AS s FROM customer)",
    "placed": r"SELECT layout, line_no, unnest(range(a, b + 1)) AS number, section FROM (SELECT layout, line_no, CAST(regexp_extract(line, '^\s*(\d+)', 1) AS BIGINT) AS a, CAST(coalesce(nullif(regexp_extract(line, '^\s*\d+\s*-\s*(\d+)\s*:', 1), ''), regexp_extract(line, '^\s*(\d+)', 1)) AS BIGINT) AS b, trim(regexp_extract(line, ':(.*)$', 1)) AS section FROM lines WHERE regexp_matches(line, '^\s*\d+(\s*-\s*\d+)?\s*:'))",
    "firsts": "SELECT layout, number, arg_min(section, line_no) AS section FROM placed GROUP BY layout, number",
    "gone": "SELECT CASE k % 4 WHEN 0 THEN f || '/hard/simple/hard_0' || (k % 7) || '_layout_' || (k % 48) WHEN 1 THEN f || '\\medium\\complex\\medium_0' || (k % 3) || '_layout_' || (k % 48) WHEN 2 THEN f || '/easy_spatial/simple/easy_spatial_layout_' || (k % 48) ELSE f || '/short/path' END AS path FROM (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'm' || (o_orderkey % 5) || '(high)' ELSE 'm' || (o_orderkey % 5) END AS f FROM orders)".replace("\\\\", "\\"),
    "prof": "SELECT attribute, value, count(*) AS cnt, min(id) AS first_pos FROM (SELECT 'sections' AS attribute, section AS value, id FROM facts UNION ALL SELECT 'techniques', technique, id FROM facts UNION ALL SELECT 'cities', city, id FROM facts UNION ALL SELECT 'countries', country, id FROM facts UNION ALL SELECT 'materials', trim(unnest(string_split(materials, ';'))), id FROM facts) WHERE value IS NOT NULL AND value <> '' GROUP BY attribute, value",
}
VIEWS["rtasks"] = VIEWS["tasks"].replace("k % 20 AS layout", "k % 4 AS layout").replace("SELECT s_suppkey AS k FROM supplier", "SELECT DISTINCT user_id AS k FROM events")
VIEWS["rfacts"] = "SELECT * REPLACE (id % 4 AS layout) FROM facts"
VIEWS["rvis"] = "SELECT DISTINCT route AS task, ex_id FROM seer WHERE kind = 'visit'"
VIEWS["tfile"] = "SELECT 'plans/' || CASE k % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'complex' ELSE 'draft' END || '/layout_' || (k % 24) || '/' || CASE k % 5 WHEN 0 THEN 'easy_semantic' WHEN 1 THEN 'easy_spatial' WHEN 2 THEN 'medium_' || (k % 11) WHEN 3 THEN 'hard_' || (k % 7) ELSE 'notes' END || '.json' AS path FROM (SELECT c_custkey AS k FROM customer)"
VIEWS["rfile"] = "SELECT 'm' || (k % 3) || '/' || CASE k % 4 WHEN 0 THEN 'medium/' || c || '/medium_' || (k % 11) WHEN 1 THEN 'hard/' || c || '/hard_' || (k % 7) WHEN 2 THEN 'easy_semantic/' || c || '/easy_semantic' ELSE 'easy_spatial/' || c || '/easy_spatial' END || '_layout_' || (k % 24) || CASE WHEN k % 6 = 5 THEN '/run.log' ELSE '/final_results.json' END AS path FROM (SELECT o_orderkey AS k, CASE o_orderkey % 2 WHEN 0 THEN 'simple' ELSE 'complex' END AS c FROM orders)"
VIEWS["ann"] = "SELECT k % 4 AS layout, 'exhibit_' || k AS id, CASE k % 6 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN '' || (k % 90) ELSE '' || k END AS exhibit_number FROM (SELECT p_partkey AS k FROM part)"


def for_routes(name: str) -> str:
    """A view over tasks, catalogue and visits as one over what routes were asked for and saw."""
    import re

    return re.sub(r"\b(tasks|facts|vis|match|need|cover|cats|spec|least|overall)\b(?=[ ,)]|$|\.)", r"r\1", VIEWS[name]).replace("unnest(rcats)", "unnest(cats)")


for _name in ("match", "need", "cover", "cats", "spec", "overall"):
    VIEWS[f"r{_name}"] = for_routes(_name)
VIEWS["rleast"] = for_routes("least")
