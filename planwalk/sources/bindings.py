"""The engine's tables derived from the star-schema tables of a folder, deterministic and at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.plans import shared

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, route, i, x, y)"""
    order = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    return table(spark, sf_dir, "events").selectExpr("user_id % 4 AS layout", "user_id AS route", f"cast({order} - 1 AS bigint) AS i", "cast(floor(value) AS bigint) * 7 % 500 AS x", "event_id % 500 AS y")


def exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, ex_id, cx, cy, r, section)"""
    return table(spark, sf_dir, "part").selectExpr("p_partkey % 4 AS layout", "p_partkey AS ex_id", "p_partkey * 37 % 500 AS cx", "p_partkey * 91 % 500 AS cy", "cast(3 + p_size % 10 AS bigint) AS r", "p_type AS section")


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, wall, points): closed outlines"""
    n = table(spark, sf_dir, "lineitem").where("l_linenumber <= 7").selectExpr("cast(l_linenumber AS bigint) AS wall").distinct()
    at = n.selectExpr("wall % 4 AS layout", "wall", "wall * 83 % 400 AS x", "wall * 59 % 450 AS y")
    corners = ", ".join(f"named_struct('x', x + {a}, 'y', y + {b})" for a, b in ((0, 0), (40, 5), (35, 30), (5, 25)))
    return at.selectExpr("layout", "wall", f"array({corners}) AS points")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, id, kind, x, y, w, h, cfg)"""
    n = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS id", "n_regionkey AS g")
    kind = "CASE id div 4 % 3 WHEN 0 THEN 'floor' WHEN 1 THEN 'forbidden' ELSE 'gallery' END AS kind"
    cfg = "CASE g WHEN 0 THEN 'must_see' WHEN 1 THEN 'restricted' WHEN 2 THEN 'normal' END AS cfg"
    return n.selectExpr("id % 4 AS layout", "id", kind, "id * 53 % 300 AS x", "id * 97 % 300 AS y", "120 + id % 5 * 30 AS w", "100 + id % 4 * 30 AS h", cfg)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, id, section, materials, technique, production_date, find_spot)"""
    date = """CASE k % 7 WHEN 0 THEN concat(500 + k % 100, 'BC-', 400 + k % 100, 'BC') WHEN 1 THEN concat(100 + k % 900, '') WHEN 2 THEN concat(200 + k % 50, ' AD')
        WHEN 3 THEN concat(k % 900 + 1, '-', k % 900 + 50, ' (about)') WHEN 4 THEN concat(k % 21 + 1, 'thC') WHEN 6 THEN concat(300 + k % 200, ' BC') END AS production_date"""
    spot = """CASE k % 5 WHEN 0 THEN concat('Excavated/Findspot: NATION_', k % 25, ' (said to be)') WHEN 1 THEN concat('Found/Acquired: NATION_', k % 25)
        WHEN 2 THEN concat('findspot:  nation_', k % 25, ' , north') WHEN 3 THEN concat('Bought: Somewhere-', chr(97 + cast(k % 26 AS int)), ' possibly old') END AS find_spot"""
    return table(spark, sf_dir, "part").selectExpr("*", "p_partkey AS k").selectExpr("k % 20 AS layout", "k AS id", "p_type AS section", "replace(p_name, ' ', '; ') AS materials", "p_brand AS technique", date, spot)


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, city, country)"""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).selectExpr("cast(n_nationkey AS bigint) AS ord", "n_name AS city", "r_name AS country")


def exhibit_facts(spark: SparkSession, sf_dir: str, placed: bool = True) -> DataFrame:
    """(layout, ex_id, section, material, technique, year_min, year_max, city, country), the last two if placed.

    Texts are parsed by all tasks, however few files they come from, and once: places are looked up in what is stored then."""
    from planwalk.functions import text
    from planwalk.operators import catalogue
    from planwalk.plans import shared

    made = artifacts(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "layout", "id").withColumn("d", text.parse_date(F.col("production_date")))
    done = made.selectExpr("layout", "id AS ex_id", "section", "materials AS material", "technique", "d.year_min", "d.year_max", "find_spot")
    if not placed:
        return done.drop("find_spot")
    named = shared.keep(done.withColumn("city", text.find_city(F.col("find_spot"))).drop("find_spot"), "exhibit-facts")
    return catalogue.city_country(named, cities(spark, sf_dir)).select(*named.columns, "country")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, ex_id), some of them repeated"""
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS task", "l_partkey AS ex_id")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, layout, in_range, before_year, after_year, materials, places, techniques, categories, specific, min_n)"""
    return _asked(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k"), 20)


def route_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each route was asked for, as `tasks` with the route's number and layout."""
    return _asked(table(spark, sf_dir, "events").selectExpr("user_id AS k").distinct(), 4)


def _asked(numbers: DataFrame, layouts: int) -> DataFrame:
    return numbers.selectExpr(
        "k AS task",
        f"k % {layouts} AS layout",
        "CASE k % 4 WHEN 0 THEN array(concat(480 + k % 40, ' BC'), concat(100 + k % 300, ' AD')) WHEN 1 THEN array('150', '900') WHEN 2 THEN cast(array() AS array<string>) END AS in_range",
        "CASE WHEN k % 4 = 3 THEN concat(200 + k % 100, ' BC') END AS before_year",
        "CASE WHEN k % 8 = 3 THEN '450 BC' END AS after_year",
        "CASE k % 3 WHEN 0 THEN array('red', 'Steel') WHEN 1 THEN array('BOLT') ELSE cast(array() AS array<string>) END AS materials",
        "CASE k % 5 WHEN 0 THEN array(concat('nation_', k % 25)) WHEN 1 THEN array('asia', 'Somewhere-c') WHEN 2 THEN cast(array() AS array<string>) END AS places",
        "CASE k % 2 WHEN 0 THEN array(concat('brand#', 1 + k % 25)) ELSE cast(array() AS array<string>) END AS techniques",
        "CASE k % 3 WHEN 0 THEN array('ECONOMY') WHEN 1 THEN array('SMALL', 'NO SUCH') ELSE cast(array() AS array<string>) END AS categories",
        "CASE k % 4 WHEN 0 THEN array(k % 200, k * 7 % 200, k % 200) WHEN 1 THEN array(k * 13 % 200) ELSE cast(array() AS array<bigint>) END AS specific",
        "1 + k % 40 AS min_n",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, model, difficulty, complexity, layout, svr, scsr, scar, fidelity)"""
    has = lambda name, test: f"'{name}', {test}"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice").selectExpr(
        "k",
        "concat('m', o_custkey % 5) AS model",
        "o_orderpriority AS difficulty",
        "o_orderstatus AS complexity",
        "k % 48 AS layout",
        f"map({has('connectivity', 'k % 2 = 0')}, {has('wall_crossings', 'k % 3 = 0')}, {has('exhibit_collision', 'k % 5 = 0')}, {has('out_of_area_violations', 'k % 7 = 0')}) AS svr",
        f"CASE WHEN k % 4 = 0 THEN map({has('start_end_location', 'k % 11 <> 0')}) ELSE map({has('start_end_location', 'k % 11 <> 0')}, {has('must_pass_regions', 'k % 5 <> 0')}, {has('restricted_area_violations', 'k % 6 = 0')}, {has('distance_budget', 'CASE WHEN k % 13 <> 0 THEN k % 9 <> 0 END')}) END AS scsr",
        f"CASE WHEN k % 10 = 0 THEN cast(map() AS map<string, boolean>) ELSE map({has('specific_exhibit_coverage', 'k % 3 <> 1')}, {has('attribute_validations', 'k % 4 <> 1')}) END AS scar",
        "CASE WHEN k % 17 <> 0 THEN round(o_totalprice % 100, 2) END AS fidelity",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, line_no, line)"""
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS task", "CASE WHEN event_id % 9 = 0 THEN concat('  continued ', event_type) ELSE concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' - INFO - ', event_type) END AS line").selectExpr("task", "event_id AS line_no", "line")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, txt): route answers, bare, fenced, in prose, broken or out of bounds"""
    route = "concat('[[', x, ',', y, '],[', x + 7, ',', y + 3, '],[', y, ',', x, ']]')"
    txt = f"""CASE id % 6 WHEN 0 THEN {route} WHEN 1 THEN concat('```json\\n', {route}, '\\n```') WHEN 2 THEN concat('The route is ', {route}, ' as asked.')
        WHEN 3 THEN concat('[[', x, ',', y, ']]') WHEN 4 THEN 'no route' ELSE concat('[[', x, ',', y, '],[', x + 900, ',', y, ']]') END AS txt"""
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "cast(floor(value) AS bigint) * 7 % 500 AS x", "event_id % 500 AS y").selectExpr("id", txt)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, txt): answers with lists of exhibit numbers"""
    listed = "concat('[', k % 50, ', ', k * 7 % 50, ']')"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k AS id", f"CASE k % 4 WHEN 0 THEN {listed} WHEN 1 THEN concat('I choose ', {listed}, ' [x]') WHEN 2 THEN 'none' ELSE concat('[', k % 50, ']') END AS txt")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route, x, y), dealt by route before repeated ones go, as packed rows are few bytes for the many that a task would get."""
    return shared.dealt(table(spark, sf_dir, "events").selectExpr("user_id AS route", "cast(floor(value) AS bigint) % 24 AS x", "event_id % 24 AS y")).distinct()


def colors(spark: SparkSession, sf_dir: str, original: bool) -> DataFrame:
    """(img, h, s, v): drawn pixels (mostly of one colour an image), or the original image's"""
    p = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS img", "l_orderkey AS a", "l_partkey AS b", "l_linenumber AS c")
    if original:
        return p.selectExpr("img", "(b * 11 + c) % 180 AS h", "a % 120 AS s", "(a + b) % 256 AS v")
    return p.selectExpr("img", "CASE WHEN c <= 4 THEN img * 5 % 180 ELSE b % 180 END AS h", "CASE WHEN c <= 3 THEN 200 + c ELSE a % 256 END AS s", "CASE WHEN c <= 4 THEN 210 ELSE b % 256 END AS v")


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, line_no, line)"""
    n = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k")
    sections = "CASE k % 3 WHEN 0 THEN 'Economy' WHEN 1 THEN 'SMALL' ELSE 'large' END"
    line = f"""CASE k % 5 WHEN 0 THEN concat(k % 30, '-', k % 30 + k % 4, ': ', {sections}) WHEN 1 THEN concat(k % 40, ':', {sections}) WHEN 2 THEN '# comment: 3' WHEN 3 THEN concat(k % 9, ' - ', k % 9 + 2, ' :  ', {sections}) ELSE 'x-2: nothing' END AS line"""
    return n.selectExpr("k % 50 AS layout", "k AS line_no", line)


def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): task files of layouts, and files that are none"""
    name = "CASE k % 5 WHEN 0 THEN 'easy_semantic' WHEN 1 THEN 'easy_spatial' WHEN 2 THEN concat('medium_', k % 11) WHEN 3 THEN concat('hard_', k % 7) ELSE 'notes' END"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").selectExpr(f"concat('plans/', CASE k % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'complex' ELSE 'draft' END, '/layout_', k % 24, '/', {name}, '.json') AS path")


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): files in result folders, some of which lack final_results.json"""
    name = "CASE k % 4 WHEN 0 THEN concat('medium/', c, '/medium_', k % 11) WHEN 1 THEN concat('hard/', c, '/hard_', k % 7) WHEN 2 THEN concat('easy_semantic/', c, '/easy_semantic') ELSE concat('easy_spatial/', c, '/easy_spatial') END"
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CASE o_orderkey % 2 WHEN 0 THEN 'simple' ELSE 'complex' END AS c")
    return keys.selectExpr(f"concat('m', k % 3, '/', {name}, '_layout_', k % 24, CASE WHEN k % 6 = 5 THEN '/run.log' ELSE '/final_results.json' END) AS path")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, id, exhibit_number): annotations, some of which have no whole number"""
    number = "CASE k % 6 WHEN 0 THEN 'x' WHEN 1 THEN cast(null AS string) WHEN 2 THEN concat(k % 90, '') ELSE concat(k, '') END"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k").selectExpr("k % 4 AS layout", "concat('exhibit_', k) AS id", f"{number} AS exhibit_number")


def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path)"""
    folder = "CASE k % 3 WHEN 0 THEN concat('m', k % 5, '(high)') ELSE concat('m', k % 5) END"
    path = f"""CASE k % 4 WHEN 0 THEN concat({folder}, '/hard/simple/hard_0', k % 7, '_layout_', k % 48) WHEN 1 THEN concat({folder}, '\\\\medium\\\\complex\\\\medium_0', k % 3, '_layout_', k % 48)
        WHEN 2 THEN concat({folder}, '/easy_spatial/simple/easy_spatial_layout_', k % 48) ELSE concat({folder}, '/short/path') END AS path"""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr(path)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
