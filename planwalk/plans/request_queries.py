"""What tasks ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwalk.operators import requests
from planwalk.plans.registry import query
from planwalk.sources import bindings as b


def _constraints():
    return F.create_map(F.lit("category"), F.col("categories"), F.lit("material"), F.col("materials"), F.lit("place"), F.col("places"), F.lit("technique"), F.col("techniques"))


@query("tasks", "SELECT task, concat_ws(',', CASE WHEN len(cats) > 0 THEN 'category' END, CASE WHEN len(mats) > 0 THEN 'material' END, CASE WHEN len(places) > 0 THEN 'place' END, CASE WHEN len(techs) > 0 THEN 'technique' END) AS names, CASE WHEN len(cats) > 0 THEN 'visit all of [\"' || array_to_string(cats, '\",\"') || '\"]' ELSE 'any section' END AS sections FROM tasks")
def required_constraints(spark, sf_dir):
    return b.tasks(spark, sf_dir).select("task", F.concat_ws(",", requests.non_empty(_constraints())).alias("names"), requests.listed(F.col("categories"), "visit all of {}", "any section").alias("sections"))


@query("tasks", "SELECT task, CASE WHEN task % 3 > 0 THEN CAST(round_even((1500 + task * 7) / (10.0::DOUBLE + task % 5), 0) AS INT) END AS shown_px, CAST(greatest(min_n, len(list_distinct(specific))) AS BIGINT) AS n_exhibits FROM tasks")
def request_numbers(spark, sf_dir):
    scale = F.when(F.col("task") % 3 > 0, 10.0 + F.col("task") % 5)
    return b.tasks(spark, sf_dir).select("task", requests.shown_distance(1500 + F.col("task") * 7, scale).alias("shown_px"), requests.target_count(F.col("min_n"), F.col("specific")).cast("bigint").alias("n_exhibits"))


@query("res", "SELECT model, CASE WHEN grouping(difficulty) = 1 THEN 'All' ELSE difficulty END AS difficulty, count(*) AS n FROM res WHERE k % 3 = 0 GROUP BY GROUPING SETS ((model, difficulty), (model))")
def missing_report(spark, sf_dir):
    return requests.missing_report(b.results(spark, sf_dir).where("k % 3 = 0"))


@query("tasks", "SELECT task, CASE WHEN len(specific) > 0 THEN 'visit exhibits [' || array_to_string(specific, ',') || ']' ELSE 'any exhibits' END AS exhibits, CASE WHEN task % 3 = 0 THEN 'any length' ELSE 'at most ' || printf('%.1f', (150000 + task * 700) / 1000.0::DOUBLE) || ' m' END AS budget FROM tasks")
def request_texts(spark, sf_dir):
    mm = F.when(F.col("task") % 3 == 0, F.lit(1_000_000_000)).otherwise(150_000 + F.col("task") * 700)
    return b.tasks(spark, sf_dir).select("task", requests.listed(F.col("specific"), "visit exhibits {}", "any exhibits").alias("exhibits"), requests.budget_text(mm).alias("budget"))


@query("pick exh", r"SELECT p.id, count(e.ex_id) AS n_selected, CASE WHEN NOT any_value(p.has) THEN 'no ids' WHEN count(e.ex_id) = 0 THEN 'none known' ELSE 'ok' END AS status FROM (SELECT id, regexp_matches(txt, '\[[\d, ]+\]') AS has, unnest(CASE WHEN regexp_matches(txt, '\[[\d, ]+\]') THEN list_distinct(list_transform(string_split(regexp_extract(txt, '\[([\d, ]+)\]', 1), ','), lambda x: CAST(x AS BIGINT))) ELSE [NULL::BIGINT] END) AS n FROM pick) p LEFT JOIN (SELECT ex_id FROM exh WHERE ex_id % 3 > 0) e ON p.n = e.ex_id GROUP BY p.id")
def id_selection(spark, sf_dir):
    """How many known exhibits an answer selects; one that selects none is an error."""
    known = b.exhibits(spark, sf_dir).where("ex_id % 3 > 0").select("ex_id")
    return requests.selection(b.picks(spark, sf_dir), known)
