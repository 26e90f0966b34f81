"""Scores, leaderboards, runtimes, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwalk.functions import text
from planwalk.operators import scoring
from planwalk.plans.registry import query
from planwalk.sources import bindings as b
from planwalk.sources import discovery, files


@query("res score", "SELECT k, svr_passed, 4::BIGINT AS svr_total, scsr_passed::BIGINT AS scsr_passed, scsr_total::BIGINT AS scsr_total, scar_passed::BIGINT AS scar_passed, scar_total::BIGINT AS scar_total FROM (SELECT * REPLACE (svr_passed::BIGINT AS svr_passed) FROM score)")
def score_fraction(spark, sf_dir):
    r = b.results(spark, sf_dir)
    parts = {"svr": scoring.fraction(F.col("svr"), scoring.SVR, True), "scsr": scoring.fraction(F.col("scsr"), scoring.SCSR, False), "scar": scoring.fraction(F.col("scar"), scoring.SCAR, False)}
    return r.select("k", *[v[f].alias(f"{k}_{f}") for k, v in parts.items() for f in ("passed", "total")])


def _binary(spark, sf_dir):
    r = b.results(spark, sf_dir)
    return r.select("k", "model", "difficulty", "complexity", scoring.binary(F.col("svr"), scoring.SVR).alias("svr"), scoring.binary(F.col("scsr"), scoring.SCSR).alias("scsr"), scoring.binary(F.col("scar"), scoring.SCAR).alias("scar"))


_RATES = ", ".join(f"sum({m})::BIGINT AS {m}_correct, round(100.0::DOUBLE * sum({m}) / count(*), 2) AS {m}_pct" for m in ("svr", "scsr", "scar"))


@query("res score bin", f"SELECT difficulty, complexity, count(*) AS n, {_RATES} FROM bin GROUP BY difficulty, complexity")
def score_binary(spark, sf_dir):
    return scoring.success_rates(_binary(spark, sf_dir), ["difficulty", "complexity"], ["svr", "scsr", "scar"])


@query("res", "SELECT k, CASE WHEN connectivity AND wall AND collision AND area THEN 1 ELSE 0 END AS svr, CASE WHEN start_end AND (NOT full_scsr OR (must_pass AND restricted AND coalesce(budget, true))) THEN 1 ELSE 0 END AS scsr, CASE WHEN has_scar AND specific AND attributes THEN 1 ELSE 0 END AS scar FROM res")
def score_binary_raw(spark, sf_dir):
    return b.results(spark, sf_dir).select("k", *[scoring.binary_raw(F.col(c)).alias(c) for c in ("svr", "scsr", "scar")])


@query("res", "SELECT k, CASE k % 4 WHEN 0 THEN 'easy_spatial' WHEN 1 THEN 'easy_semantic' WHEN 2 THEN 'medium' ELSE 'hard' END AS difficulty, false AS connectivity, true AS wall_crossings, false AS start_end, CASE WHEN k % 4 <> 1 THEN true END AS restricted, CASE WHEN k % 4 = 3 THEN false END AS budget, CASE WHEN k % 4 = 3 THEN 4 WHEN k % 4 = 2 THEN 3 WHEN k % 4 = 1 THEN 2 ELSE 1 END AS n_scar FROM res")
def failure_record(spark, sf_dir):
    order = F.element_at(F.array(*[F.lit(x) for x in ("easy_spatial", "easy_semantic", "medium", "hard")]), (F.col("k") % 4 + 1).cast("int"))
    made = b.results(spark, sf_dir).select("k", order.alias("difficulty")).withColumn("f", scoring.failure(F.col("difficulty")))
    at = lambda part, name: F.try_element_at(f"f.{part}", F.lit(name))
    return made.select("k", "difficulty", at("svr", "connectivity").alias("connectivity"), at("svr", "wall_crossings").alias("wall_crossings"), at("scsr", "start_end_location").alias("start_end"), at("scsr", "restricted_area_violations").alias("restricted"), at("scsr", "distance_budget").alias("budget"), F.size("f.scar").alias("n_scar"))


_PIVOT = "pv AS (SELECT difficulty, metric, " + ", ".join(f"min(pct) FILTER (WHERE model = 'm{k}') AS m{k}" for k in range(5)) + " FROM (" + " UNION ALL ".join(f"SELECT model, difficulty, '{m}' AS metric, round(100.0::DOUBLE * sum({m}) / count(*), 2) AS pct FROM bin GROUP BY model, difficulty" for m in ("svr", "scsr", "scar")) + ") GROUP BY difficulty, metric)"


@query("res score bin", f"WITH {_PIVOT} SELECT difficulty, metric, m0, m1, m2, m3, m4, CASE WHEN lag(difficulty) OVER w = difficulty THEN '' ELSE difficulty END AS shown, coalesce(lag(difficulty) OVER w <> difficulty, false) AS rule FROM pv WINDOW w AS (ORDER BY difficulty, metric)")
def score_pivot(spark, sf_dir):
    rates = scoring.success_rates(_binary(spark, sf_dir), ["model", "difficulty"], ["svr", "scsr", "scar"])
    long = rates.selectExpr("model", "difficulty", "stack(3, 'svr', svr_pct, 'scsr', scsr_pct, 'scar', scar_pct) AS (metric, pct)")
    table = scoring.pivot_models(long, ["difficulty", "metric"], "pct", [f"m{k}" for k in range(5)])
    return scoring.blank_repeats(table, "difficulty", ["difficulty", "metric"])


@query("res score bin", "SELECT model || ' & ' || string_agg(difficulty || ':' || n, ' & ' ORDER BY difficulty) AS line FROM (SELECT model, difficulty, sum(svr)::BIGINT AS n FROM bin GROUP BY model, difficulty) GROUP BY model")
def summary_line(spark, sf_dir):
    per = _binary(spark, sf_dir).groupBy("model", "difficulty").agg(F.sum("svr").alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("difficulty", "n"))), lambda x: F.concat_ws(":", x["difficulty"], x["n"].cast("string")))
    return per.groupBy("model").agg(parts.alias("p")).select(F.concat_ws(" & ", "model", F.concat_ws(" & ", "p")).alias("line"))


@query("res", "SELECT model, CASE WHEN grouping(difficulty) = 1 THEN 'All' ELSE difficulty END AS difficulty, round(avg(fidelity), 4) AS mean, count(fidelity) AS n_found, count(*) FILTER (WHERE fidelity IS NULL) AS n_skipped FROM res GROUP BY GROUPING SETS ((model, difficulty), (model))")
def fidelity_report(spark, sf_dir):
    return scoring.micro_average(b.results(spark, sf_dir), "fidelity")


def _runtimes(spark, sf_dir):
    return scoring.runtimes(b.log_lines(spark, sf_dir).withColumn("at", text.log_time(F.col("line"))), ["task"])


@query("logs span", "SELECT * FROM span")
def runtime_span(spark, sf_dir):
    return _runtimes(spark, sf_dir)


@query("logs span", "WITH v AS (SELECT 'm' || (task % 5) AS model, CASE WHEN task % 31 = 0 THEN seconds * 5 ELSE seconds END AS seconds FROM span WHERE seconds IS NOT NULL), s AS (SELECT model, list_sort(list(seconds)) AS l, count(*) AS n FROM v GROUP BY model), f AS (SELECT model, n, l[n // 4 + 1] AS q1, l[3 * n // 4 + 1] AS q3 FROM s), g AS (SELECT v.*, f.n, f.n < 4 OR v.seconds BETWEEN f.q1 - 1.5 * (f.q3 - f.q1) AND f.q3 + 1.5 * (f.q3 - f.q1) AS good FROM v JOIN f ON v.model = f.model) SELECT model, any_value(n) AS n, count(*) FILTER (WHERE good) AS n_kept, round(avg(seconds) FILTER (WHERE good), 4) AS mean, min(seconds) FILTER (WHERE good) AS least, max(seconds) FILTER (WHERE good) AS most, coalesce(string_agg(printf('%.1f', seconds), ',' ORDER BY seconds) FILTER (WHERE NOT good), '') AS outliers FROM g GROUP BY model")
def runtime_iqr(spark, sf_dir):
    v = _runtimes(spark, sf_dir).selectExpr("concat('m', task % 5) AS model", "CASE WHEN task % 31 = 0 THEN seconds * 5 ELSE seconds END AS seconds")
    return scoring.trimmed(v, ["model"], "seconds")


def _audit(spark, sf_dir):
    r = b.results(spark, sf_dir)
    return r.select("model"), r.select("complexity", "layout").distinct(), r.where("k % 3 > 0").select("model", "complexity", "layout")


_MISSING = "mo AS (SELECT DISTINCT model FROM res), ex AS (SELECT DISTINCT complexity, layout FROM res), ms AS (SELECT mo.model, ex.complexity, ex.layout FROM mo CROSS JOIN ex WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.k % 3 > 0 AND r.model = mo.model AND r.complexity = ex.complexity AND r.layout = ex.layout))"


@query("res", f"WITH {_MISSING} SELECT * FROM ms")
def expected_missing(spark, sf_dir):
    return scoring.missing_results(*_audit(spark, sf_dir), ["complexity", "layout"])


@query("res", f"WITH {_MISSING} SELECT mo.model, (SELECT count(*) FROM ex) AS n_expected, count(ms.layout) AS n_missing, round(100.0::DOUBLE * ((SELECT count(*) FROM ex) - count(ms.layout)) / (SELECT count(*) FROM ex), 1) AS completion_pct FROM mo LEFT JOIN ms ON mo.model = ms.model GROUP BY mo.model")
def completion(spark, sf_dir):
    models, expected, present = _audit(spark, sf_dir)
    return scoring.completion(models, expected, scoring.missing_results(models, expected, present, ["complexity", "layout"]))


@query("gone", r"SELECT folder, difficulty, complexity, task, string_agg(DISTINCT layout, ',' ORDER BY layout) AS layouts, count(DISTINCT layout) AS n FROM (SELECT p[1] AS folder, p[2] AS difficulty, p[3] AS complexity, CASE WHEN p[2] LIKE 'easy%' THEN NULL ELSE regexp_extract(p[4], '^(.*)_layout_', 1) END AS task, regexp_extract(p[4], '(layout_[^_]*)$', 1) AS layout FROM (SELECT string_split(replace(path, '\', '/'), '/') AS p FROM gone) WHERE len(p) = 4) GROUP BY ALL")
def rerun_groups(spark, sf_dir):
    return scoring.rerun_groups(b.missing_paths(spark, sf_dir))


@query("gone", r"SELECT DISTINCT split_part(replace(path, '\', '/'), '/', 1) AS folder, CASE WHEN path LIKE '%(%' THEN split_part(path, '(', 1) ELSE split_part(replace(path, '\', '/'), '/', 1) END AS model, CASE WHEN path LIKE '%(%' THEN 'high' END AS reasoning FROM gone")
def model_names(spark, sf_dir):
    folder = F.get(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), F.lit(0))
    return b.missing_paths(spark, sf_dir).select(folder.alias("folder")).distinct().select("folder", text.model_parts(F.col("folder")).alias("p")).select("folder", "p.model", "p.reasoning")


_SHARE = "round(avg(CASE WHEN {0}_total > 0 THEN 100.0::DOUBLE * {0}_passed / {0}_total END), 4) AS {0}"


@query("res score", f"SELECT model, difficulty, count(*) AS n, {', '.join(_SHARE.format(m) for m in ('scsr', 'scar'))}, round(avg(100.0::DOUBLE * svr_passed / 4), 4) AS svr FROM score GROUP BY model, difficulty")
def quick_metrics(spark, sf_dir):
    return scoring.quick_metrics(b.results(spark, sf_dir), ["model", "difficulty"])


@query("res", "SELECT model, complexity, count(*) FILTER (WHERE coalesce(budget, false)) AS n_success, count(*) FILTER (WHERE NOT coalesce(budget, false)) AS n_failed, count(*) FILTER (WHERE coalesce(budget, false)) = 0 AS all_failed FROM (SELECT *, CASE WHEN full_scsr THEN budget END AS b FROM res) GROUP BY model, complexity".replace("budget, false", "b, false"))
def run_totals(spark, sf_dir):
    runs = b.results(spark, sf_dir).withColumn("good", F.try_element_at("scsr", F.lit("distance_budget")))
    return scoring.totals(runs, ["model", "complexity"], "good")


_NAMES = "(VALUES ('easy_spatial', 0), ('easy_semantic', 1), ('medium', 2), ('hard', 3)) AS d(difficulty, place)"


@query("tfile", rf"WITH t AS (SELECT regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)\.json$', 3) AS task FROM tfile), k AS (SELECT CASE WHEN task IN ('easy_semantic', 'easy_spatial') THEN task WHEN regexp_matches(task, '^(medium|hard)_') THEN regexp_extract(task, '^(medium|hard)_', 1) ELSE task END AS difficulty FROM t) SELECT k.difficulty, coalesce(any_value(d.place), 4)::BIGINT AS place, any_value(CASE k.difficulty WHEN 'easy_semantic' THEN 'Easy Semantic' WHEN 'easy_spatial' THEN 'Easy Spatial' WHEN 'medium' THEN 'Medium' WHEN 'hard' THEN 'Hard' ELSE 'Notes' END) AS label, CASE WHEN k.difficulty LIKE 'easy\_%' ESCAPE '\' THEN 'easy' ELSE k.difficulty END AS grp, CASE WHEN any_value(d.place) IS NOT NULL THEN 'prompts_' || k.difficulty || '.py' END AS runner, to_base64(encode(k.difficulty)) AS coded, count(*) AS n FROM k LEFT JOIN {_NAMES} ON k.difficulty = d.difficulty GROUP BY k.difficulty")
def difficulty_labels(spark, sf_dir):
    """Names of difficulties as tables show them, in their order, with those of unknown task files last."""
    task = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    name = F.when(task.rlike("^(medium|hard)_"), F.regexp_extract(task, "^(medium|hard)_", 1)).otherwise(task)
    each = b.task_files(spark, sf_dir).groupBy(name.alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))
    d = F.col("difficulty")
    return each.select("difficulty", scoring.difficulty_order(d).cast("bigint").alias("place"), scoring.difficulty_label(d).alias("label"), scoring.difficulty_group(d).alias("grp"), scoring.runner(d).alias("runner"), F.base64(F.encode(d, "utf-8")).alias("coded"), "n")


_TASKS = r"tk AS (SELECT DISTINCT complexity, layout, task || '.json' AS task_file, CASE WHEN task IN ('easy_semantic', 'easy_spatial') THEN task ELSE regexp_extract(task, '^(medium|hard)_', 1) END AS difficulty FROM (SELECT regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)\.json$', 1) AS complexity, regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)\.json$', 2) AS layout, regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)\.json$', 3) AS task FROM tfile) WHERE complexity IN ('simple', 'complex') AND (task IN ('easy_semantic', 'easy_spatial') OR regexp_matches(task, '^(medium|hard)_')))"


@query("tfile", f"WITH {_TASKS} SELECT * FROM tk")
def expected_tasks(spark, sf_dir):
    return discovery.tasks(b.task_files(spark, sf_dir))


@query("tfile", r"SELECT DISTINCT regexp_extract(path, '([^/]+)/(layout_[^/]+)/[^/]+$', 1) AS complexity, regexp_extract(path, '([^/]+)/(layout_[^/]+)/[^/]+$', 2) AS layout FROM tfile WHERE path LIKE 'plans/complex/%'")
def layout_selection(spark, sf_dir):
    return discovery.select(discovery.layouts(b.task_files(spark, sf_dir)), complexity="complex", layout=None)


@query("tfile", r"SELECT complexity, layout, variant, row_number() OVER (PARTITION BY complexity, layout ORDER BY variant) AS place FROM (SELECT DISTINCT regexp_extract(path, '([^/]+)/(layout_[^/]+)/([^/]+)\.json$', 1) AS complexity, regexp_extract(path, '([^/]+)/(layout_[^/]+)/([^/]+)\.json$', 2) AS layout, regexp_extract(path, '([^/]+)/(layout_[^/]+)/([^/]+)\.json$', 3) AS variant FROM tfile) WHERE variant LIKE 'medium\_%' ESCAPE '\'")
def config_variants(spark, sf_dir):
    return discovery.variants(b.task_files(spark, sf_dir), "medium_*.json")


_LOST = rf"{_TASKS}, ff AS (SELECT regexp_extract(path, '^([^/]+)/', 1) AS model, regexp_extract(path, '^[^/]+/([^/]+)/', 1) AS difficulty, regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir, regexp_extract(path, '([^/]+)$', 1) AS file FROM rfile), lf AS (SELECT m.model, t.difficulty, m.model || '/' || t.difficulty || '/' || t.complexity || '/' || replace(t.task_file, '.json', '') || '_' || t.layout AS path FROM tk t CROSS JOIN (SELECT DISTINCT model FROM ff) m WHERE path NOT IN (SELECT dir FROM ff)), lr AS (SELECT DISTINCT model, difficulty, dir AS path FROM ff GROUP BY model, difficulty, dir HAVING NOT bool_or(file = 'final_results.json'))"


@query("tfile rfile", f"WITH {_LOST} SELECT model, difficulty, string_agg(path, ',' ORDER BY path) AS paths, count(*) AS n, sum(f)::BIGINT AS n_folders, (count(*) - sum(f))::BIGINT AS n_files FROM (SELECT *, 1 AS f FROM lf UNION ALL SELECT *, 0 FROM lr) GROUP BY model, difficulty")
def missing_merged(spark, sf_dir):
    """Missing result folders and folders without a result, of each model and difficulty."""
    there = b.result_files(spark, sf_dir)
    folders = discovery.missing_folders(discovery.tasks(b.task_files(spark, sf_dir)), there)
    empty = files.folders_without(there, "final_results.json").select(F.split("dir", "/").alias("p"), F.col("dir").alias("path")).select(F.get("p", F.lit(0)).alias("model"), F.get("p", F.lit(1)).alias("difficulty"), "path")
    return scoring.missing_paths(folders, empty)
