"""Scores, leaderboards, runtimes and completeness of many models' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed names of the checks; a violation passes when it is false, everything else when it is true.
SVR = ("connectivity", "wall_crossings", "exhibit_collision", "out_of_area_violations")
SCSR = ("start_end_location", "must_pass_regions", "restricted_area_violations", "distance_budget")
SCAR = ("specific_exhibit_coverage", "at_least_n_exhibits_coverage", "exhibit_category_coverage", "attribute_validations")
PASS_WHEN_FALSE = ("wall_crossings", "exhibit_collision", "out_of_area_violations", "restricted_area_violations")
# Fixed fields of a result for each difficulty.
FIELDS = {
    "easy_spatial": (SVR, SCSR[:3], ("at_least_n_exhibits_coverage",)),
    "easy_semantic": (SVR, SCSR[:1], ("exhibit_category_coverage", "attribute_validations")),
    "medium": (SVR, SCSR[:3], ("at_least_n_exhibits_coverage", "exhibit_category_coverage", "attribute_validations")),
    "hard": (SVR, SCSR, SCAR),
}


def _passes(m: Column, k: str) -> Column:
    """Whether check k of a boolean map passes; a null or missing value doesn't."""
    v = F.try_element_at(m, F.lit(k))
    return F.coalesce(~v if k in PASS_WHEN_FALSE else v, F.lit(False))


def fraction(m: Column, checks: tuple[str, ...], absent_fails: bool) -> Column:
    """struct(passed, total): passed checks of those in the map, or of all if absent ones fail."""
    passed = sum((_passes(m, k).cast("int") for k in checks), F.lit(0))
    total = F.lit(len(checks)) if absent_fails else sum((F.map_contains_key(m, F.lit(k)).cast("int") for k in checks), F.lit(0))
    return F.struct(passed.cast("bigint").alias("passed"), total.cast("bigint").alias("total"))


def binary(m: Column, checks: tuple[str, ...]) -> Column:
    """1 if every check in the map passes by its own polarity, 0 if any fails or the map is empty."""
    failed = [F.map_contains_key(m, F.lit(k)) & ~_passes(m, k) for k in checks]
    some = failed[0]
    for x in failed[1:]:
        some = some | x
    return F.when((F.coalesce(F.size(m), F.lit(0)) <= 0) | some, 0).otherwise(1)


def binary_raw(m: Column) -> Column:
    """1 unless the map is empty or any value is false, whatever false means for it."""
    return F.when((F.size(m) <= 0) | F.exists(F.map_values(m), lambda v: ~F.coalesce(v, F.lit(True))), 0).otherwise(1)


def failure(difficulty: Column) -> Column:
    """struct(svr, scsr, scar) of a task without any answer: each check as if it failed."""

    def record(fields: tuple[tuple[str, ...], ...]) -> Column:
        def part(names: tuple[str, ...]) -> Column:
            return F.create_map(*[F.lit(x) for k in names for x in (k, k in PASS_WHEN_FALSE)])

        return F.struct(*[part(x).alias(n) for n, x in zip(("svr", "scsr", "scar"), fields)])

    out = None
    for k, fields in FIELDS.items():
        out = F.when(difficulty == k, record(fields)) if out is None else out.when(difficulty == k, record(fields))
    return out


def quick_metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, svr, scsr, scar): mean share of passed checks in percent over results(svr, scsr, scar maps); a result without
    any check of a category is left out of that category."""
    shares = []
    for name, checks in (("svr", SVR), ("scsr", SCSR), ("scar", SCAR)):
        f = fraction(F.col(name), checks, False)
        shares.append(F.when(f["total"] > 0, 100.0 * f["passed"] / f["total"]).alias(name))
    marked = results.select(*by, *shares)
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("svr", "scsr", "scar")])


def totals(runs: DataFrame, by: list[str], succeeded: str) -> DataFrame:
    """(by, n_success, n_failed, all_failed): a null outcome is a failure."""
    good = F.coalesce(F.col(succeeded), F.lit(False))
    out = runs.groupBy(*by).agg(F.count_if(good).alias("n_success"), F.count_if(~good).alias("n_failed"))
    return out.withColumn("all_failed", F.col("n_success") == 0)


def difficulty_order(difficulty: Column) -> Column:
    """Place of a difficulty in tables; unknown ones come last."""
    out = F.lit(len(FIELDS))
    for k, name in reversed(list(enumerate(FIELDS))):
        out = F.when(difficulty == name, k).otherwise(out)
    return out


def difficulty_label(difficulty: Column) -> Column:
    """A difficulty as tables show it: words with capitals, without underscores."""
    return F.initcap(F.replace(difficulty, F.lit("_"), F.lit(" ")))


def difficulty_group(difficulty: Column) -> Column:
    """`easy` for both easy ones, else the difficulty itself."""
    return F.when(difficulty.startswith("easy_"), "easy").otherwise(difficulty)


def runner(difficulty: Column) -> Column:
    """Name of the program that runs a difficulty's tasks; null for an unknown one."""
    return F.when(difficulty.isin(*FIELDS), F.concat(F.lit("prompts_"), difficulty, F.lit(".py")))


def success_rates(scored: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by, n, and for each 0/1 metric its sum and its share in percent."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [F.sum(m).cast("bigint").alias(f"{m}_correct"), F.round(100.0 * F.sum(m) / F.count(F.lit(1)), 2).alias(f"{m}_pct")]
    return scored.groupBy(*by).agg(*aggs)


def micro_average(results: DataFrame, value: str) -> DataFrame:
    """(model, difficulty, mean, n_found, n_skipped) for each difficulty and, as `All`, each model; nulls are skipped."""
    sets = results.groupingSets([[F.col("model"), F.col("difficulty")], [F.col("model")]], "model", "difficulty")
    out = sets.agg(F.grouping("difficulty").alias("g"), F.round(F.avg(value), 4).alias("mean"), F.count(value).alias("n_found"), F.count_if(F.col(value).isNull()).alias("n_skipped"))
    return out.select("model", F.when(F.col("g") == 1, "All").otherwise(F.col("difficulty")).alias("difficulty"), "mean", "n_found", "n_skipped")


def macro_average(results: DataFrame, value: str) -> DataFrame:
    """(difficulty, mean, n_models): the mean of the models' means."""
    each = results.groupBy("model", "difficulty").agg(F.avg(value).alias("m"))
    return each.groupBy("difficulty").agg(F.round(F.avg("m"), 4).alias("mean"), F.count("m").alias("n_models"))


def pivot_models(scores: DataFrame, keys: list[str], value: str, models: list[str]) -> DataFrame:
    """keys, one column a model."""
    return scores.groupBy(*keys).pivot("model", models).agg(F.min(value))


def blank_repeats(table: DataFrame, column: str, order: list[str]) -> DataFrame:
    """table with `shown`: the column, blank where the row before has the same, and `rule`: whether a new group starts.

    For display tables: one window over all their rows, so hand over aggregated ones."""
    before = F.lag(column).over(Window.orderBy(*order))
    same = F.coalesce(before == F.col(column), F.lit(False))
    return table.withColumn("shown", F.when(same, "").otherwise(F.col(column))).withColumn("rule", ~same & before.isNotNull())


def runtimes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seconds: from the first to the last dated line in file order; null with fewer than two. lines have `at` and line_no."""
    dated = lines.where("at IS NOT NULL").groupBy(*keys).agg(F.min_by("at", "line_no").alias("a"), F.max_by("at", "line_no").alias("b"), F.count(F.lit(1)).alias("n"))
    seconds = F.when(F.col("n") >= 2, F.unix_timestamp("b") - F.unix_timestamp("a")).cast("double")
    return dated.select(*keys, seconds.alias("seconds"))


def trimmed(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, n_kept, mean, least, most, outliers: groups of four and more without values outside the quartiles by 1.5
    times their distance. Quartiles are the sorted values at n / 4 and 3 n / 4; if nothing is left, all count."""
    held = values.where(F.col(value).isNotNull())
    order = Window.partitionBy(*by).orderBy(value)
    place = held.withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    all_ = Window.partitionBy(*by)
    at = lambda k: F.max(F.when(F.col("k") == F.floor(k), F.col(value))).over(all_)
    fenced = place.withColumn("q1", at(F.col("n") / 4)).withColumn("q3", at(3 * F.col("n") / 4))
    gap = 1.5 * (F.col("q3") - F.col("q1"))
    good = (F.col("n") < 4) | F.col(value).between(F.col("q1") - gap, F.col("q3") + gap)
    marked = fenced.withColumn("good", good)
    marked = marked.withColumn("good", F.col("good") | ~F.bool_or("good").over(all_))
    kept = F.when(F.col("good"), F.col(value))
    out = marked.groupBy(*by).agg(F.max("n").alias("n"), F.count(kept).alias("n_kept"), F.round(F.avg(kept), 4).alias("mean"), F.min(kept).alias("least"), F.max(kept).alias("most"), F.sort_array(F.collect_list(F.when(~F.col("good"), F.col(value)))).alias("o"))
    return out.select(*by, "n", "n_kept", "mean", "least", "most", F.concat_ws(",", F.transform("o", lambda x: F.format_string("%.1f", x))).alias("outliers"))


def missing_results(models: DataFrame, expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """(model, keys) that every model should have and none of `present` has."""
    return models.select("model").distinct().join(expected.select(*keys).distinct(), how="cross").join(present, ["model", *keys], "left_anti")


def completion(models: DataFrame, expected: DataFrame, missing: DataFrame) -> DataFrame:
    """(model, n_expected, n_missing, completion_pct)."""
    total = expected.agg(F.count(F.lit(1)).alias("n_expected"))
    lost = missing.groupBy("model").agg(F.count(F.lit(1)).alias("n_missing"))
    every = models.select("model").distinct().join(total, how="cross").join(lost, "model", "left").fillna(0, ["n_missing"])
    pct = F.round(100.0 * (F.col("n_expected") - F.col("n_missing")) / F.nullif(F.col("n_expected"), F.lit(0)), 1)
    return every.select("model", "n_expected", "n_missing", pct.alias("completion_pct"))


def result_folder(task_file: Column, layout: Column) -> Column:
    """Name of the folder that a task's results go to: `hard_01.json` and `layout_03` give `hard_01_layout_03`."""
    return F.concat(F.regexp_replace(task_file, r"\.json", ""), F.lit("_"), layout)


def missing_paths(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(model, difficulty, paths, n, n_folders, n_files): what is missing, folders and result files (model, difficulty, path) alike, sorted and comma-joined."""
    both = folders.select("model", "difficulty", "path", F.lit(1).alias("folder")).unionByName(files.select("model", "difficulty", "path", F.lit(0).alias("folder")))
    out = both.groupBy("model", "difficulty").agg(F.sort_array(F.collect_list("path")).alias("p"), F.count(F.lit(1)).alias("n"), F.sum("folder").alias("n_folders"))
    return out.select("model", "difficulty", F.concat_ws(",", "p").alias("paths"), "n", "n_folders", (F.col("n") - F.col("n_folders")).alias("n_files"))


def parse_missing_path(path: Column) -> Column:
    """struct(folder, difficulty, complexity, task, layout) of `model/difficulty/complexity/[task_]layout_NN`; null unless it has four parts."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.get(parts, F.lit(3))
    pattern = r"^(.*)_layout_([^_]*)$"
    record = F.struct(
        F.get(parts, F.lit(0)).alias("folder"),
        F.get(parts, F.lit(1)).alias("difficulty"),
        F.get(parts, F.lit(2)).alias("complexity"),
        F.when(F.get(parts, F.lit(1)).startswith("easy_"), None).otherwise(F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))).alias("task"),
        F.regexp_extract(name, r"(layout_[^_]*)$", 1).alias("layout"),
    )
    return F.when(F.size(parts) == 4, record)


def rerun_groups(paths: DataFrame) -> DataFrame:
    """(folder, difficulty, complexity, task, layouts, n): the layouts to run again for each group, sorted and comma-joined."""
    parsed = paths.select(parse_missing_path(F.col("path")).alias("p")).where("p IS NOT NULL").select("p.*")
    return parsed.groupBy("folder", "difficulty", "complexity", "task").agg(F.concat_ws(",", F.sort_array(F.collect_set("layout"))).alias("layouts"), F.count_distinct("layout").alias("n"))
