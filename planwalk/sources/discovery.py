"""What there is to run, from a listing of files: rows (path) of plans' task configurations and of results.

Only names are looked at, so a listing may come from `files.listing` or from any table of paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names of task files: single ones, and those of which a layout has several.
SINGLE = ("easy_semantic", "easy_spatial")
SEVERAL = ("medium", "hard")


def layouts(files: DataFrame) -> DataFrame:
    """(complexity, layout) of every folder `.../complexity/layout_NN/` that holds a file."""
    pattern = r"([^/]+)/(layout_[^/]+)/[^/]+$"
    return files.select(F.regexp_extract("path", pattern, 1).alias("complexity"), F.regexp_extract("path", pattern, 2).alias("layout")).where("layout <> ''").distinct()


def select(df: DataFrame, **wanted: str | list[str] | None) -> DataFrame:
    """The rows whose columns have the wanted values: null takes all, a text that one, a list those in it.

    An empty text or list selects nothing and is an error, as is a selection that nothing meets."""
    for column, values in wanted.items():
        if values is None:
            continue
        if not values:
            raise ValueError(f"no {column} was named")
        df = df.where(F.col(column).isin(values if isinstance(values, list) else [values]))
    if wanted and df.isEmpty():
        raise ValueError(f"nothing is left of {', '.join(k for k, v in wanted.items() if v is not None)}")
    return df


def tasks(files: DataFrame, complexities: tuple[str, ...] = ("simple", "complex")) -> DataFrame:
    """(complexity, layout, difficulty, task_file) of the expected tasks: the single ones, and all of the numbered ones, in
    folders `.../complexity/layout/`."""
    pattern = r"([^/]+)/([^/]+)/([^/]+)\.json$"
    named = files.select(*[F.regexp_extract("path", pattern, k + 1).alias(c) for k, c in enumerate(("complexity", "layout", "task"))])
    several = F.regexp_extract("task", f"^({'|'.join(SEVERAL)})_", 1)
    difficulty = F.when(F.col("task").isin(*SINGLE), F.col("task")).otherwise(F.nullif(several, F.lit("")))
    return named.where(F.col("complexity").isin(*complexities)).select("complexity", "layout", difficulty.alias("difficulty"), F.concat("task", F.lit(".json")).alias("task_file")).where("difficulty IS NOT NULL").distinct()


def variants(files: DataFrame, pattern: str) -> DataFrame:
    """(complexity, layout, variant, place) of the task files that fit a file pattern with `*`, numbered by name from 1 in each layout."""
    from pyspark.sql import Window

    like = "^" + ".*".join(f"\\Q{x}\\E" for x in pattern.split("*")) + "$"
    split = r"([^/]+)/(layout_[^/]+)/([^/]+)$"
    named = files.select(*[F.regexp_extract("path", split, k + 1).alias(c) for k, c in enumerate(("complexity", "layout", "file"))]).where(F.col("file").rlike(like) & (F.col("layout") != "")).distinct()
    found = named.select("complexity", "layout", F.regexp_replace("file", r"\.[^.]*$", "").alias("variant"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("complexity", "layout").orderBy("variant")).cast("bigint"))


def missing_folders(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(model, difficulty, complexity, layout, task_file, path): expected tasks for which a model of the listing `results`
    has no folder `model/difficulty/complexity/task_layout/`."""
    from planwalk.operators.scoring import result_folder

    split = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/[^/]+$"
    there = results.select(*[F.regexp_extract("path", split, k + 1).alias(c) for k, c in enumerate(("model", "difficulty", "complexity", "folder"))]).where("model <> ''").distinct()
    wanted = expected.withColumn("folder", result_folder(F.col("task_file"), F.col("layout"))).withColumn("every_", F.lit(1))
    models = there.select("model").distinct().withColumn("every_", F.lit(1))
    # each model should have each task: the result is as large as the join
    lost = wanted.join(models, "every_").drop("every_").join(there, ["model", "difficulty", "complexity", "folder"], "left_anti")
    return lost.select("model", "difficulty", "complexity", "layout", "task_file", F.concat_ws("/", "model", "difficulty", "complexity", "folder").alias("path"))
