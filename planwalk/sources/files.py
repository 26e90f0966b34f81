"""Readers of the files around a benchmark: fixed schemas, whole folders at once, path parts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACT = "id string, Section string, description string, `Production date` string, `Find spot` string, Materials string, Technique string"
_CONSTRAINTS = "date_constraint struct<in_range:array<string>,before_year:string,after_year:string>, material_constraint struct<materials:array<string>>, find_spot_constraint struct<locations:array<string>>, technique_constraint struct<techniques:array<string>>"
_NESTED = _CONSTRAINTS.replace("_constraint struct", "_constraint:struct").replace(", ", ",")
TASK = f"gallery_configs map<string,string>, distance_budget_in_mm bigint, exhibit_see_distance_in_mm bigint, exhibit_categories_to_cover array<string>, at_least_n_exhibits_to_cover int, specific_exhibit_to_cover array<int>, exhibit_attribute_constraints struct<{_NESTED},combined_constraint:struct<{_NESTED}>>"
VIA = "metadata map<string,struct<xy:array<double>,av:map<string,string>>>"
RESULT = "svr map<string,boolean>, scsr map<string,boolean>, scar map<string,boolean>, geometric_fidelity struct<similarity_percent:double,tolerance_px:int,mean_deviation_px:double,max_deviation_px:double,skeleton_point_count:bigint,points_within_tolerance:bigint>"
# Fixed codes of the annotation tool: shapes and region types.
RECTANGLE, CIRCLE = 2, 3
REGION_KINDS = {"0": "wall", "1": "gallery", "3": "entrance", "4": "exit", "5": "floor_area", "6": "forbidden_area", "7": "scale"}


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    lost = sorted(set(columns) - set(df.columns))
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def artifacts_csv(spark: SparkSession, path: str, schema: str = ARTIFACT) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_artifacts_csv(df: DataFrame, path: str) -> None:
    """Binary columns have no text form and are left out."""
    df.select([c for c, t in df.dtypes if t != "binary"]).write.csv(path, header=True, escape='"')


def sections_csv(spark: SparkSession, path: str) -> DataFrame:
    """(number, section) of a numbered list's CSV file with at least the columns exhibit_number and Section."""
    raw = require(spark.read.csv(path, header=True, multiLine=True, escape='"'), ["exhibit_number", "Section"])
    return raw.select(F.col("exhibit_number").try_cast("bigint").alias("number"), F.col("Section").alias("section"))


def gallery_names(table: DataFrame) -> DataFrame:
    """(layout, gallery) of an annotation table's named galleries."""
    return table.where("kind = 'gallery' AND gallery_name IS NOT NULL").select("layout", F.col("gallery_name").alias("gallery")).distinct()


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a line; nulls are left out; `by` columns become folders."""
    df.write.partitionBy(*(by or [])).json(path)


def write_raw_output(df: DataFrame, path: str) -> None:
    """A model's raw answer (`raw`) and all else about its run as one member `metadata`, side by side in one JSON table."""
    others = [c for c in df.columns if c not in ("task", "raw")]
    df.select("task", "raw", F.struct(*others).alias("metadata")).write.json(path)


def output_paths(root: str, model: Column, difficulty: Column, complexity: Column, variant: Column, layout: Column) -> Column:
    """struct(folder, raw, result, log) of where a run's files lie; a model's `/` becomes `-`, a null variant is left out."""
    folder = F.concat_ws("/", F.lit(root), F.replace(model, F.lit("/"), F.lit("-")), difficulty, complexity, F.concat_ws("_", variant, layout))
    names = (("raw", "raw_output.txt"), ("result", "final_results.json"), ("log", "processing.log"))
    return F.struct(folder.alias("folder"), *[F.concat(folder, F.lit(f"/{name}")).alias(k) for k, name in names])


def path_parts(path: Column) -> Column:
    """struct(complexity, layout) of `.../complexity/layout_NN/...`."""
    pattern = r"/([^/]+)/(layout_[^/]+)(?:/|$)"
    return F.struct(F.regexp_extract(path, pattern, 1).alias("complexity"), F.regexp_extract(path, pattern, 2).alias("layout"))


def result_parts(path: Column) -> Column:
    """struct(model, difficulty, complexity, variant, layout) of `.../model/difficulty/complexity/[variant_]layout_NN/file`, whatever lies above."""
    pattern = r"([^/]+)/([^/]+)/([^/]+)/(?:([^/]*)_)?(layout_[^/_]+)/[^/]+$"
    names = ("model", "difficulty", "complexity", "variant", "layout")
    return F.struct(*[F.regexp_extract(path, pattern, k + 1).alias(n) for k, n in enumerate(names)])


def task_configs(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Task configurations below folder with complexity, layout and task; comment members are ignored."""
    raw = spark.read.schema(TASK).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True).json(folder)
    path = F.col("_metadata.file_path")
    return raw.select("*", path_parts(path).alias("p_"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("task")).select("p_.complexity", "p_.layout", "task", *[c for c in raw.columns])


def placement_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(layout, line_no, line) of all exhibit_input.txt files below folder; a file is one small row before it is split."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "exhibit_input.txt").text(folder, wholetext=True)
    named = raw.select(F.concat_ws("/", path_parts(F.col("_metadata.file_path"))["complexity"], path_parts(F.col("_metadata.file_path"))["layout"]).alias("layout"), "value")
    return named.select("layout", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """final_results.json files below folder with their path columns; unreadable files have null members."""
    raw = spark.read.schema(RESULT).option("recursiveFileLookup", True).option("pathGlobFilter", "final_results.json").option("multiLine", True).json(folder)
    return raw.select("*", result_parts(F.col("_metadata.file_path")).alias("p_")).select("p_.*", *raw.columns)


def log_lines(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """(model, difficulty, complexity, variant, layout, line_no, line) of log files."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    named = raw.select(result_parts(F.col("_metadata.file_path")).alias("p_"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return named.select("p_.*", "line_no", "line")


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files below folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length")


def folders_without(files: DataFrame, name: str) -> DataFrame:
    """(dir) of the folders that hold files but not one of this name."""
    split = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    return split.groupBy("dir").agg(F.bool_or(F.col("file") == name).alias("has")).where("NOT has").select("dir")


def annotations(raw: DataFrame, layout: Column) -> DataFrame:
    """Long table of an annotation file's regions: layout, kind, id, annotation_number, shape, coordinates, area,
    exhibit_number, gallery_name, length_mm, px_per_mm, mm_per_px. raw has the column `metadata` (schema VIA).

    Unlabelled regions are left out. Ids are kinds with running numbers in the order of the region keys."""
    flat = raw.select(layout.alias("layout"), F.explode("metadata").alias("key", "m")).where("size(m.av) > 0 AND size(m.xy) > 0")
    kind_code = F.try_element_at("m.av", F.lit("1"))
    kinds = F.create_map(*[F.lit(x) for k, v in REGION_KINDS.items() for x in (k, v)])
    number = F.nullif(F.trim(F.try_element_at("m.av", F.lit("2"))), F.lit(""))
    kind = F.when(number.isNotNull() & (F.get("m.xy", F.lit(0)) == CIRCLE), "exhibit").otherwise(F.coalesce(F.try_element_at(kinds, kind_code), F.lit("other")))
    xy = lambda k: F.get("m.xy", F.lit(k))
    rest = F.slice("m.xy", 2, F.size("m.xy"))
    points = F.transform(F.sequence(F.lit(0), (F.size(rest) / 2).cast("int") - 1), lambda k: F.struct(F.get(rest, 2 * k).alias("x"), F.get(rest, 2 * k + 1).alias("y")))
    is_rect, is_circle = xy(0) == RECTANGLE, xy(0) == CIRCLE
    pi = 3.14159  # the format's own constant
    where = F.struct(
        F.when(is_rect, xy(1)).alias("x"), F.when(is_rect, xy(2)).alias("y"), F.when(is_rect, xy(3)).alias("width"), F.when(is_rect, xy(4)).alias("height"),
        F.when(is_circle, xy(1)).alias("center_x"), F.when(is_circle, xy(2)).alias("center_y"), F.when(is_circle, xy(3)).alias("radius"),
        F.when(~is_rect & ~is_circle & (F.size(rest) >= 2), points).alias("points"), F.when(~is_rect & ~is_circle, (F.size(rest) / 2).cast("int")).alias("num_points"),
    )
    shape = F.when(is_rect, "rectangle").when(is_circle, "circle").otherwise("polyline")
    area = F.when(is_rect, (xy(3) * xy(4)).cast("bigint")).when(is_circle, (pi * xy(3) * xy(3)).cast("bigint"))
    mm = F.when(kind == "scale", F.nullif(F.regexp_replace(F.coalesce(F.try_element_at("m.av", F.lit("4")), F.lit("")), r"[^0-9.]", ""), F.lit("")).try_cast("double"))
    px = F.when(kind == "scale", F.greatest(xy(3), xy(4)))
    named = flat.select("layout", "key", kind.alias("kind"), shape.alias("shape"), where.alias("coordinates"), area.alias("area"), number.alias("exhibit_number"), F.nullif(F.trim(F.try_element_at("m.av", F.lit("3"))), F.lit("")).alias("gallery_name"), px.alias("pixel_length"), mm.alias("length_mm"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("layout", "kind").orderBy("key"))
    scaled = named.withColumn("px_per_mm", F.round(F.col("pixel_length") / F.nullif("length_mm", F.lit(0.0)), 6)).withColumn("mm_per_px", F.round(F.col("length_mm") / F.nullif("pixel_length", F.lit(0.0)), 6))
    return scaled.withColumn("annotation_number", order).withColumn("id", F.concat_ws("_", "kind", F.col("annotation_number").cast("string"))).drop("key")


def read_annotations(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    raw = spark.read.schema(VIA).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True).json(folder)
    return annotations(raw.select("metadata", path_parts(F.col("_metadata.file_path"))["layout"].alias("layout_")), F.col("layout_"))


def count_kinds(table: DataFrame) -> DataFrame:
    return table.groupBy("layout", "kind").agg(F.count(F.lit(1)).alias("cnt"))
