"""Parsing of catalogue and log texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the texts' formats.
YEAR_RANGE = r"(?i)^(\d+)\s*(BC|AD)?\s*-\s*(\d+)\s*(BC|AD)?$"
YEAR = r"(?i)^(\d+)\s*(BC|AD)?$"
CENTURY = r"\d+[stndrh]{2}C"
NUMERIC_START = r"^\d+"
PLACE_LABEL = r"(?i)(?:Excavated/Findspot|Found/Acquired|Findspot):\s*([^(,;]+)"
PLACE_FALLBACK = r":\s*([A-Za-z\s\-]+)"
PLACE_SUFFIX = r"(?i)\s+(said to be|possibly|probably|modern|historic).*$"
LOG_TIME = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"


def _signed(number: Column, era: Column) -> Column:
    year = number.try_cast("int")
    return F.when(F.upper(era) == "BC", -year).otherwise(year)


def parse_date(c: Column) -> Column:
    """struct(year_min, year_max, is_range, status) of a production date; BC years are negative, each side has its own era."""
    plain = F.trim(F.regexp_replace(F.trim(c), r"\s*\([^)]+\)", ""))
    part = lambda pattern, k: F.regexp_extract(plain, pattern, k)
    first, last = _signed(part(YEAR_RANGE, 1), part(YEAR_RANGE, 2)), _signed(part(YEAR_RANGE, 3), part(YEAR_RANGE, 4))
    one = _signed(part(YEAR, 1), part(YEAR, 2))
    is_range, is_year = F.coalesce(plain.rlike(YEAR_RANGE), F.lit(False)), F.coalesce(plain.rlike(YEAR), F.lit(False))
    return F.struct(
        F.when(is_range, F.least(first, last)).when(is_year, one).alias("year_min"),
        F.when(is_range, F.greatest(first, last)).when(is_year, one).alias("year_max"),
        is_range.alias("is_range"),
        F.when(is_range | is_year, "success").otherwise("failed").alias("status"),
    )


def has_numeric_date(c: Column) -> Column:
    """Whether a date starts with a year and names no century; false for null."""
    return F.coalesce(F.trim(c).rlike(NUMERIC_START) & ~F.trim(c).rlike(CENTURY), F.lit(False))


def parse_year(c: Column) -> Column:
    """`600 AD`, `400 BC` or bare digits to a signed year; null for anything else."""
    return _signed(F.regexp_extract(F.trim(c), YEAR, 1), F.regexp_extract(F.trim(c), YEAR, 2))


def format_year(c: Column) -> Column:
    return F.when(c < 0, F.concat(F.abs(c).cast("string"), F.lit(" BC"))).otherwise(c.cast("string"))


def find_city(c: Column) -> Column:
    """The city a find spot names, null if none."""

    def clean(x: Column) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+\(.*\)$", ""), PLACE_SUFFIX, "")), F.lit(""))

    return F.coalesce(clean(F.regexp_extract(c, PLACE_LABEL, 1)), clean(F.regexp_extract(c, PLACE_FALLBACK, 1)))


def log_time(c: Column) -> Column:
    """The time a log line starts with, null if it starts otherwise."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(c, LOG_TIME, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))


def model_parts(folder: Column) -> Column:
    """struct(model, reasoning) of a result folder `model(reasoning)`; no reasoning if there are no brackets."""
    pattern = r"^(.+?)\((.+?)\)$"
    return F.struct(F.when(folder.rlike(pattern), F.regexp_extract(folder, pattern, 1)).otherwise(folder).alias("model"), F.nullif(F.regexp_extract(folder, pattern, 2), F.lit("")).alias("reasoning"))


def model_folder(model: Column, reasoning: Column) -> Column:
    safe = F.replace(model, F.lit("/"), F.lit("-"))
    return F.when(F.length(reasoning) > 0, F.concat(safe, F.lit("("), reasoning, F.lit(")"))).otherwise(safe)


def route_json(c: Column) -> Column:
    """array<array<bigint>> of a model's answer: code fences stripped, the whole as JSON, else its outermost brackets; null if neither."""
    bare = F.regexp_replace(c, r"(?m)^```json\s*|\s*```$", "")
    kind = "array<array<bigint>>"
    return F.coalesce(F.from_json(F.trim(bare), kind), F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), kind))


def id_json(c: Column) -> Column:
    """array<bigint> of a model's answer: the whole as JSON, else the first bracketed list of integers; null if neither."""
    listed = F.regexp_extract(c, r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]", 0)
    return F.coalesce(F.from_json(F.trim(c), "array<bigint>"), F.from_json(listed, "array<bigint>"))
