"""Building the catalogue: frequencies, placements, task configurations and their duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.functions import text


def preprocess(artifacts: DataFrame, cities: DataFrame) -> DataFrame:
    """artifacts with parsed dates and places: year_min, year_max, is_range, date_status, city, country, place_status."""
    date = text.parse_date(F.col("production_date"))
    parsed = artifacts.withColumn("d", date).withColumn("city", text.find_city(F.col("find_spot")))
    placed = city_country(parsed, cities)
    status = F.when(F.col("city").isNull(), "failed").when(F.col("country").isNull(), "unknown").otherwise("success")
    return placed.select(*artifacts.columns, "d.year_min", "d.year_max", "d.is_range", F.col("d.status").alias("date_status"), "city", "country", status.alias("place_status"))


def city_country(df: DataFrame, cities: DataFrame) -> DataFrame:
    """df with `country` of its `city`: an equal name of cities(ord, city, country), else one equal but for case, else the
    first in `ord` that holds or is held by it. Each distinct city is looked up once."""
    named = df.select("city").where("city IS NOT NULL").distinct()
    known = cities.select("ord", F.col("city").alias("known"), F.col("country").alias("found"))
    low, other = F.lower("city"), F.lower("known")
    exact = named.join(known.withColumn("city", F.col("known")), "city").withColumn("prio", F.lit(0))
    same = named.withColumn("k", low).join(known.withColumn("k", other), "k").drop("k").withColumn("prio", F.lit(1))
    # Containment has no join key; only names without an equal one get that far.
    rest = named.join(same.select("city").distinct(), "city", "left_anti")
    part = rest.join(known, F.contains(low, other) | F.contains(other, low)).withColumn("prio", F.lit(2))
    cols = ["city", "prio", "ord", "found"]
    best = exact.select(cols).unionByName(same.select(cols)).unionByName(part.select(cols)).groupBy("city").agg(F.min_by("found", F.struct("prio", "ord")).alias("country"))
    return df.join(best, "city", "left")


def frequencies(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, cnt, first_pos) of a column's non-null values; first_pos is the least `order` at which a value stands."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("cnt"), F.min(order).alias("first_pos"))


def split_values(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """One row for each trimmed non-empty part of a separated list."""
    parts = F.transform(F.split(column, separator), lambda x: F.trim(x))
    return df.withColumn(column, F.explode(F.filter(parts, lambda x: x != "")))


def profile(artifacts: DataFrame) -> DataFrame:
    """(attribute, value, cnt, first_pos) of sections, techniques, cities, countries and single materials."""
    parts = []
    for attribute, column in (("sections", "section"), ("techniques", "technique"), ("cities", "city"), ("countries", "country")):
        parts.append(frequencies(artifacts, column, "id").withColumn("attribute", F.lit(attribute)))
    parts.append(frequencies(split_values(artifacts, "materials"), "materials", "id").withColumn("attribute", F.lit("materials")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("attribute", "value", "cnt", "first_pos")


def ranked(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """counts with `most` and `least`: ranks from 1 by frequency; ties go by first appearance, then by value, from the end for `least`."""
    keys = by or []
    up = Window.partitionBy(*keys).orderBy(F.desc("cnt"), F.asc("first_pos"), F.asc("value"))
    down = Window.partitionBy(*keys).orderBy(F.asc("cnt"), F.desc("first_pos"), F.desc("value"))
    return counts.withColumn("most", F.row_number().over(up).cast("bigint")).withColumn("least", F.row_number().over(down).cast("bigint"))


def rotated(values: Column, variation: Column, size: int, phase: int = 0) -> Column:
    """`size` neighbouring items of an array from place (variation + phase), round the end; the whole array if it has no more."""
    n = F.size(values)
    start = F.pmod(variation + phase, F.greatest(n, F.lit(1)))
    return F.when(n <= size, values).otherwise(F.slice(F.concat(values, values), (start + 1).cast("int"), F.lit(size)))


def range_counts(spans: DataFrame, by: str) -> DataFrame:
    """(by, year_min, year_max, cnt): for each distinct span of a group, how many of its spans lie inside it.

    Equal spans are counted first, so the join is between distinct spans of one group."""
    each = spans.where("year_min IS NOT NULL AND year_max IS NOT NULL").groupBy(by, "year_min", "year_max").agg(F.count(F.lit(1)).alias("n"))
    inner = each.select(by, F.col("year_min").alias("lo"), F.col("year_max").alias("hi"), "n")
    held = each.drop("n").join(inner, by).where("lo >= year_min AND hi <= year_max")
    return held.groupBy(by, "year_min", "year_max").agg(F.sum("n").alias("cnt"))


def date_candidates(counts: DataFrame, by: str, prefer_common: bool = True, n: int = 5) -> DataFrame:
    """The n spans of each group to choose from, by count, ties by the earlier span, with texts `first`, `last`.

    With prefer_common false the ascending order's last n are taken, which are the most common as well."""
    order = [F.desc("cnt"), F.asc("year_min"), F.asc("year_max")] if prefer_common else [F.desc("cnt"), F.desc("year_min"), F.desc("year_max")]
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= n)
    return top.withColumn("first", text.format_year(F.col("year_min"))).withColumn("last", text.format_year(F.col("year_max")))


def top_sections(artifacts: DataFrame, n: int) -> DataFrame:
    """The n sections with the most artifacts; ties by name."""
    return artifacts.where("section IS NOT NULL").groupBy("section").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "section").limit(n)


def stratified_sample(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """n rows of each group, all if it has fewer: those with the smallest md5 of the key, the same in every run."""
    order = Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return df.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)


def parse_placements(lines: DataFrame) -> DataFrame:
    """(layout, line_no, number, section) of lines `a-b: Section` or `n: Section`; comments and malformed lines give nothing."""
    head, tail = F.trim(F.substring_index("line", ":", 1)), F.trim(F.expr("substr(line, instr(line, ':') + 1)"))
    pattern = r"^(\d+)(?:\s*-\s*(\d+))?$"
    good = (F.instr("line", ":") > 0) & ~F.startswith(F.trim("line"), F.lit("#")) & head.rlike(pattern)
    first = F.regexp_extract(head, pattern, 1).try_cast("bigint")
    last = F.coalesce(F.regexp_extract(head, pattern, 2).try_cast("bigint"), first)
    parsed = lines.where(good).select("layout", "line_no", first.alias("a"), last.alias("b"), tail.alias("section")).where("b >= a")
    return parsed.select("layout", "line_no", F.explode(F.sequence("a", "b")).alias("number"), "section")


def first_assignment(placements: DataFrame) -> DataFrame:
    """For each number of a layout the section of the first line that names it."""
    return placements.groupBy("layout", "number").agg(F.min_by("section", "line_no").alias("section"))


def available(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(layout, section, n_wanted, n_have, enough) with sections compared without case."""
    have = artifacts.groupBy(F.lower("section").alias("k")).agg(F.count(F.lit(1)).alias("n_have"))
    want = requests.groupBy("layout", F.lower("section").alias("section")).agg(F.count(F.lit(1)).alias("n_wanted"))
    joined = want.join(have, F.col("section") == F.col("k"), "left").fillna(0, ["n_have"])
    return joined.select("layout", "section", "n_wanted", "n_have", (F.col("n_wanted") <= F.col("n_have")).alias("enough"))


def assign(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(layout, number, section, id): a section's i-th smallest number gets its i-th smallest artifact id; layouts in which
    any section has too few artifacts get none."""
    short = available(requests, artifacts).where("NOT enough").select("layout").distinct()
    wanted = requests.join(short, "layout", "left_anti").withColumn("k", F.lower("section"))
    wanted = wanted.withColumn("rn", F.row_number().over(Window.partitionBy("layout", "k").orderBy("number")))
    pool = artifacts.dropDuplicates(["id"]).select(F.lower("section").alias("k"), "id")
    pool = pool.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    return wanted.join(pool, ["k", "rn"]).select("layout", "number", "section", "id")


def hash_number(*parts: Column) -> Column:
    """A number below 2**28 from an md5 of the parts as text, the same in every run."""
    text_ = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text_.cast("binary")), 1, 7), 16, 10).cast("bigint")


def base_config() -> Column:
    """The fields of a task configuration that asks for nothing but one exhibit."""
    # Fixed defaults of the configuration format.
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return F.struct(
        F.create_map().cast("map<string,string>").alias("gallery_configs"),
        F.lit(1_000_000_000).cast("bigint").alias("distance_budget_in_mm"),
        F.lit(1500).cast("bigint").alias("exhibit_see_distance_in_mm"),
        empty("string").alias("exhibit_categories_to_cover"),
        F.lit(1).alias("at_least_n_exhibits_to_cover"),
        empty("int").alias("specific_exhibit_to_cover"),
    )


def configs(profiles: DataFrame, galleries: DataFrame, totals: DataFrame, variations: int, difficulty: str, spans: DataFrame | None = None) -> DataFrame:
    """Task configurations (layout, variation, ...) of a difficulty: easy_spatial, easy_semantic, medium or hard,
    `variations` of each layout.

    profiles(layout, attribute, value, cnt, first_pos); galleries(layout, gallery); totals(layout, total); spans(layout,
    first, last, rank): the candidate date ranges of each layout, best first, in whose absence no dates are asked for.
    Values rotate through each attribute's pool in order of frequency. An easy_semantic configuration asks for the least
    common value of one attribute, and by turns for a range of dates. What is drawn at random comes from a hash of layout
    and variation, so runs agree.
    """
    # Fixed window sizes and phases of the configuration format.
    sizes = {"medium": {"sections": 1, "materials": 2, "countries": 2}, "hard": {"sections": 2, "materials": 3, "techniques": 2, "countries": 3}}.get(difficulty, {})
    phases = {"sections": 0, "materials": 2, "countries": 5, "techniques": 9}
    both = {"materials": 13, "countries": 17}
    names = ("sections", "materials", "techniques", "countries")
    none = F.array().cast("array<string>")
    pools = profiles.groupBy("layout").agg(*[F.sort_array(F.collect_list(F.when(F.col("attribute") == a, F.struct((-F.col("cnt")).alias("o"), "first_pos", "value")))).alias(a) for a in names])
    pools = pools.select("layout", *[F.transform(a, lambda x: x["value"]).alias(a) for a in names])
    seen = galleries.groupBy("layout").agg(F.sort_array(F.collect_set("gallery")).alias("must_see"))
    base = totals.join(pools, "layout", "left").join(seen, "layout", "left").withColumn("variation", F.explode(F.sequence(F.lit(0), F.lit(variations - 1))))
    if spans is not None:
        held = spans.groupBy("layout").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "first", "last"))), lambda x: F.array(x["first"], x["last"])).alias("spans"))
        base = base.join(held, "layout", "left")
    draw = lambda what, n: F.pmod(hash_number(F.lit(what), F.col("layout"), F.col("variation")), n).cast("int")
    asks_dates = {"easy_spatial": F.lit(False), "easy_semantic": draw("dated", F.lit(2)) == 0}.get(difficulty, F.lit(True))
    dates = none if spans is None else F.when(asks_dates & (F.size("spans") > 0), F.get("spans", draw("span", F.greatest(F.size("spans"), F.lit(1))))).otherwise(none)
    low, high, share = {"medium": (5, 10, 0.1), "hard": (15, 25, 0.25)}.get(difficulty, (1, 1, 1.0))
    easy = difficulty.startswith("easy_")
    least = F.least(F.lit(high), F.greatest(F.lit(low), (F.col("total") * share).cast("int")))
    count = F.least((least + (0 if easy else F.col("variation"))).cast("bigint"), F.col("total"))
    picked = {a: rotated(F.col(a), F.col("variation"), sizes[a], phases[a]) for a in sizes}
    if difficulty == "easy_semantic":
        kinds = ("materials", "techniques", "countries")
        kind = draw("kind", F.lit(3))
        # the rarest value stands last in a pool; a layout without values of the drawn attribute asks for none
        picked = {a: F.when((kind == k) & (F.size(a) > 0), F.slice(a, -1, 1)).otherwise(none) for k, a in enumerate(kinds)}
    columns = [picked.get(a, none).alias(a) for a in names]
    columns += [(rotated(F.col(a), F.col("variation"), 1, phase) if difficulty == "hard" else none).alias(f"both_{a}") for a, phase in both.items()]
    pick = F.sequence(F.lit(1).cast("bigint"), F.col("total"))
    order = F.array_sort(F.transform(pick, lambda k: F.struct(F.md5(F.concat_ws("/", k.cast("string"), F.col("layout").cast("string"), F.col("variation").cast("string")).cast("binary")).alias("h"), k.alias("k"))))
    n_specific = F.least(F.lit(10), F.greatest(F.lit(5), (F.col("total") / 20).cast("int")))
    specific = F.transform(F.slice(order, F.lit(1), n_specific), lambda x: x["k"]) if difficulty == "hard" else F.array().cast("array<bigint>")
    budget = F.lit(2_500_000 if difficulty == "hard" else 1_000_000_000).cast("bigint")
    must_see = none if difficulty == "easy_semantic" else F.col("must_see")
    return base.select("layout", "variation", must_see.alias("must_see"), count.alias("min_n"), *columns, dates.alias("in_range"), specific.alias("specific"), budget.alias("budget_mm"))


def batch(profiles: DataFrame, galleries: DataFrame, totals: DataFrame, spans: DataFrame, variations: dict[str, int]) -> DataFrame:
    """Configurations of all layouts and difficulties, with `task` (the difficulty, and a number for those with several
    variations) and, of equal ones of a layout, which is the first; see configs and fingerprints."""
    out = None
    for difficulty, n in variations.items():
        task = F.lit(difficulty) if n == 1 else F.format_string(f"{difficulty}_%02d", F.col("variation") + 1)
        one = configs(profiles, galleries, totals, n, difficulty, spans).withColumn("task", task).withColumn("difficulty", F.lit(difficulty))
        out = one if out is None else out.unionByName(one)
    return fingerprints(out, "task", ["must_see", "sections", "materials", "techniques", "countries", "both_materials", "both_countries", "in_range", "specific"], ["min_n", "budget_mm"])


def select_catalogue(artifacts: DataFrame, n_sections: int, n_each: int) -> DataFrame:
    """The catalogue to work with: artifacts with a numeric date and all of section, materials, technique and find spot,
    of the n_sections sections with the most of them, n_each of a section by hash of their id."""
    whole = artifacts.dropna(subset=["section", "materials", "technique", "production_date", "find_spot"]).where(text.has_numeric_date(F.col("production_date")))
    kept = whole.join(top_sections(whole, n_sections).select("section"), "section", "left_semi")
    return stratified_sample(kept, "section", "id", n_each)


def review(done: DataFrame) -> DataFrame:
    """The rows of `preprocess` that someone should look at: a date or place that wasn't understood."""
    return done.where("date_status <> 'success' OR place_status <> 'success'")


def section_members(exhibits: DataFrame) -> DataFrame:
    """(layout, section, members, color): a section's exhibit numbers in order, and its colour's number in a palette of ten,
    dealt over the layout's sections by name. exhibits(layout, number, section)."""
    each = exhibits.where("section IS NOT NULL").groupBy("layout", "section").agg(F.sort_array(F.collect_list("number")).alias("members"))
    place = F.row_number().over(Window.partitionBy("layout").orderBy("section"))
    return each.withColumn("color", ((place - 1) % 10).cast("bigint"))


def annotated_sections(annotations: DataFrame, exhibits: DataFrame) -> DataFrame:
    """(layout, n_matched, unmatched): annotated exhibits whose number the list has, and the numbers it lacks, sorted.

    annotations(layout, exhibit_number as text); what is no whole number is passed over, the same number twice counts twice."""
    marked = annotations.select("layout", F.col("exhibit_number").try_cast("bigint").alias("number")).where("number IS NOT NULL")
    found = marked.join(exhibits.select("layout", "number", F.lit(True).alias("hit")).distinct(), ["layout", "number"], "left")
    per = found.groupBy("layout").agg(F.count("hit").alias("n_matched"), F.sort_array(F.collect_list(F.when(F.col("hit").isNull(), F.col("number")))).alias("u"))
    return per.select("layout", "n_matched", F.concat_ws(",", F.transform("u", lambda x: x.cast("string"))).alias("unmatched"))


def annotation_order(annotations: DataFrame) -> DataFrame:
    """annotations with `place`: from 1 in each layout by exhibit number, those without a whole number as 999, ties by id."""
    number = F.coalesce(F.col("exhibit_number").try_cast("bigint"), F.lit(999))
    return annotations.withColumn("place", F.row_number().over(Window.partitionBy("layout").orderBy(number, "id")).cast("bigint"))


def repeats(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, n, n_distinct, is_unique): whether a key is unique in its group; nulls don't count."""
    out = df.groupBy(*by).agg(F.count(key).alias("n"), F.count_distinct(key).alias("n_distinct"))
    return out.withColumn("is_unique", F.col("n") == F.col("n_distinct"))


def fingerprints(configs: DataFrame, order: str, lists: list[str], values: list[str]) -> DataFrame:
    """configs with `fingerprint` of the named lists (order ignored) and values, and `duplicate_of`: the first row of its
    layout, by `order`, with the same fingerprint; null for that one."""
    parts = [F.concat_ws("|", F.sort_array(c)) for c in lists] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in values]
    marked = configs.withColumn("fingerprint", F.md5(F.concat_ws("#", *parts).cast("binary")))
    first = F.first_value(order).over(Window.partitionBy("layout", "fingerprint").orderBy(order))
    return marked.withColumn("first_", first).withColumn("duplicate_of", F.when(F.col("first_") != F.col(order), F.col("first_"))).drop("first_")
