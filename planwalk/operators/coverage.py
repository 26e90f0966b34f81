"""Which required exhibits a task's visits cover: relational division over (task, ex_id).

Tasks are a row each. They and exhibits meet within a layout. A null or empty constraint asks for nothing; null values of an exhibit never match.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.functions import text
from planwalk.plans import shared

CHECKS = ("date", "material", "place", "technique")


def _configured(tasks: DataFrame, name: str) -> Column:
    if name == "date":
        return (F.size(F.coalesce("in_range", F.array().cast("array<string>"))) >= 2) | F.col("before_year").isNotNull() | F.col("after_year").isNotNull()
    return F.size(F.coalesce(f"{name}s", F.array().cast("array<string>"))) > 0


def _percent(every: DataFrame) -> DataFrame:
    pct = F.when(F.col("n_required") == 0, 100.0).otherwise(F.round(100.0 * F.col("n_visited") / F.nullif(F.col("n_required"), F.lit(0)), 2))
    return every.select("task", "n_required", "n_visited", pct.alias("pct"), (F.col("n_required") == F.col("n_visited")).alias("valid"))


def _visited(layouts: DataFrame, visits: DataFrame) -> DataFrame:
    """(task, layout, ex_id) of each visit, repeated ones too, dealt to meet exhibits and be made distinct with one move."""
    return visits.join(layouts, "task").select("task", "layout", "ex_id").repartition("layout", "ex_id")


def _meet(hits: DataFrame, exhibits: DataFrame, how: str = "inner") -> DataFrame:
    """Visits with exhibits of their layout; exhibits grow with the input, and few stored bytes may hold many, so they aren't broadcast."""
    return hits.join(exhibits.hint("shuffle_hash"), ["layout", "ex_id"], how)


def category_coverage(tasks: DataFrame, exhibits: DataFrame, visits: DataFrame) -> DataFrame:
    """(task, category, n_members, n_visited, valid): all exhibits of a category must be visited; an unknown category fails.

    Members are counted by layout and visits by task, so tasks don't meet the exhibits that they haven't visited."""
    shown = exhibits.select("layout", F.col("section").alias("category"), "ex_id")
    seen = _meet(_visited(tasks.select("task", "layout").distinct(), visits).distinct(), shown).groupBy("task", "layout", "category").agg(F.count("ex_id").alias("n_visited"))
    return _of_categories(tasks, shown, seen)


def _of_categories(tasks: DataFrame, shown: DataFrame, seen: DataFrame) -> DataFrame:
    """What category_coverage() returns, from the visits counted by task, layout and category."""
    wanted = tasks.select("task", "layout", F.explode(F.array_distinct("categories")).alias("category"))
    members = shown.groupBy("layout", "category").agg(F.count("ex_id").alias("n_members"))
    every = wanted.join(members, ["layout", "category"], "left").join(seen, ["task", "layout", "category"], "left")
    per = every.groupBy("task", "category").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("n_members", "n_visited")])
    return per.withColumn("valid", (F.col("n_members") > 0) & (F.col("n_members") == F.col("n_visited")))


def specific_coverage(tasks: DataFrame, visits: DataFrame) -> DataFrame:
    """(task, n_found, missing, pct, valid) of the listed exhibits; the percentage is of the list's length, repeats included."""
    wanted = tasks.select("task", F.size("specific").alias("n_listed"), F.explode_outer(F.array_distinct("specific")).alias("ex_id"))
    seen = wanted.join(visits.select("task", "ex_id", F.lit(1).alias("hit")).distinct(), ["task", "ex_id"], "left")
    per = seen.groupBy("task", "n_listed").agg(F.count("hit").alias("n_found"), F.sort_array(F.collect_list(F.when(F.col("hit").isNull(), F.col("ex_id")))).alias("lost"))
    pct = F.when(F.col("n_listed") <= 0, 100.0).otherwise(F.round(100.0 * F.col("n_found") / F.nullif(F.col("n_listed"), F.lit(0)), 2))
    return per.select("task", "n_found", F.concat_ws(",", F.transform("lost", lambda x: x.cast("string"))).alias("missing"), pct.alias("pct"), (F.size("lost") == 0).alias("valid"))


def minimum_count(tasks: DataFrame, visits: DataFrame) -> DataFrame:
    """(task, n_visited, pct, valid): at least min_n different exhibits; the percentage isn't capped."""
    seen = visits.groupBy("task").agg(F.count_distinct("ex_id").alias("n_visited"))
    every = tasks.select("task", "min_n").join(seen, "task", "left").fillna(0, ["n_visited"])
    pct = F.when(F.col("min_n") <= 0, 100.0).otherwise(F.round(100.0 * F.col("n_visited") / F.nullif(F.col("min_n"), F.lit(0)), 2))
    return every.select("task", "n_visited", pct.alias("pct"), (F.col("n_visited") >= F.col("min_n")).alias("valid"))


#: Parts of a layout's exhibits, which meet what is asked of the layout apart from each other.
DEALT = 16
_FACTS = {"date": ("year_min", "year_max"), "material": ("material",), "place": ("city", "country"), "technique": ("technique",)}


def _need(name: str) -> Column:
    """What a check needs of a task, years parsed and texts lower-cased."""
    if name != "date":
        return F.transform(F.coalesce(f"{name}s", F.array().cast("array<string>")), lambda n: F.lower(n))
    year = lambda k: text.parse_year(F.get("in_range", F.lit(k)))
    parts = [(F.size(F.coalesce("in_range", F.array().cast("array<string>"))) >= 2).alias("ranged"), year(0).alias("from"), year(1).alias("to")]
    parts += [F.col("before_year").isNotNull().alias("ends"), text.parse_year(F.col("before_year")).alias("before")]
    return F.struct(*parts, F.col("after_year").isNotNull().alias("begins"), text.parse_year(F.col("after_year")).alias("after"))


def _fits(name: str, n: Column) -> Column:
    """Whether an exhibit's facts are what the need n asks for."""
    s = F.col
    if name == "date":
        inside = ~n["ranged"] | ((s("year_min") >= n["from"]) & (s("year_max") <= n["to"]))
        return F.coalesce(inside & (~n["ends"] | (s("year_max") < n["before"])) & (~n["begins"] | (s("year_min") > n["after"])), F.lit(False))
    held = lambda c: F.coalesce(F.exists(n, lambda x: F.contains(s(c), x)), F.lit(False))
    return functools.reduce(Column.__or__, map(held, _FACTS[name]))


def _asked(tasks: DataFrame, checks: tuple[str, ...], needs: DataFrame) -> DataFrame:
    """(task, layout, asked): by check, the number of the task's need among the layout's, null where it asks for nothing."""
    number = lambda k: F.when(F.col(f"need.{k}").isNotNull(), F.array_position(F.col(f"needs.{k}.need"), F.col(f"need.{k}"))).cast("int")
    return _needing(tasks, checks).join(needs, "layout", "left").select("task", "layout", F.struct(*[number(k).alias(k) for k in checks]).alias("asked"))


def _needing(tasks: DataFrame, checks: tuple[str, ...]) -> DataFrame:
    return tasks.select("task", "layout", F.struct(*[F.when(_configured(tasks, k), _need(k)).alias(k) for k in checks]).alias("need"))


def _needs(tasks: DataFrame, checks: tuple[str, ...]) -> DataFrame:
    """(layout, needs): by check, the layout's different needs, numbered from 1."""
    numbered = lambda k: F.transform(F.sort_array(F.collect_set(f"need.{k}")), lambda n, i: F.struct((i + 1).alias("no"), n.alias("need")))
    return _needing(tasks, checks).groupBy("layout").agg(F.struct(*[numbered(k).alias(k) for k in checks]).alias("needs"))


def _shown(exhibits: DataFrame, checks: tuple[str, ...], needs: DataFrame) -> DataFrame:
    """(layout, ex_id, category, fits, own, nth): by check, the numbers of the needs that an exhibit fits. It is looked at once
    for each different need of its layout. own: its id if it is listed several times; nth: which time this is."""
    facts = [F.col(c) if k == "date" else F.lower(c).alias(c) for k in checks for c in _FACTS[k]]
    part = F.pmod(F.hash("ex_id"), F.lit(DEALT))
    dealt = needs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    met = exhibits.select("layout", "ex_id", F.col("section").alias("category"), *facts, part.alias("part")).join(dealt.hint("merge"), ["layout", "part"], "left")
    fitting = lambda k: F.transform(F.filter(f"needs.{k}", lambda n: _fits(k, n["need"])), lambda n: n["no"])
    fits = F.struct(*[fitting(k).alias(k) for k in checks])
    one = Window.partitionBy("layout", "ex_id")
    listed = met.select("layout", "ex_id", "category", fits.alias("fits"))
    return listed.withColumn("own", F.when(F.count(F.lit(1)).over(one) > 1, F.col("ex_id"))).withColumn("nth", F.row_number().over(one.orderBy("category")))


def _held(checks: tuple[str, ...]) -> dict[str, Column]:
    """Whether `fits` has what `asked` asks for, by check; with several checks also `combined`: all that are configured."""
    has = {k: F.col(f"asked.{k}").isNotNull() for k in checks}
    held = {k: F.coalesce(F.array_contains(F.col(f"fits.{k}"), F.col(f"asked.{k}")), F.lit(False)) for k in checks}
    if len(checks) > 1:
        some, every = F.lit(False), F.lit(True)
        for k in checks:
            some, every = some | has[k], every & (~has[k] | held[k])
        return held | {"combined": some & every}
    return held


def _per(held: dict[str, Column], n: Column) -> list[Column]:
    """What adds up of exhibits that are listed once, and whether any of one's several listings fits, by check."""
    return [F.sum(F.when(v, n).otherwise(0)).alias(f"many_{k}") for k, v in held.items()] + [F.bool_or(v).alias(f"any_{k}") for k, v in held.items()]


def _total(k: str) -> Column:
    return F.sum(F.when(F.col("own").isNull(), F.col(f"many_{k}")).otherwise(F.col(f"any_{k}").cast("bigint")))


def _counts(tasks: DataFrame, exhibits: DataFrame, visits: DataFrame, checks: tuple[str, ...], lists: bool = False, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(task, n_seen, n_specific, required_<check>, visited_<check> and those of `combined` if there are several) of all tasks,
    and (task, layout, category, n_visited) of the categories that tasks ask for; of lists, only if they are asked for.

    Every exhibit is looked at once for each different need of its layout, and from then on known by the numbers of those
    that it fits. What is required is counted once for each different thing that is asked of a layout, against the different
    sets of numbers; what is visited, in one pass over the visits. What comes of both is stored. With members, see _by_spot()."""
    needs, held = _needs(tasks, checks), _held(checks)
    shown = shared.keep(_shown(exhibits, checks, needs), "coverage-facts")
    asked = _asked(tasks, checks, needs)
    kinds = shown.groupBy("layout", "fits", "own").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.pmod(F.hash("fits", "own"), F.lit(DEALT)))
    things = asked.select("layout", "asked").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    met = things.join(kinds.hint("merge"), ["layout", "part"])
    required = met.groupBy("layout", "asked", "own").agg(*_per(held, F.col("n"))).groupBy("layout", "asked").agg(*[_total(k).alias(f"required_{k}") for k in held])
    if members is not None:
        seen = _by_spot(tasks, asked, shown, visits, members, held)
    elif lists:
        hits = _meet(_visited(tasks.select("task", "layout"), visits).distinct(), shown, "left").join(asked.join(tasks.select("task", "categories", "specific"), "task").drop("layout"), "task")
        category = F.when(F.array_contains("categories", F.col("category")), F.col("category"))
        once = F.coalesce("nth", F.lit(1)) == 1
        rows = hits.select("task", "layout", "own", category.alias("category"), once.alias("once"), (once & F.array_contains("specific", F.col("ex_id"))).alias("specific"), *[v.alias(f"held_{k}") for k, v in held.items()])
    else:
        # visits that fit nothing are left out before the others are made distinct
        fitting = functools.reduce(Column.__or__, [F.size(f"fits.{k}") > 0 for k in checks])
        hits = _meet(_visited(asked.select("task", "layout"), visits), shown.where(fitting)).join(asked.drop("layout"), "task")
        rows = hits.where(functools.reduce(Column.__or__, held.values())).select("task", "layout", "ex_id", "own", "category", "nth", *[v.alias(f"held_{k}") for k, v in held.items()]).distinct()
        rows = rows.select("task", "layout", "own", F.lit(None).cast("string").alias("category"), F.lit(False).alias("once"), F.lit(False).alias("specific"), *[f"held_{k}" for k in held])
    if members is None:
        seen = rows.groupBy("task", "layout", "own", "category").agg(*_per({k: F.col(f"held_{k}") for k in held}, F.lit(1)), F.count(F.lit(1)).alias("n_visited"), F.count_if("once").alias("n_seen"), F.count_if("specific").alias("n_specific"))
    seen = shared.keep(seen, "coverage-visits")
    each = seen.groupBy("task", "own").agg(*[F.sum(f"many_{k}").alias(f"many_{k}") for k in held], *[F.bool_or(f"any_{k}").alias(f"any_{k}") for k in held], *[F.sum(c).alias(c) for c in ("n_seen", "n_specific")])
    visited = each.groupBy("task").agg(*[_total(k).alias(f"visited_{k}") for k in held], *[F.sum(c).alias(c) for c in ("n_seen", "n_specific")])
    names = [f"{c}_{k}" for k in held for c in ("required", "visited")] + ["n_seen", "n_specific"]
    counts = asked.join(required, ["layout", "asked"], "left").join(visited, "task", "left").select("task", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return counts, seen.where("category IS NOT NULL").groupBy("task", "layout", "category").agg(F.sum("n_visited").alias("n_visited"))


def _by_spot(tasks: DataFrame, asked: DataFrame, shown: DataFrame, visits: DataFrame, members: DataFrame, held: dict[str, Column]) -> DataFrame:
    """(task, layout, own, category, n_visited, n_seen, n_specific, and what _per() has) from visits(task, spot, n) of spots whose
    exhibits are members(spot, ex_id).

    What a spot's exhibits count for is summed once for each different thing that is asked of a layout, so a visit of a spot is
    one row, however many exhibits it has. Listed exhibits that a task asks for are told to their spots."""
    wanted = tasks.select("task", F.array_sort(F.array_distinct(F.coalesce("categories", F.array().cast("array<string>")))).alias("categories"))
    named = asked.join(wanted, "task")
    things = shared.keep(named.select("layout", "asked", "categories").distinct().withColumn("thing", F.monotonically_increasing_id()), "coverage-things")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("layout", "asked", "categories")]
    named = named.alias("n").join(things.alias("t").hint("merge"), functools.reduce(Column.__and__, same)).select("n.task", "n.layout", "t.thing")
    kinds = shared.meet(shown, members, "ex_id").groupBy("layout", "spot", "category", "fits", "own").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.pmod(F.hash("spot"), F.lit(DEALT)))
    dealt = things.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    met = dealt.join(kinds.hint("merge"), ["layout", "part"])
    category = F.when(F.array_contains("categories", F.col("category")), F.col("category"))
    sums = met.groupBy("thing", "spot", "own", category.alias("category")).agg(*_per(held, F.col("n")), F.sum("n").alias("n_visited"))
    names = [c for c in sums.columns if c not in ("thing", "spot")]
    sums = sums.groupBy("thing", "spot").agg(F.collect_list(F.struct(*names)).alias("sums"))
    listed = shared.meet(tasks.select("task", F.explode(F.array_distinct("specific")).alias("ex_id")), members, "ex_id").groupBy("task", "spot").agg(F.count(F.lit(1)).alias("w"))
    listed = listed.groupBy("task").agg(F.collect_list(F.struct("spot", "w")).alias("listed"))
    # a task's visits lie together already, and are moved once, to meet what their spots count for
    told = shared.meet(visits.select("task", "spot", "n"), shared.meet(named, listed, "task", "left"), "task")
    at = F.array_position("listed.spot", F.col("spot"))
    told = told.select("task", "layout", "thing", "spot", "n", F.when(at > 0, F.get(F.col("listed.w"), (at - 1).cast("int"))).otherwise(0).alias("w"))
    rows = shared.meet(told, sums, ["thing", "spot"], "left").select("task", "layout", "n", "w", F.posexplode_outer("sums").alias("at", "s")).select("task", "layout", "n", "w", "at", "s.*")
    first = F.coalesce("at", F.lit(0)) == 0
    per = [F.sum(f"many_{k}").alias(f"many_{k}") for k in held] + [F.bool_or(f"any_{k}").alias(f"any_{k}") for k in held]
    return rows.groupBy("task", "layout", "own", "category").agg(*per, F.sum("n_visited").alias("n_visited"), F.sum(F.when(first, F.col("n"))).alias("n_seen"), F.sum(F.when(first, F.col("w"))).alias("n_specific"))


def constraint_coverage(tasks: DataFrame, exhibits: DataFrame, visits: DataFrame, name: str) -> DataFrame:
    """(task, n_required, n_visited, pct, valid) of one constraint for every task, or of `combined`: what matches every
    configured one, if any is. 100 percent and valid where nothing is asked for."""
    counts, _ = _counts(tasks, exhibits, visits, CHECKS if name == "combined" else (name,))
    return _percent(counts.select("task", F.col(f"required_{name}").alias("n_required"), F.col(f"visited_{name}").alias("n_visited")))


def semantic_overall(tasks: DataFrame, exhibits: DataFrame, visits: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(task, and one boolean for each check, all_valid). See _counts() and category_coverage()."""
    kinds = [*CHECKS, "combined"]
    counts, seen = _counts(tasks, exhibits, visits, CHECKS, lists=True, members=members)
    shown = exhibits.select("layout", F.col("section").alias("category"), "ex_id")
    categories = _of_categories(tasks, shown, seen).groupBy("task").agg(F.bool_and("valid").alias("category_ok"))
    every = tasks.select("task", "min_n", "specific").fillna(0, ["min_n"]).join(counts, "task").join(categories, "task", "left")
    oks = {f"{k}_ok": F.col(f"required_{k}") == F.col(f"visited_{k}") for k in kinds}
    oks["category_ok"] = F.coalesce("category_ok", F.lit(True))
    oks["specific_ok"] = F.col("n_specific") == F.greatest(F.coalesce(F.size(F.array_distinct("specific")), F.lit(0)), F.lit(0))
    oks["count_ok"] = F.col("n_seen") >= F.col("min_n")
    out = every.select("task", *[v.alias(k) for k, v in oks.items()])
    return out.withColumn("all_valid", F.forall(F.array(*oks), lambda x: x))


def simplify(tasks: DataFrame, overall: DataFrame) -> DataFrame:
    """(task, scar): the results' boolean map. The category check is left out where no category is configured; attributes
    hold if every configured constraint does, and where none is."""
    named = tasks.join(overall, "task")
    some = F.lit(False)
    holds = F.lit(True)
    for k in CHECKS:
        has = _configured(tasks, k)
        some = some | has
        holds = holds & (~has | F.col(f"{k}_ok"))
    holds = holds & (~some | F.col("combined_ok"))
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    entries = F.array(
        entry("at_least_n_exhibits_coverage", F.col("count_ok")),
        entry("attribute_validations", holds),
        F.when(F.size("categories") > 0, entry("exhibit_category_coverage", F.col("category_ok"))),
        entry("specific_exhibit_coverage", F.col("specific_ok")),
    )
    return named.select("task", F.map_from_entries(F.array_compact(entries)).alias("scar"))
