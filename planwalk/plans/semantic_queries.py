"""Texts parsed and required exhibits covered."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwalk.functions import text
from planwalk.operators import catalogue, coverage
from planwalk.plans.registry import query
from planwalk.sources import bindings as b

_FACTS = "art dim plain dated spots named facts"


@query("art plain dated", "SELECT id, year_min, year_max, is_range, date_status FROM dated")
def date_parse(spark, sf_dir):
    return b.artifacts(spark, sf_dir).select("id", text.parse_date(F.col("production_date")).alias("d")).selectExpr("id", "d.year_min", "d.year_max", "d.is_range", "d.status AS date_status")


@query("art", r"SELECT id, production_date FROM art WHERE regexp_matches(trim(production_date), '^\d+') AND NOT regexp_matches(production_date, '\d+[stndrh]{2}C') AND materials IS NOT NULL")
def date_filter(spark, sf_dir):
    return b.artifacts(spark, sf_dir).dropna(subset=["production_date", "materials"]).where(text.has_numeric_date(F.col("production_date"))).select("id", "production_date")


@query("art plain dated spots", "SELECT id, city FROM spots")
def find_spot_parse(spark, sf_dir):
    return b.artifacts(spark, sf_dir).select("id", text.find_city(F.col("find_spot")).alias("city"))


@query(_FACTS, "SELECT id, city, country FROM facts")
def city_country(spark, sf_dir):
    named = b.artifacts(spark, sf_dir).select("id", text.find_city(F.col("find_spot")).alias("city"))
    return catalogue.city_country(named, b.cities(spark, sf_dir)).select("id", "city", "country")


@query(_FACTS, "SELECT 'date' AS kind, date_status AS status, count(*) AS cnt FROM facts GROUP BY date_status UNION ALL SELECT 'place', place_status, count(*) FROM facts GROUP BY place_status UNION ALL SELECT 'unknown city', city, count(*) FROM facts WHERE place_status = 'unknown' GROUP BY city")
def preprocess_stats(spark, sf_dir):
    done = catalogue.preprocess(b.artifacts(spark, sf_dir), b.cities(spark, sf_dir))
    fact = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("status"))
    facts = F.array(fact("date", "date_status"), fact("place", "place_status"), F.when(F.col("place_status") == "unknown", fact("unknown city", "city")))
    return done.select(F.explode(F.array_compact(facts)).alias("f")).groupBy("f.kind", "f.status").agg(F.count(F.lit(1)).alias("cnt"))


def _tables(spark, sf_dir, placed=True):
    return b.tasks(spark, sf_dir), b.exhibit_facts(spark, sf_dir, placed), b.visits(spark, sf_dir)


def _coverage(name):
    @query(f"{_FACTS} vis tasks match need cover", f"SELECT task, n_required, n_visited, pct, valid FROM cover WHERE kind = '{name}'", f"{name}_coverage")
    def run(spark, sf_dir):
        """Coverage of one constraint."""
        tasks, exhibits, visits = _tables(spark, sf_dir, placed=name in ("place", "combined"))
        return coverage.constraint_coverage(tasks, exhibits, visits, name)


for _name in (*coverage.CHECKS, "combined"):
    _coverage(_name)


@query(f"{_FACTS} vis tasks cats", "SELECT * FROM cats")
def category_coverage(spark, sf_dir):
    return coverage.category_coverage(*_tables(spark, sf_dir, placed=False))


@query("vis tasks spec", "SELECT * FROM spec")
def specific_coverage(spark, sf_dir):
    return coverage.specific_coverage(b.tasks(spark, sf_dir), b.visits(spark, sf_dir))


@query("vis tasks least", "SELECT * FROM least")
def min_count(spark, sf_dir):
    return coverage.minimum_count(b.tasks(spark, sf_dir), b.visits(spark, sf_dir))


_ALL = "date_ok AND material_ok AND place_ok AND technique_ok AND combined_ok AND category_ok AND specific_ok AND count_ok"


@query(f"{_FACTS} vis tasks match need cover cats spec least overall", f"SELECT *, {_ALL} AS all_valid FROM overall")
def semantic_overall(spark, sf_dir):
    return coverage.semantic_overall(*_tables(spark, sf_dir))


@query(f"{_FACTS} vis tasks match need cover cats spec least overall", "SELECT o.task, o.count_ok AS at_least_n, (NOT t.has_date OR o.date_ok) AND (len(t.mats) = 0 OR o.material_ok) AND (len(t.places) = 0 OR o.place_ok) AND (len(t.techs) = 0 OR o.technique_ok) AND (NOT (t.has_date OR len(t.mats) > 0 OR len(t.places) > 0 OR len(t.techs) > 0) OR o.combined_ok) AS attributes, CASE WHEN len(t.cats) > 0 THEN o.category_ok END AS category, o.specific_ok AS specific FROM overall o JOIN tasks t ON o.task = t.task")
def scar_simplify(spark, sf_dir):
    tasks, exhibits, visits = _tables(spark, sf_dir)
    found = coverage.simplify(tasks, coverage.semantic_overall(tasks, exhibits, visits))
    names = {"at_least_n": "at_least_n_exhibits_coverage", "attributes": "attribute_validations", "category": "exhibit_category_coverage", "specific": "specific_exhibit_coverage"}
    return found.select("task", *[F.try_element_at("scar", F.lit(k)).alias(n) for n, k in names.items()])


@query("ans", r"SELECT id, CASE WHEN id % 6 = 4 THEN 'no json' WHEN id % 6 = 3 THEN 'too short' WHEN id % 6 = 5 OR NOT fits THEN 'out of bounds' ELSE 'ok' END AS status, CASE WHEN id % 6 < 3 AND fits THEN CAST(regexp_extract(txt, '\[\[(\d+),', 1) AS BIGINT) END AS first_x, CASE WHEN id % 6 < 3 AND fits THEN 3::BIGINT END AS n_points FROM ans")
def route_text_parse(spark, sf_dir):
    parsed = b.answers(spark, sf_dir).select("id", text.route_json(F.col("txt")).alias("r"))
    inside = F.forall("r", lambda p: (F.get(p, F.lit(0)).between(0, 499)) & (F.get(p, F.lit(1)).between(0, 499)))
    status = F.when(F.col("r").isNull(), "no json").when(F.size("r") < 2, "too short").when(~inside, "out of bounds").otherwise("ok")
    good = status == "ok"
    return parsed.select("id", status.alias("status"), F.when(good, F.get(F.get("r", F.lit(0)), F.lit(0))).alias("first_x"), F.when(good, F.size("r").cast("bigint")).alias("n_points"))


@query("pick exh", r"SELECT p.id, p.n AS ex_id, e.section FROM (SELECT id, CAST(unnest(string_split(regexp_extract(txt, '\[([\d, ]+)\]', 1), ',')) AS BIGINT) AS n FROM pick WHERE regexp_matches(txt, '\[[\d, ]+\]')) p JOIN exh e ON p.n = e.ex_id")
def id_text_parse(spark, sf_dir):
    ids = b.picks(spark, sf_dir).select("id", F.explode(text.id_json(F.col("txt"))).alias("ex_id"))
    return ids.join(b.exhibits(spark, sf_dir).select("ex_id", "section"), "ex_id")
