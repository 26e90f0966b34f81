"""The catalogue: frequencies, placements, configurations, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwalk.operators import catalogue
from planwalk.plans.registry import query
from planwalk.sources import bindings as b

_PROFILE = "art dim plain dated spots named facts prof"


def _facts(spark, sf_dir):
    return catalogue.preprocess(b.artifacts(spark, sf_dir), b.cities(spark, sf_dir))


@query(_PROFILE, "SELECT * FROM prof WHERE attribute <> 'materials'")
def attr_frequency(spark, sf_dir):
    return catalogue.profile(_facts(spark, sf_dir)).where("attribute <> 'materials'")


@query("art", "SELECT value, count(*) AS cnt, min(id) AS first_pos FROM (SELECT id, trim(unnest(string_split(materials, ';'))) AS value FROM art) WHERE value <> '' GROUP BY value")
def material_frequency(spark, sf_dir):
    return catalogue.frequencies(catalogue.split_values(b.artifacts(spark, sf_dir), "materials"), "materials", "id")


@query(_PROFILE, "SELECT * FROM (SELECT attribute, value, cnt, row_number() OVER (PARTITION BY attribute ORDER BY cnt DESC, first_pos, value) AS most, row_number() OVER (PARTITION BY attribute ORDER BY cnt, first_pos DESC, value DESC) AS least FROM prof) WHERE most <= 2 OR least <= 2")
def most_least_common(spark, sf_dir):
    ranked = catalogue.ranked(catalogue.profile(_facts(spark, sf_dir)), ["attribute"])
    return ranked.where("most <= 2 OR least <= 2").select("attribute", "value", "cnt", "most", "least")


@query(_PROFILE, "WITH ord AS (SELECT attribute, value, row_number() OVER (PARTITION BY attribute ORDER BY cnt DESC, first_pos, value) - 1 AS pos, count(*) OVER (PARTITION BY attribute) AS n FROM prof) SELECT o.attribute, v.variation, string_agg(o.value, '|' ORDER BY CASE WHEN o.n <= 3 THEN o.pos ELSE (o.pos - (v.variation + 2) % o.n + o.n) % o.n END) AS picked FROM ord o CROSS JOIN (SELECT unnest(range(0, 6)) AS variation) v WHERE o.n <= 3 OR (o.pos - (v.variation + 2) % o.n + o.n) % o.n < 3 GROUP BY o.attribute, v.variation")
def rotate_window(spark, sf_dir):
    pools = catalogue.profile(_facts(spark, sf_dir)).groupBy("attribute").agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("o"), "first_pos", "value"))).alias("p"))
    turns = pools.select("attribute", F.transform("p", lambda x: x["value"]).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("variation"))
    return turns.select("attribute", F.col("variation").cast("bigint").alias("variation"), F.concat_ws("|", catalogue.rotated(F.col("v"), F.col("variation"), 3, 2)).alias("picked"))


_RANGES = "art plain dated"
_COUNTS = "spn AS (SELECT layout, year_min, year_max FROM dated WHERE year_min IS NOT NULL), rc AS (SELECT a.layout, a.year_min, a.year_max, count(*) AS cnt FROM (SELECT DISTINCT * FROM spn) a JOIN spn c ON a.layout = c.layout AND c.year_min >= a.year_min AND c.year_max <= a.year_max GROUP BY a.layout, a.year_min, a.year_max)"


def _range_counts(spark, sf_dir):
    return catalogue.range_counts(_facts(spark, sf_dir), "layout")


@query(_RANGES, f"WITH {_COUNTS} SELECT * FROM rc")
def range_containment(spark, sf_dir):
    return _range_counts(spark, sf_dir)


@query(_RANGES, f"WITH {_COUNTS} SELECT *, CASE WHEN year_min < 0 THEN abs(year_min) || ' BC' ELSE '' || year_min END AS first, CASE WHEN year_max < 0 THEN abs(year_max) || ' BC' ELSE '' || year_max END AS last FROM (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY cnt DESC, year_min, year_max) AS rank FROM rc) WHERE rank <= 5")
def date_candidates(spark, sf_dir):
    return catalogue.date_candidates(_range_counts(spark, sf_dir), "layout")


@query("art", "SELECT section, count(*) AS cnt FROM art WHERE section IS NOT NULL GROUP BY section ORDER BY cnt DESC, section LIMIT 3")
def top_sections(spark, sf_dir):
    return catalogue.top_sections(b.artifacts(spark, sf_dir), 3)


@query("art", "SELECT section, id, rank FROM (SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY md5(CAST(id AS VARCHAR)), id) AS rank FROM art) WHERE rank <= 20")
def stratified_sample(spark, sf_dir):
    return catalogue.stratified_sample(b.artifacts(spark, sf_dir).select("section", "id"), "section", "id", 20)


@query("lines placed firsts", "SELECT * FROM firsts")
def placement_parse(spark, sf_dir):
    return catalogue.first_assignment(catalogue.parse_placements(b.placements(spark, sf_dir)))


@query("art lines placed firsts", "WITH have AS (SELECT lower(section) AS k, count(*) AS n FROM art GROUP BY 1) SELECT w.layout, w.section, w.n_wanted, coalesce(h.n, 0) AS n_have, w.n_wanted <= coalesce(h.n, 0) AS enough FROM (SELECT layout, lower(section) AS section, count(*) AS n_wanted FROM firsts GROUP BY 1, 2) w LEFT JOIN have h ON w.section = h.k")
def placement_availability(spark, sf_dir):
    wanted = catalogue.first_assignment(catalogue.parse_placements(b.placements(spark, sf_dir)))
    return catalogue.available(wanted, b.artifacts(spark, sf_dir))


@query("art lines placed firsts", "WITH have AS (SELECT lower(section) AS k, count(*) AS n FROM art GROUP BY 1), short AS (SELECT DISTINCT w.layout FROM (SELECT layout, lower(section) AS k, count(*) AS n FROM firsts GROUP BY 1, 2) w LEFT JOIN have h ON w.k = h.k WHERE w.n > coalesce(h.n, 0)), w AS (SELECT layout, number, section, lower(section) AS k, row_number() OVER (PARTITION BY layout, lower(section) ORDER BY number) AS rn FROM firsts WHERE layout NOT IN (SELECT layout FROM short)), p AS (SELECT id, lower(section) AS k, row_number() OVER (PARTITION BY lower(section) ORDER BY id) AS rn FROM art) SELECT w.layout, w.number, w.section, p.id FROM w JOIN p ON w.k = p.k AND w.rn = p.rn")
def zip_assign(spark, sf_dir):
    wanted = catalogue.first_assignment(catalogue.parse_placements(b.placements(spark, sf_dir)))
    return catalogue.assign(wanted, b.artifacts(spark, sf_dir).select("id", "section"))


def _parts(spark, sf_dir):
    """Profiles, galleries, totals and candidate spans of each layout."""
    facts = _facts(spark, sf_dir)
    value = lambda attribute, column: F.struct(F.lit(attribute).alias("attribute"), F.col(column).alias("value"))
    single = F.array(value("sections", "section"), value("techniques", "technique"), value("countries", "country"))
    split = F.transform(F.split("materials", ";"), lambda x: F.struct(F.lit("materials").alias("attribute"), F.trim(x).alias("value")))
    flat = facts.select("layout", "id", F.explode(F.concat(single, F.coalesce(split, F.array().cast("array<struct<attribute:string,value:string>>")))).alias("v")).select("layout", "id", "v.*").where("value IS NOT NULL AND value <> ''")
    every = flat.groupBy("layout", "attribute", "value").agg(F.count(F.lit(1)).alias("cnt"), F.min("id").alias("first_pos"))
    galleries = b.regions(spark, sf_dir).where("kind = 'gallery'").selectExpr("id % 20 AS layout", "concat('G', id) AS gallery")
    totals = facts.groupBy("layout").agg(F.count(F.lit(1)).alias("total"))
    spans = catalogue.date_candidates(catalogue.range_counts(facts, "layout"), "layout")
    return every, galleries, totals, spans


def _configs(spark, sf_dir, difficulty="medium", variations=11):
    every, galleries, totals, spans = _parts(spark, sf_dir)
    return catalogue.configs(every, galleries, totals, variations, difficulty, spans)


_POOL = "pr AS (SELECT layout, attribute, value, row_number() OVER (PARTITION BY layout, attribute ORDER BY count(*) DESC, min(id), value) - 1 AS pos, count(*) OVER (PARTITION BY layout, attribute) AS n FROM (SELECT layout, 'sections' AS attribute, section AS value, id FROM facts UNION ALL SELECT layout, 'countries', country, id FROM facts UNION ALL SELECT layout, 'techniques', technique, id FROM facts UNION ALL SELECT layout, 'materials', trim(unnest(string_split(materials, ';'))), id FROM facts) WHERE value IS NOT NULL GROUP BY layout, attribute, value)"
_SPANS = f"{_COUNTS}, sp AS (SELECT layout, rank, CASE WHEN year_min < 0 THEN abs(year_min) || ' BC' ELSE '' || year_min END || '|' || CASE WHEN year_max < 0 THEN abs(year_max) || ' BC' ELSE '' || year_max END AS r, count(*) OVER (PARTITION BY layout) AS n FROM (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY cnt DESC, year_min, year_max) AS rank FROM rc) WHERE rank <= 5)"
_TURNS = "tt AS (SELECT layout, count(*) AS total FROM facts GROUP BY layout), tv AS (SELECT t.layout, t.total, v.variation FROM tt t CROSS JOIN (SELECT unnest(range(0, {0})) AS variation) v)"


def _drawn(what: str) -> str:
    """SQL of the number drawn from a layout and variation."""
    return f"CAST('0x' || substr(md5('{what}/' || t.layout || '/' || t.variation), 1, 7) AS BIGINT)"


_DATES = f"coalesce((SELECT r FROM sp WHERE sp.layout = t.layout AND sp.rank = {_drawn('span')} % sp.n + 1), '')"


@query("art dim plain dated spots named facts", "WITH pr AS (SELECT layout, attribute, value, row_number() OVER (PARTITION BY layout, attribute ORDER BY count(*) DESC, min(id), value) - 1 AS pos, count(*) OVER (PARTITION BY layout, attribute) AS n FROM (SELECT layout, 'sections' AS attribute, section AS value, id FROM facts UNION ALL SELECT layout, 'countries', country, id FROM facts UNION ALL SELECT layout, 'materials', trim(unnest(string_split(materials, ';'))), id FROM facts) WHERE value IS NOT NULL GROUP BY layout, attribute, value), pk AS (SELECT p.layout, v.variation, p.attribute, string_agg(p.value, '|' ORDER BY CASE WHEN p.n <= w.k THEN p.pos ELSE (p.pos - (v.variation + w.phase) % p.n + p.n) % p.n END) AS picked FROM pr p JOIN (VALUES ('sections', 1, 0), ('materials', 2, 2), ('countries', 2, 5)) AS w(attribute, k, phase) ON p.attribute = w.attribute CROSS JOIN (SELECT unnest(range(0, 11)) AS variation) v WHERE p.n <= w.k OR (p.pos - (v.variation + w.phase) % p.n + p.n) % p.n < w.k GROUP BY p.layout, v.variation, p.attribute), tt AS (SELECT layout, count(*) AS total FROM facts GROUP BY layout) SELECT t.layout, v.variation, least(least(10, greatest(5, t.total // 10)) + v.variation, t.total) AS min_n, coalesce(max(picked) FILTER (WHERE attribute = 'sections'), '') AS sections, coalesce(max(picked) FILTER (WHERE attribute = 'materials'), '') AS materials, coalesce(max(picked) FILTER (WHERE attribute = 'countries'), '') AS countries FROM tt t CROSS JOIN (SELECT unnest(range(0, 11)) AS variation) v LEFT JOIN pk ON t.layout = pk.layout AND v.variation = pk.variation GROUP BY t.layout, v.variation, t.total")
def medium_configs(spark, sf_dir):
    c = _configs(spark, sf_dir)
    return c.select("layout", F.col("variation").cast("bigint").alias("variation"), "min_n", *[F.concat_ws("|", k).alias(k) for k in ("sections", "materials", "countries")])


_HARD = ", ".join(f"coalesce(max(picked) FILTER (WHERE name = '{k}'), '') AS {k}" for k in ("sections", "materials", "techniques", "countries", "both_materials", "both_countries"))


@query("art dim plain dated spots named facts", f"WITH {_POOL}, {_TURNS.format(11)}, {_SPANS}, pk AS (SELECT p.layout, v.variation, w.name, string_agg(p.value, '|' ORDER BY CASE WHEN p.n <= w.k THEN p.pos ELSE (p.pos - (v.variation + w.phase) % p.n + p.n) % p.n END) AS picked FROM pr p JOIN (VALUES ('sections', 2, 0, 'sections'), ('materials', 3, 2, 'materials'), ('techniques', 2, 9, 'techniques'), ('countries', 3, 5, 'countries'), ('materials', 1, 13, 'both_materials'), ('countries', 1, 17, 'both_countries')) AS w(attribute, k, phase, name) ON p.attribute = w.attribute CROSS JOIN (SELECT unnest(range(0, 11)) AS variation) v WHERE p.n <= w.k OR (p.pos - (v.variation + w.phase) % p.n + p.n) % p.n < w.k GROUP BY p.layout, v.variation, w.name), ch AS (SELECT layout, variation, string_agg(CAST(k AS VARCHAR), '|' ORDER BY h, k) AS specific FROM (SELECT t.layout, t.variation, t.total, k, md5(k || '/' || t.layout || '/' || t.variation) AS h, row_number() OVER (PARTITION BY t.layout, t.variation ORDER BY md5(k || '/' || t.layout || '/' || t.variation), k) AS rn FROM (SELECT *, unnest(range(1, total + 1)) AS k FROM tv) t) WHERE rn <= least(10, greatest(5, total // 20)) GROUP BY layout, variation) SELECT t.layout, t.variation, least(least(25, greatest(15, t.total // 4)) + t.variation, t.total) AS min_n, 2500000::BIGINT AS budget_mm, {_HARD}, any_value({_DATES}) AS in_range, coalesce(any_value(ch.specific), '') AS specific FROM tv t LEFT JOIN pk ON t.layout = pk.layout AND t.variation = pk.variation LEFT JOIN ch ON t.layout = ch.layout AND t.variation = ch.variation GROUP BY t.layout, t.variation, t.total")
def hard_configs(spark, sf_dir):
    c = _configs(spark, sf_dir, "hard")
    return c.select("layout", F.col("variation").cast("bigint").alias("variation"), "min_n", "budget_mm", *[F.concat_ws("|", k).alias(k) for k in ("sections", "materials", "techniques", "countries", "both_materials", "both_countries", "in_range")], F.concat_ws("|", F.transform("specific", lambda x: x.cast("string"))).alias("specific"))


@query("art dim plain dated spots named facts", f"WITH {_POOL}, {_TURNS.format(6)}, {_SPANS} SELECT t.layout, t.variation, 1::BIGINT AS min_n, 1000000000::BIGINT AS budget_mm, coalesce((SELECT value FROM pr WHERE pr.layout = t.layout AND pr.attribute = 'materials' AND pr.pos = pr.n - 1 AND {_drawn('kind')} % 3 = 0), '') AS materials, coalesce((SELECT value FROM pr WHERE pr.layout = t.layout AND pr.attribute = 'techniques' AND pr.pos = pr.n - 1 AND {_drawn('kind')} % 3 = 1), '') AS techniques, coalesce((SELECT value FROM pr WHERE pr.layout = t.layout AND pr.attribute = 'countries' AND pr.pos = pr.n - 1 AND {_drawn('kind')} % 3 = 2), '') AS countries, CASE WHEN {_drawn('dated')} % 2 = 0 THEN {_DATES} ELSE '' END AS in_range FROM tv t")
def easy_semantic_configs(spark, sf_dir):
    c = _configs(spark, sf_dir, "easy_semantic", 6)
    return c.select("layout", F.col("variation").cast("bigint").alias("variation"), "min_n", "budget_mm", *[F.concat_ws("|", k).alias(k) for k in ("materials", "techniques", "countries", "in_range")])


@query("art dim plain dated spots named facts", f"WITH {_TURNS.format(11)}, {_SPANS} SELECT t.layout, t.variation, {_DATES} AS in_range FROM tv t")
def medium_dates(spark, sf_dir):
    return _configs(spark, sf_dir).select("layout", F.col("variation").cast("bigint").alias("variation"), F.concat_ws("|", "in_range").alias("in_range"))


@query()
def config_batch(spark, sf_dir):
    """All configurations of all layouts, equal ones marked; its parts have SQL, and the whole is tested on its own."""
    made = catalogue.batch(*_parts(spark, sf_dir), {"easy_spatial": 1, "easy_semantic": 1, "medium": 11, "hard": 11})
    return made.select("layout", "task", "difficulty", "min_n", "fingerprint", "duplicate_of")


_NUMERIC = r"regexp_matches(trim(production_date), '^\d+') AND NOT regexp_matches(production_date, '\d+[stndrh]{2}C')"


@query("art", f"WITH ok AS (SELECT * FROM art WHERE {_NUMERIC} AND find_spot IS NOT NULL), top AS (SELECT section FROM ok GROUP BY section ORDER BY count(*) DESC, section LIMIT 3) SELECT section, id, rank FROM (SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY md5(CAST(id AS VARCHAR)), id) AS rank FROM ok WHERE section IN (SELECT section FROM top)) WHERE rank <= 15")
def catalogue_selection(spark, sf_dir):
    return catalogue.select_catalogue(b.artifacts(spark, sf_dir), 3, 15).select("section", "id", "rank")


@query("art dim plain dated spots named facts", "SELECT id, date_status, place_status FROM facts WHERE date_status <> 'success' OR place_status <> 'success'")
def review_rows(spark, sf_dir):
    return catalogue.review(_facts(spark, sf_dir)).select("id", "date_status", "place_status")


def _numbered(spark, sf_dir):
    return b.exhibits(spark, sf_dir).where("ex_id % 7 > 0").select("layout", F.col("ex_id").alias("number"), "section")


@query("exh", "SELECT layout, section, string_agg(CAST(ex_id AS VARCHAR), ',' ORDER BY ex_id) AS members, (row_number() OVER (PARTITION BY layout ORDER BY section) - 1) % 10 AS color FROM exh WHERE ex_id % 7 > 0 GROUP BY layout, section")
def section_members(spark, sf_dir):
    return catalogue.section_members(_numbered(spark, sf_dir)).withColumn("members", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))))


@query("exh ann", "SELECT a.layout, count(e.ex_id) AS n_matched, coalesce(string_agg(CASE WHEN e.ex_id IS NULL THEN CAST(a.n AS VARCHAR) END, ',' ORDER BY a.n), '') AS unmatched FROM (SELECT layout, TRY_CAST(exhibit_number AS BIGINT) AS n FROM ann) a LEFT JOIN (SELECT * FROM exh WHERE ex_id % 7 > 0) e ON a.layout = e.layout AND a.n = e.ex_id WHERE a.n IS NOT NULL GROUP BY a.layout")
def annotated_sections(spark, sf_dir):
    return catalogue.annotated_sections(b.annotated(spark, sf_dir), _numbered(spark, sf_dir))


@query("ann", "SELECT layout, id, row_number() OVER (PARTITION BY layout ORDER BY coalesce(TRY_CAST(exhibit_number AS BIGINT), 999), id) AS place FROM ann")
def annotation_order(spark, sf_dir):
    return catalogue.annotation_order(b.annotated(spark, sf_dir)).select("layout", "id", "place")


@query("lines placed firsts", "SELECT layout, count(number) AS n, count(DISTINCT number) AS n_distinct, count(number) = count(DISTINCT number) AS is_unique FROM placed GROUP BY layout")
def number_repeats(spark, sf_dir):
    return catalogue.repeats(catalogue.parse_placements(b.placements(spark, sf_dir)), ["layout"], "number")


@query("art", "WITH fp AS (SELECT id, layout, md5(concat_ws('#', array_to_string(list_sort(list_transform(string_split(materials, ';'), lambda x: trim(x))), '|'), section, '' || id % 3)) AS fingerprint FROM art) SELECT id, fingerprint, CASE WHEN first_value(id) OVER w <> id THEN first_value(id) OVER w END AS duplicate_of FROM fp WINDOW w AS (PARTITION BY layout, fingerprint ORDER BY id)")
def fingerprint_dups(spark, sf_dir):
    rows = b.artifacts(spark, sf_dir).select("layout", "id", F.transform(F.split("materials", ";"), lambda x: F.trim(x)).alias("m"), "section", (F.col("id") % 3).alias("third"))
    return catalogue.fingerprints(rows, "id", ["m"], ["section", "third"]).select("id", "fingerprint", "duplicate_of")
