"""Parsers on the formats' own examples, and readers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from planwalk.functions import text
from planwalk.operators import catalogue, coverage, scoring
from planwalk.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


@pytest.mark.parametrize("date,want", [("500BC-490BC", (-500, -490, True, "success")), ("618-906", (618, 906, True, "success")), ("307", (307, 307, False, "success")), ("500-490BC", (-490, 500, True, "success")), ("200 ad", (200, 200, False, "success")), ("317-318 (about)", (317, 318, True, "success")), ("9thC", (None, None, False, "failed")), (None, (None, None, False, "failed")), ("", (None, None, False, "failed"))])
def test_dates(spark, date, want):
    assert tuple(one(spark, text.parse_date(F.col("v")), date)) == want


@pytest.mark.parametrize("date,want", [("253-268", True), ("307", True), ("41-45", True), ("317-318 (about)", True), ("500BC-490BC", True), ("200 BC-160 BC (circa)", True), ("1stC(mid)", False), ("9thC-10thC(early)", False), (None, False)])
def test_numeric_dates(spark, date, want):
    assert one(spark, text.has_numeric_date(F.col("v")), date) is want


@pytest.mark.parametrize("spot,want", [("Excavated/Findspot: Vulci (said to be)", "Vulci"), ("Found/Acquired: Ur, Iraq", "Ur"), ("FINDSPOT: Nimrud possibly", "Nimrud"), ("Bought: Old Town modern", "Old Town"), ("nowhere", None), (None, None)])
def test_find_spots(spark, spot, want):
    assert one(spark, text.find_city(F.col("v")), spot) == want


@pytest.mark.parametrize("year,want", [("575 BC", -575), ("600 AD", 600), ("250", 250), (" 90 ", 90), ("circa", None), (None, None)])
def test_years(spark, year, want):
    assert one(spark, text.parse_year(F.col("v")), year) == want


@pytest.mark.parametrize("answer,want", [("[[1,2],[3,4]]", [[1, 2], [3, 4]]), ("```json\n[[1,2],[3,4]]\n```", [[1, 2], [3, 4]]), ("see [[1,2],[3,4]] there", [[1, 2], [3, 4]]), ("none", None), (None, None)])
def test_routes(spark, answer, want):
    assert one(spark, text.route_json(F.col("v")), answer) == want


@pytest.mark.parametrize("answer,want", [("[3, 4]", [3, 4]), ("take [3,4] not [x]", [3, 4]), ("[]", []), ("no", None)])
def test_ids(spark, answer, want):
    assert one(spark, text.id_json(F.col("v")), answer) == want


def test_models_and_paths(spark):
    assert tuple(one(spark, text.model_parts(F.col("v")), "gpt(high)")) == ("gpt", "high")
    assert tuple(one(spark, text.model_parts(F.col("v")), "gpt")) == ("gpt", None)
    assert one(spark, text.model_folder(F.col("v"), F.lit("low")), "a/b") == "a-b(low)"
    assert tuple(one(spark, scoring.parse_missing_path(F.col("v")), r"m(high)\hard\simple\hard_01_layout_02")) == ("m(high)", "hard", "simple", "hard_01", "layout_02")
    assert one(spark, scoring.parse_missing_path(F.col("v")), "m/easy_spatial/simple/x_layout_02").task is None
    assert one(spark, scoring.parse_missing_path(F.col("v")), "m/hard") is None


def test_cities_by_precedence(spark):
    known = spark.createDataFrame([(0, "Ur", "Iraq"), (1, "ur", "Other"), (2, "Hurst", "UK"), (3, "Rome", "Italy")], "ord long, city string, country string")
    df = spark.createDataFrame([("Ur",), ("UR",), ("Hurstville",), ("near rome",), ("x",), (None,)], "city string")
    got = {r.city: r.country for r in catalogue.city_country(df, known).collect()}
    assert got == {"Ur": "Iraq", "UR": "Iraq", "Hurstville": "Iraq", "near rome": "Italy", "x": None, None: None}


def test_placements(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(["1-3: Greek", "3: Roman", "# 9: no", "", "18-19:Greek", "bad", "x-2: no", "5-4: none"])], "layout long, line_no long, line string")
    got = {r.number: r.section for r in catalogue.first_assignment(catalogue.parse_placements(lines)).collect()}
    assert got == {1: "Greek", 2: "Greek", 3: "Greek", 18: "Greek", 19: "Greek"}


def test_assignment_is_all_or_nothing(spark):
    wanted = spark.createDataFrame([(1, 5, "Greek"), (1, 2, "GREEK"), (2, 1, "Greek"), (2, 2, "Maya")], "layout long, number long, section string")
    have = spark.createDataFrame([(10, "greek"), (7, "Greek"), (9, "Greek")], "id long, section string")
    assert sorted((r.layout, r.number, r.id) for r in catalogue.assign(wanted, have).collect()) == [(1, 2, 7), (1, 5, 9)]


@pytest.mark.parametrize("values,variation,size,phase,want", [("abcde", 0, 2, 0, "ab"), ("abcde", 4, 2, 0, "ea"), ("abcde", 3, 3, 9, "cde"), ("ab", 7, 3, 0, "ab"), ("", 1, 2, 0, "")])
def test_rotation(spark, values, variation, size, phase, want):
    row = spark.createDataFrame([(list(values),)], "v array<string>").select(catalogue.rotated(F.col("v"), F.lit(variation), size, phase).alias("r")).first()
    assert "".join(row.r) == want


def test_hard_configurations(spark):
    profile = spark.createDataFrame([(1, a, f"{a}{k}", 10 - k, k) for a in ("sections", "materials", "techniques", "countries") for k in range(6)], "layout long, attribute string, value string, cnt long, first_pos long")
    halls = spark.createDataFrame([(1, "B"), (1, "A")], "layout long, gallery string")
    rows = catalogue.configs(profile, halls, spark.createDataFrame([(1, 100)], "layout long, total long"), 3, "hard").orderBy("variation").collect()
    assert [r.min_n for r in rows] == [25, 26, 27] and rows[0].must_see == ["A", "B"] and rows[1].sections == ["sections1", "sections2"]
    assert all(len(set(r.specific)) == 5 and r.budget_mm == 2_500_000 for r in rows)
    marked = catalogue.fingerprints(catalogue.configs(profile, halls, spark.createDataFrame([(1, 100)], "layout long, total long"), 8, "medium"), "variation", ["sections", "materials", "countries"], []).orderBy("variation").collect()
    assert [r.duplicate_of for r in marked] == [None] * 6 + [0, 1]


def test_coverage_of_nothing_and_of_nulls(spark):
    kinds = "task long, layout long, in_range array<string>, before_year string, after_year string, materials array<string>, places array<string>, techniques array<string>, categories array<string>, specific array<long>, min_n int"
    tasks = spark.createDataFrame([(1, 0, [], None, None, [], None, ["an"], ["gone"], [5, 5, 6], 2), (2, 0, None, None, None, None, None, None, [], [], 0)], kinds)
    rooms = spark.createDataFrame([(0, 5, "s", None, None, None, None, None, None), (0, 6, "s", "Bronze", "tan", 1, 2, "Ur", "Iraq")], "layout long, ex_id long, section string, material string, technique string, year_min int, year_max int, city string, country string")
    visits = spark.createDataFrame([(1, 6), (1, 6), (1, 99)], "task long, ex_id long")
    got = {r.task: r for r in coverage.semantic_overall(tasks, rooms, visits).collect()}
    assert got[1].technique_ok and got[1].combined_ok and got[1].count_ok and not got[1].category_ok and not got[1].specific_ok and not got[1].all_valid
    assert got[2].all_valid
    found = {r.task: r for r in coverage.specific_coverage(tasks, visits).collect()}
    assert (found[1].n_found, found[1].missing, found[1].pct) == (1, "5", 33.33) and found[2].pct == 100.0
    named = {r.task: r.scar for r in coverage.simplify(tasks, coverage.semantic_overall(tasks, rooms, visits)).collect()}
    assert "exhibit_category_coverage" not in named[2] and named[1]["exhibit_category_coverage"] is False and named[2]["attribute_validations"] is True


def test_runtimes_are_trimmed_from_four_on(spark):
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 900.0)] + [("b", float(x)) for x in (10, 11, 12, 13, 14, 500)], "m string, s double")
    got = {r.m: r for r in scoring.trimmed(v, ["m"], "s").collect()}
    assert (got["a"].n_kept, got["b"].n_kept, got["b"].outliers) == (3, 5, "500.0")


def test_runtime_needs_two_dated_lines(spark):
    lines = spark.createDataFrame([(1, 0, "2026-04-29 11:06:49 - INFO - a"), (1, 1, "more"), (1, 2, "2026-04-29 11:07:09 - INFO - b"), (2, 0, "2026-04-29 11:06:49 - INFO - a")], "task long, line_no long, line string")
    got = {r.task: r.seconds for r in scoring.runtimes(lines.withColumn("at", text.log_time(F.col("line"))), ["task"]).collect()}
    assert got == {1: 20.0, 2: None}


def test_readers(spark, tmp_path):
    plan = tmp_path / "plans" / "simple" / "layout_02"
    plan.mkdir(parents=True)
    (plan / "exhibit_input.txt").write_text("1-2: Greek\n# no\n4: Maya\n")
    (plan / "medium_01.json").write_text(json.dumps({"_comment": "x", "gallery_configs": {"A": "must_see"}, "at_least_n_exhibits_to_cover": 5, "exhibit_attribute_constraints": {"date_constraint": {"in_range": ["575 BC", "250"]}}}))
    via = {"metadata": {"1": {"xy": [2, 0, 0, 10, 5], "av": {"1": "1", "3": "Hall"}}, "2": {"xy": [3, 5, 5, 2], "av": {"2": "7"}}, "3": {"xy": [7, 0, 0, 4, 0, 4, 4], "av": {"1": "0"}}, "4": {"xy": [2, 0, 0, 100, 1], "av": {"1": "7", "4": "2050 mm"}}, "5": {"xy": [2, 1, 1, 1, 1], "av": {}}}}
    (plan / "via.json").write_text(json.dumps(via))
    done = tmp_path / "results" / "m(high)" / "hard" / "simple" / "hard_01_layout_02"
    done.mkdir(parents=True)
    (done / "final_results.json").write_text(json.dumps({"svr": {"connectivity": True}, "scsr": {}, "scar": {}}))
    (done.parent / "hard_02_layout_02").mkdir()
    (done.parent / "hard_02_layout_02" / "run.log").write_text("2026-04-29 11:06:49 - INFO - a\nmore\n")
    root = str(tmp_path)
    lines = files.placement_lines(spark, f"{root}/plans")
    assert {r.number for r in catalogue.parse_placements(lines).collect()} == {1, 2, 4}
    (task,) = files.task_configs(spark, f"{root}/plans", "medium_*.json").collect()
    assert (task.complexity, task.layout, task.task, task.gallery_configs, task.at_least_n_exhibits_to_cover) == ("simple", "layout_02", "medium_01", {"A": "must_see"}, 5)
    table = {(r.kind, r.id): r for r in files.read_annotations(spark, f"{root}/plans", "via.json").collect()}
    assert set(table) == {("gallery", "gallery_1"), ("exhibit", "exhibit_1"), ("wall", "wall_1"), ("scale", "scale_1")}
    assert table["gallery", "gallery_1"].area == 50 and table["exhibit", "exhibit_1"].area == 12 and table["wall", "wall_1"].coordinates.num_points == 3
    assert table["scale", "scale_1"].mm_per_px == 20.5
    (r,) = files.results(spark, f"{root}/results").collect()
    assert (r.model, r.difficulty, r.complexity, r.variant, r.layout, r.svr) == ("m(high)", "hard", "simple", "hard_01", "layout_02", {"connectivity": True})
    assert [r.dir.endswith("hard_02_layout_02") for r in files.folders_without(files.listing(spark, f"{root}/results"), "final_results.json").collect()] == [True]
    assert files.log_lines(spark, f"{root}/results").where("line <> ''").count() == 2
    with pytest.raises(ValueError, match="Technique"):
        files.require(spark.range(1), ["id", "Technique"])
    art = spark.createDataFrame([("1", 'a "b"\nc', b"x")], "id string, description string, Image binary")
    files.write_artifacts_csv(art, f"{root}/csv")
    assert spark.read.csv(f"{root}/csv", header=True, multiLine=True, escape='"').first().description == 'a "b"\nc'


def test_coverage_meets_different_requests_and_facts_only(spark):
    none = "array<string>"
    kinds = f"task long, layout long, in_range {none}, before_year string, after_year string, materials {none}, places {none}, techniques {none}, categories {none}, specific array<long>, min_n long"
    asked = [(k, k % 2, ["100", "300"] if k % 3 else [], "250" if k % 5 == 0 else None, None, ["RED"] if k % 2 else None, ["os"] if k % 7 == 0 else [], [], ["S", "T"] if k % 4 else None, [], 1) for k in range(40)]
    shown = [(k % 2, k, "ST"[k % 3 // 2], ("dark red", "blue", None)[k % 3], "t", 100 + k % 9 * 20, 120 + k % 9 * 20, "Kos" if k % 4 else None, "c") for k in range(60)]
    shown += [shown[3], (1, 5, "S", "red", "t", 150, 160, "Kos", "c")]  # one exhibit again, and one with other facts
    seen = [(t, e) for t in range(40) for e in range(60) if (t * 7 + e * 3) % 5] + [(99, 1), (0, 999)]
    tasks, rooms = spark.createDataFrame(asked, kinds), spark.createDataFrame(shown, "layout long, ex_id long, section string, material string, technique string, year_min int, year_max int, city string, country string")
    visits = spark.createDataFrame(seen, "task long, ex_id long")

    def needs(t, e):
        date = (not t[2] or (e[5] >= 100 and e[6] <= 300)) and (t[3] is None or e[6] < 250)
        each = {"date": (bool(t[2]) or t[3] is not None, date), "material": (bool(t[5]), "red" in (e[3] or "")), "place": (bool(t[6]), "os" in (e[7] or ""))}
        return {k: has and fits for k, (has, fits) in each.items()} | {"combined": any(h for h, _ in each.values()) and all(f for h, f in each.values() if h)}

    for name in ("date", "material", "place", "combined"):
        df = coverage.constraint_coverage(tasks, rooms, visits, name)
        got = {r.task: (r.n_required, r.n_visited) for r in df.collect()}
        for t in asked:
            wanted = {e[1] for e in shown if e[0] == t[1] and needs(t, e)[name]}
            assert got[t[0]] == (len(wanted), len(wanted & {e for k, e in seen if k == t[0]})), (name, t)


def test_coverage_moves_visits_once_and_knows_exhibits_by_needs(spark):
    none = "array<string>"
    kinds = f"task long, layout long, in_range {none}, before_year string, after_year string, materials {none}, places {none}, techniques {none}, categories {none}, specific array<long>, min_n long"
    tasks = spark.createDataFrame([(t, 0, [], None, None, ["RED"] if t % 2 else ["blue", "tan"], [], [], ["S"], [1, 900], 2) for t in range(20)], kinds)
    # as many different materials as exhibits, but two needs only
    rooms = [(0, e, "ST"[e % 2], ("red", "blue", "gray")[e % 3] + f" {e}", "t", None, None, None, None) for e in range(300)]
    rooms = spark.createDataFrame([*rooms, (0, 1, "S", "red too", "t", None, None, None, None)], "layout long, ex_id long, section string, material string, technique string, year_min int, year_max int, city string, country string")
    needs = coverage._needs(tasks, ("material",))
    shown = coverage._shown(rooms, ("material",), needs).select("fits").distinct()
    assert sorted(r.fits.material for r in shown.collect()) == [[], [1], [2]]
    visits = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 999), (2, 1), (2, 1)], "task long, ex_id long")
    (plan,) = [str(coverage._meet(coverage._visited(tasks, visits).distinct(), rooms)._jdf.queryExecution().executedPlan())]
    assert "BroadcastHashJoin [layout" not in plan and plan.count("hashpartitioning(layout") == 2
    got = {r.task: r for r in coverage.constraint_coverage(tasks, rooms, visits, "material").collect()}
    assert (got[1].n_required, got[1].n_visited) == (101, 2) and (got[2].n_required, got[2].n_visited) == (100, 1)
    found = {r.task: r for r in coverage.semantic_overall(tasks, rooms, visits).collect()}
    assert found[1].count_ok and not found[2].count_ok and not found[1].specific_ok
