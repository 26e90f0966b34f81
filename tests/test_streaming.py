"""The streamed leaderboard is the batch one."""

import json

from planwalk.sources import files
from planwalk.streaming import results


def test_leaderboard_follows_new_files(spark, tmp_path):
    def put(model, k, good):
        d = tmp_path / "results" / model / "hard" / "simple" / f"hard_0{k}_layout_02"
        d.mkdir(parents=True)
        checks = {"connectivity": True, "wall_crossings": not good, "exhibit_collision": False, "out_of_area_violations": False}
        (d / "final_results.json").write_text(json.dumps({"svr": checks, "scsr": {"start_end_location": good}, "scar": {}}))

    folder, out, held = (str(tmp_path / x) for x in ("results", "out", "held"))
    put("a", 1, True)
    put("a", 2, False)
    results.write_leaderboard(spark, folder, out, held).awaitTermination(60)
    put("b", 1, True)
    results.write_leaderboard(spark, folder, out, held).awaitTermination(60)
    last = max(r.batch for r in spark.read.parquet(out).select("batch").distinct().collect())
    got = {tuple(r) for r in spark.read.parquet(out).where(f"batch = {last}").drop("batch").collect()}
    assert got == {tuple(r) for r in results.leaderboard(files.results(spark, folder)).collect()}
    assert got == {("a", "hard", 2, 1, 1, 0), ("b", "hard", 1, 1, 1, 0)}
