"""Result files scored as they arrive: the batch scores over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from planwalk.operators import scoring
from planwalk.sources import files


def stream_results(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(model, difficulty, complexity, variant, layout, svr, scsr, scar, geometric_fidelity) of result files, each read once."""
    raw = spark.readStream.schema(files.RESULT).option("recursiveFileLookup", True).option("pathGlobFilter", "final_results.json").option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.select("*", files.result_parts(F.col("_metadata.file_path")).alias("p_")).select("p_.*", *raw.columns)


def leaderboard(results: DataFrame) -> DataFrame:
    """(model, difficulty, n, and passed tasks of each metric) so far; its state is one row for each model and difficulty."""
    checks = {"svr": scoring.SVR, "scsr": scoring.SCSR, "scar": scoring.SCAR}
    scored = results.select("model", "difficulty", *[scoring.binary(F.col(m), k).alias(m) for m, k in checks.items()])
    return scored.groupBy("model", "difficulty").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"{m}_correct") for m in checks])


def write_leaderboard(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Scores what has arrived and stops; each batch's whole board is written to a folder of its own below `out`."""

    def save(board: DataFrame, batch: int) -> None:
        board.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    board = leaderboard(stream_results(spark, folder))
    return board.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
