"""Tables that an operator keeps while it runs, in the folder that all machines share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local[*] session without one, as in tests, gets a temporary folder."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        held = _checkpoint_dir(spark)
    if not held:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        held = "file://" + tempfile.mkdtemp(prefix="spark-planwalk-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def _checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


#: Bytes of an Arrow batch that goes to a Python worker; a longer row goes alone.
BATCH_BYTES = 1 << 24


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes as well as by rows, so that long texts don't add up in a worker.

    The bound stays set: plans are carried out after the operator that made them has returned."""
    held = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b"))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Spark's setting by which a plan's shuffle files go as soon as the plan is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; they are needed only until the table is there."""
    held = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, held)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/planwalk/{name}-{uuid.uuid4().hex}"


_scopes: list[list[tuple[SparkSession, str, str | None]]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables that were stored inside when it ends. What it leaves behind must not read them: store the result outside."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path, table in _scopes.pop():
            if table is not None:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def _new(spark: SparkSession, name: str, outer: int, table: str | None = None) -> str:
    path = new_path(spark, name)
    scopes = _scopes[: max(len(_scopes) - outer, 0)]
    if scopes:
        scopes[-1].append((spark, path, table))
    return path


def keep(df: DataFrame, name: str, codec: str = "zstd", outer: int = 0) -> DataFrame:
    """Writes df once to the shared folder and returns the stored table: its lineage ends there, and a lost executor costs no recomputation.

    outer: the table outlives so many scratch() from the innermost, and goes with the one around them, if there is one."""
    spark = df.sparkSession
    path = _new(spark, name, outer)
    with releasing(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, name: str, key: str, buckets: int, codec: str = "zstd", outer: int = 0) -> DataFrame:
    """As keep, in buckets by the key: tables with as many buckets by one key meet without a shuffle."""
    spark = df.sparkSession
    table = f"planwalk_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = _new(spark, name, outer, table)
    with releasing(spark):
        df.write.option("compression", codec).option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)
