"""Tables that an iterative plan stores between its rounds, in the folder that all machines share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    held = "file://" + tempfile.mkdtemp(prefix="spark-planwalk-")
    spark.conf.set("spark.checkpoint.dir", held)
    return held


#: Spark's setting by which a plan's shuffle files go as soon as the plan is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _releasing(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; they are needed only until the table is there."""
    held = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, held)


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables that were kept inside when it ends; what must outlive it is kept with outer=True."""
    _scopes.append([])
    try:
        yield
    finally:
        drop(*_scopes.pop())


#: Rows of a task to which `dealt` deals a table, about: what neighbours add to them stays small in memory.
ROWS = 100_000


def dealt(stored: DataFrame, more: int = 1) -> DataFrame:
    """A stored table dealt by route to as many tasks as its rows need, or `more` times as many: what then groups by route
    and more, moves no row, and a task stays as large however large the table is."""
    n = max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() * more // ROWS))
    return stored.repartition(n, "route")


def meet(one: DataFrame, other: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input: merged, never broadcast, as few stored bytes may hold many rows."""
    return one.join(other.hint("merge"), on, how)


def keep(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df written once to the shared folder and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planwalk/{name}-{uuid.uuid4().hex}"
    with _releasing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    scopes = _scopes[:-1] if outer else _scopes
    if scopes:
        scopes[-1].append(out)
    return out


def drop(*kept: DataFrame) -> None:
    """Removes tables of `keep` that nothing reads any more."""
    for df in kept:
        spark = df.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
