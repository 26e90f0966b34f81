"""Running sums over a whole table without one task that sees it all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store


def running_sum(df: DataFrame, order: list[str], value: str, out: str, name: str, number: str | None = None) -> DataFrame:
    """df and `out`: the sum of `value` over all rows before this one in ascending order (nulls first); `number`, if
    named, counts those rows.

    df is dealt in ranges of `order` and stored in the shared folder with each range's own running sum; then each
    range's start is added. Only one row for each range meets in one task. df is read twice (its ranges are sampled),
    so hand over a stored table. Rows that tie in all of `order` follow each other in any sequence.
    """
    schema = df.schema.simpleString()[7:-1] + ", part_ bigint, own_ bigint, place_ bigint"
    columns = df.columns
    where = columns.index(value)

    def add(batches):
        total = seen = 0
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            v = batch.column(where).to_numpy(zero_copy_only=False).astype(np.int64)
            after = np.cumsum(v) + total
            more = [pa.array(np.full(len(v), part, np.int64)), pa.array(after - v), pa.array(np.arange(seen, seen + len(v)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "part_", "own_", "place_"])
            total = int(after[-1]) if len(v) else total
            seen += len(v)

    ranged = df.repartitionByRange(*[F.col(c).asc() for c in order]).sortWithinPartitions(*order)
    held = store.keep(ranged.mapInArrow(add, schema), name)
    totals = held.groupBy("part_").agg(F.sum(value).alias("sum_"), F.count(F.lit(1)).alias("rows_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part_", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(s) for c, s in (("sum_", "start_"), ("rows_", "first_"))))
    numbered = [(F.col("place_") + F.col("first_")).alias(number)] if number else []
    return held.join(F.broadcast(starts), "part_").select(*columns, (F.col("own_") + F.col("start_")).alias(out), *numbered)
