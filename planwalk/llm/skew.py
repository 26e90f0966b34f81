"""Equi-joins whose hot keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task gets; most keys that are split, so that their list has a proven bound.
PIECE, MOST_KEYS = 1000, 100_000


def split_join(many: DataFrame, one: DataFrame, key: str, salt: list[str], how: str = "inner", piece: int = PIECE, counts: DataFrame | None = None) -> DataFrame:
    """many joined with one on key, with the rows of a key that `many` repeats dealt to several tasks.

    A key is split if more than `piece` rows of many have it. Of such keys the MOST_KEYS most frequent are split and
    broadcast with their number of pieces; what others there may be have less than 1 / MOST_KEYS of all rows each. A
    row's piece follows from a hash of its `salt` columns, and the rows of `one` under a split key are repeated for each
    piece. `many` is read twice: hand over a stored table, or the stored `counts` (key, count) of its rows, which then is
    read in its place. A null key joins with nothing.
    """
    counts = many.groupBy(key).count() if counts is None else counts
    hot = counts.where((F.col("count") > piece) & F.col(key).isNotNull()).orderBy(F.desc("count")).limit(MOST_KEYS)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("count") / piece).cast("int").alias("pieces_")))
    dealt = many.join(hot, key, "left").withColumn("salt_", F.when(F.col("pieces_").isNull(), 0).otherwise(F.pmod(F.xxhash64(*salt), F.col("pieces_")).cast("int"))).drop("pieces_")
    copied = one.join(hot, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces_"), F.lit(1)) - 1))).drop("pieces_")
    return dealt.join(copied, [key, "salt_"], how).drop("salt_")
