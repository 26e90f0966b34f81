"""Mixing sources to target weights, by blocks of a fixed number of words.

1. Each source's words, documents in ascending id order, are packed end to end into blocks of BLOCK_WORDS words.
2. Targets: the sources, in code-point order and null last, weigh WEIGHTS over and over and share `share` times all words;
   none gets more than `most` times its own words, and the excess goes to the others by weight.
3. Each output shard of `shard_slots` slots draws how many of them each source fills from a multinomial, under the
   condition that all shards together meet every source's quota: the quotas are halved again and again, the first half
   of the shards drawing from what is to be given and leaving the rest to the second, down to the single shard.
4. A source's slots run through pseudorandom permutations of its block indices, a new one after each pass, and slots and
   blocks are joined on (source, index). No block is taken twice before all are taken once. The joined table is the mix:
   for each slot of each shard, the spans of documents that its block is packed from. Slots of a shard's sources are
   interleaved by a permutation of the shard.

The driver holds a few numbers per source, MOST_SOURCES at most; a shard's draw is made in the task that fills it, and
blocks, slots and documents stay distributed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .prefix import running_sum

#: Words of a block; slots of a shard; sources that a mix may have.
BLOCK_WORDS, SHARD_SLOTS, MOST_SOURCES = 256, 1024, 10_000
WEIGHTS = (5.0, 2.0, 1.0)
ROUNDS = 6


def n_words(text_col: str):
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null: word starts are where a word character follows none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """Target of each source, given in order: its weight's part, none above `most` times its size."""
    size = np.array(sizes, dtype=np.float64)
    weight = np.array([weights[k % len(weights)] for k in range(len(sizes))])
    cap, total = most * size, share * size.sum()
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        left = total - out[~free].sum()
        want = left * weight[free] / weight[free].sum()
        over = want > cap[free]
        if not over.any():
            out[free] = want
            break
        stopped = np.flatnonzero(free)[over]
        out[stopped] = cap[stopped]
        free[stopped] = False
    return out.tolist()


def quotas(sizes: list[int], goals: list[float], block: int) -> list[int]:
    """Slots of each source: its target in units of its mean block."""
    out = []
    for size, goal in zip(sizes, goals):
        blocks = -(-size // block)
        out.append(int(round(goal * blocks / size)) if size else 0)
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, need: int) -> np.ndarray:
    """A draw of `need` slots from what is left of each source: multinomial under the condition that the rest comes after.

    That is hypergeometric. Beyond what numpy draws so, a plain multinomial without more than is left stands in for it;
    the halves are then so large that their shares hardly differ."""
    if left.sum() < 10**9:
        return rng.multivariate_hypergeometric(left, need, method="marginals")
    drawn = np.zeros(len(left), np.int64)
    while need:
        rest = left - drawn
        got = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
        drawn += got
        need -= int(got.sum())
    return drawn


def shard_counts(quota: list[int], shard_slots: int, seed: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in the shard, slots of each source in the shards before); follows from the arguments alone.

    All shards but the last have `shard_slots` slots, and all together use up every quota."""
    left, before = np.array(quota, np.int64), np.zeros(len(quota), np.int64)
    low, high = 0, -(-int(left.sum()) // shard_slots)
    while high - low > 1:
        middle = (low + high) // 2
        first = _draw(np.random.default_rng([seed, low, high]), left, (middle - low) * shard_slots)
        if shard < middle:
            high, left = middle, first
        else:
            low, left, before = middle, left - first, before + first
    return left, before


def permuted(index: np.ndarray, n: int, key: bytes) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the given places: a Feistel network over the next power of four, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(key + bytes([r]), digest_size=8).digest(), "little")) for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(33)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _mixed(df: DataFrame, share: float, most: float, block: int, shard_slots: int, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, slots): df's rows (row, doc_id, code, size, at, source_size, target), stored, and (shard, slot, source, index, spans) of each slot."""
    spark = df.sparkSession
    sized = store.keep(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a mix has {MOST_SOURCES} sources at most")
    totals = sorted(((r["source"], r["n"]) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    goals = targets(sizes, share, most)
    quota = quotas(sizes, goals, block)
    starts = np.cumsum([0, *sizes])[:-1].tolist()
    config = spark.createDataFrame(
        pd.DataFrame({"source": pd.Series([s for s, _ in totals], dtype=object), "code": np.arange(len(totals)), "source_size": np.array(sizes, np.int64), "target": np.array(goals, float), "first": np.array(starts, np.int64)}),
        "source string, code bigint, source_size bigint, target double, first bigint",
    )
    coded = sized.join(config.select("source", "code").withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).select("doc_id", "size", "code")
    placed = running_sum(coded, ["code", "doc_id", "size"], "size", "at", "mix-placed").join(config.drop("source"), "code").withColumn("at", F.col("at") - F.col("first"))
    placed = placed.select("*", F.monotonically_increasing_id().alias("row"))
    placed = store.keep(placed, "mix-rows")
    n_blocks = [-(-n // block) for n in sizes]

    def slots(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                drawn, before = shard_counts(quota, shard_slots, seed, shard)
                many, ahead = int(drawn.sum()), 0
                for code in np.flatnonzero(drawn).tolist():
                    n, blocks = int(drawn[code]), n_blocks[code]
                    at = before[code] + np.arange(n)
                    index = np.zeros(n, np.int64)
                    for turn in np.unique(at // blocks).tolist():
                        some = at // blocks == turn
                        index[some] = permuted(at[some] % blocks, blocks, f"{seed}/{code}/{turn}".encode())
                    slot = permuted(np.arange(ahead, ahead + n), many, f"{seed}/shard/{shard}".encode())
                    ahead += n
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(n, shard)), "slot": pa.array(slot), "code": pa.array(np.full(n, code)), "index": pa.array(index)})

    shards = spark.range(-(-sum(quota) // shard_slots))
    drawn = shards.mapInArrow(slots, "shard bigint, slot bigint, code bigint, index bigint")
    parts = placed.where("size > 0").select("row", "doc_id", "code", "at", "size", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("index"))
    low = F.greatest(F.col("at"), F.col("index") * block)
    span = F.struct(low.alias("place"), "row", "doc_id", (low - F.col("at")).alias("first"), (F.least(F.col("at") + F.col("size"), (F.col("index") + 1) * block) - low).alias("n"))
    packed = parts.groupBy("code", "index").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    packed = packed.withColumn("spans", F.transform("spans", lambda x: F.struct(x["row"].alias("row"), x["doc_id"].alias("doc_id"), x["first"].alias("first"), x["n"].alias("n"))))
    # slots come of a small plan, by whose size Spark would broadcast them all
    filled = drawn.join(packed.hint("merge"), ["code", "index"]).join(F.broadcast(config.select("code", "source")), "code")
    return placed, filled.select("shard", "slot", "source", "index", "spans")


def mix_shards(df: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, one row (shard, slot, source, index, spans) for each slot; see the module's text.

    spans: in order, (row, doc_id, first, n) of the n words from word `first` of each document that lies in the source's
    block `index`; row tells documents that share an id apart."""
    with store.scratch():
        return store.keep(_mixed(df, share, most, block, shard_slots, seed, id_col, text_col, source_col)[1], "mix-shards", outer=True)


def mix(df: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row (doc_id, size, source_size, target, taken) for each row of df; see the module's text.

    taken counts the document's words in all slots that take a block they lie in. A null text has no words and is not
    taken; null is a source of its own. Repeated rows and ids are documents of their own, in any order among
    themselves. An empty table gives an empty result. The same table and seed give the same mix. Other columns are not read.
    Sources are a mix's configuration: one number for each reaches the driver.
    """
    with store.scratch():
        placed, slots = _mixed(df, share, most, block, shard_slots, seed, id_col, text_col, source_col)
        counted = store.keep(slots, "mix-shards").select(F.explode("spans").alias("x")).groupBy("x.row").agg(F.sum("x.n").alias("taken"))
        taken = placed.join(counted.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
        return store.keep(taken, "mix-taken", outer=True)


def apply_mix(df: DataFrame, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """df as the mix takes it: each document as often as its words are taken on average, the fraction decided by a hash
    of its id, so a source's words come near its target and whole texts stay whole; one document that holds most of a
    source can move it off its target by up to that document's words. Documents that the mix doesn't take, those without words among them, go. Rows that repeat an id are taken alike."""
    found = mix(df, share, most, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    times = found.where("size > 0").select(F.col("doc_id").alias("id_"), F.floor(F.col("taken") / F.col("size") + chance).cast("int").alias("times_")).where("times_ > 0")
    return df.join(times, F.col(id_col).eqNullSafe(F.col("id_"))).select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("times_"))).alias("copy_")).select(*df.columns)
