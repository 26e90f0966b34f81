"""Token-ID / binary output: a content-addressed store of id streams.

A rolling hash over the last WINDOW ids cuts each document's stream into chunks, so that equal passages give equal
chunks wherever they stand. The store is three Parquet tables in one folder:

- chunks(digest, width, ids): each distinct chunk once; ids are little-endian unsigned integers of `width` bytes.
- recipes(number, doc_id, start, n_tokens, root, chunks): documents in ascending doc_id order, numbered from 0; `chunks`
  are the digests to put end to end, `root` their Merkle root, `start` the number of ids of all documents before.
- manifest(level, node, n_docs, n_tokens, root): the hash tree over all recipes. A node of level 0 covers FAN documents
  that follow each other; its leaves hash doc_id, start, n_tokens and root of each. A node of the next level covers FAN
  nodes. The last level has one node; its root stands for the whole store and is what `write_store` returns.

Digests are 16-byte BLAKE2b over the ids as unsigned 32-bit integers. Reading puts the tree together again from the
recipes and compares every node, checks every chunk against its digest and every document against its root and its
number of ids, and fails on the first mismatch. Who keeps the store's root notices a store that was exchanged as a whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .prefix import running_sum
from .skew import split_join
from . import store

#: Ids that the rolling hash sees; mean, least and most ids of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 512, 128, 4096
#: Children of a node of the manifest.
FAN = 4096
BATCH_BYTES = 1 << 20

_STAGE = "kind int, doc_id bigint, n_tokens bigint, root binary, chunks array<binary>, digest binary, width int, ids binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is. Leaves and inner nodes are hashed apart."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def chunk_ends(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each row the places where its chunks end, the row's own end last."""
    weight, inverse = bt.powers(len(ids) + 1)
    total = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(bt.mix(ids.astype(np.uint64) + np.uint64(1)) * weight[: len(ids)], out=total[1:])
    hit = np.zeros(0, np.int64)
    if len(ids) >= WINDOW:
        rolled = bt.mix((total[WINDOW:] - total[:-WINDOW]) * inverse[: len(ids) - WINDOW + 1])
        hit = np.flatnonzero(rolled & np.uint64(MEAN - 1) == 0) + WINDOW
    first = np.searchsorted(hit, bounds)
    out = []
    for k in range(len(bounds) - 1):
        at, end, ends = int(bounds[k]), int(bounds[k + 1]), []
        for place in hit[first[k] : first[k + 1]].tolist():
            while place - at > MOST:
                at += MOST
                ends.append(at)
            if place - at >= LEAST and end - place > 0:
                ends.append(place)
                at = place
        while end - at > MOST:
            at += MOST
            ends.append(at)
        ends.append(end)
        out.append(ends)
    return out


def _encode(tokenizer: str, end_id: int):
    def run(batches):
        from .encoder import encoder

        coder = encoder(tokenizer, True)
        seen: set[bytes] = set()
        for batch in batches:
            data, bounds = bt.buffers(batch.column(1))
            names = batch.column(0)
            for low, high, lens, ids in coder.encode_groups(data, bounds, BATCH_BYTES):
                stops = np.cumsum(lens)
                ids = np.insert(ids, stops, end_id)
                rows = np.concatenate(([0], stops + np.arange(1, len(stops) + 1)))
                docs: list[tuple] = []
                new: list[tuple] = []
                for k, ends in enumerate(chunk_ends(ids, rows)):
                    at, recipe = int(rows[k]), []
                    for end in ends:
                        chunk = ids[at:end]
                        name = digest(chunk.astype("<u4").tobytes())
                        recipe.append(name)
                        if name not in seen:
                            seen.add(name)
                            width = 2 if int(chunk.max(initial=0)) < 65536 else 4
                            new.append((name, width, chunk.astype(f"<u{width}").tobytes()))
                        at = end
                    docs.append((int(rows[k + 1] - rows[k]), merkle(recipe), recipe))
                if len(seen) > 2_000_000:  # a chunk may then be handed on twice; the store still keeps one
                    seen.clear()
                none, more = [None] * len(docs), [None] * len(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * len(docs) + [1] * len(new), pa.int32()),
                        pa.concat_arrays([names.slice(low, high - low).cast(pa.int64()), pa.nulls(len(new), pa.int64())]),
                        pa.array([x[0] for x in docs] + more, pa.int64()),
                        pa.array([x[1] for x in docs] + more, pa.binary()),
                        pa.array([x[2] for x in docs] + more, pa.list_(pa.binary())),
                        pa.array(none + [x[0] for x in new], pa.binary()),
                        pa.array(none + [x[1] for x in new], pa.int32()),
                        pa.array(none + [x[2] for x in new], pa.binary()),
                    ],
                    names=["kind", "doc_id", "n_tokens", "root", "chunks", "digest", "width", "ids"],
                )

    return run


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> bytes | None:
    """Encodes every whole text (null: empty), appends end_id, and writes the store to `path`, a folder all machines share.

    Returns the store's root; None for an empty table, whose store has no rows. Rows with equal ids each keep their own
    recipe, in the order of their roots; a null id comes first. Ids are whole numbers. Columns besides id_col and
    text_col are not read. Chunks meet by digest, and each task hands on a chunk once, so copies cost recipes, not bytes.
    """
    spark = df.sparkSession
    store.bound_batches(spark)
    with store.scratch():
        texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        stage = store.keep(texts.mapInArrow(_encode(tokenizer, end_id), _STAGE), "token-stage")
        chunks = stage.where("kind = 1").select("digest", "width", "ids").dropDuplicates(["digest"])
        with store.releasing(spark):
            chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
        docs = stage.where("kind = 0").select("doc_id", "n_tokens", "root", "chunks")
        placed = running_sum(docs, ["doc_id", "root"], "n_tokens", "start", "token-recipes", "number")
        recipes = placed.repartitionByRange("number").sortWithinPartitions("number").select("number", "doc_id", "start", "n_tokens", "root", "chunks")
        with store.releasing(spark):
            recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    level, nodes = 0, _tree_level(_leaves(spark.read.parquet(f"{path}/recipes")))
    while True:
        nodes.select(F.lit(level).alias("level"), "node", "n_docs", "n_tokens", "root").write.mode("append").parquet(f"{path}/manifest")
        held = spark.read.parquet(f"{path}/manifest").where(F.col("level") == level)
        top = held.select("root").limit(2).collect()
        if len(top) < 2:
            return bytes(top[0][0]) if top else None
        level, nodes = level + 1, _tree_level(_inner(held))


def _leaves(recipes: DataFrame) -> DataFrame:
    leaf = F.concat_ws(",", F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root"))
    return recipes.select("number", "n_tokens", F.lit(1).cast("bigint").alias("n_docs"), leaf.cast("binary").alias("leaf"))


def _inner(nodes: DataFrame) -> DataFrame:
    leaf = F.concat_ws(",", F.lit("node"), "n_docs", "n_tokens", F.hex("root"))
    return nodes.select(F.col("node").alias("number"), "n_tokens", "n_docs", leaf.cast("binary").alias("leaf"))


def _tree_level(below: DataFrame) -> DataFrame:
    """(node, n_docs, n_tokens, root): the nodes over rows (number, n_tokens, n_docs, leaf), FAN numbers each."""

    def roots(batches):
        for batch in batches:
            made = [merkle([x["leaf"] for x in leaves]) for leaves in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], names=["node", "n_docs", "n_tokens", "root"])

    grouped = below.groupBy(F.expr(f"number div {FAN}").alias("node")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("number", "leaf"))).alias("leaves"))
    return grouped.mapInArrow(roots, "node bigint, n_docs bigint, n_tokens bigint, root binary")


def _documents(with_ids: bool):
    """(root, n, crc, ids) of each distinct recipe from its chunks; fails where they don't have their digests or don't give the root."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for root, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, pieces = [], []
                for x in parts.as_py():
                    if x["ids"] is None:
                        raise ValueError("a chunk is missing from the store")
                    wide = np.frombuffer(x["ids"], f"<u{x['width']}").astype("<u4").tobytes()
                    if digest(wide) != x["digest"]:
                        raise ValueError(f"chunk {x['digest'].hex()} was damaged")
                    names.append(x["digest"])
                    pieces.append(wide)
                if merkle(names) != root:
                    raise ValueError(f"recipe {root.hex()} was damaged")
                whole = b"".join(pieces)
                out.append((root, len(whole) // 4, zlib.crc32(whole), whole if with_ids else None))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["root", "n", "crc", "ids"])

    return run


def check_manifest(spark: SparkSession, path: str, root: bytes | None = None) -> DataFrame:
    """The recipes, once the hash tree over them is the stored one, up to its root (`root` if given)."""
    store.bound_batches(spark)
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    below, level = _leaves(recipes), 0
    while True:
        held = manifest.where(F.col("level") == level).select("node", "n_docs", "n_tokens", "root")
        if _tree_level(below).exceptAll(held).take(1) or held.groupBy("node").count().where("count > 1").take(1):
            raise ValueError("the recipes don't agree with the manifest")
        top = held.limit(2).collect()
        if len(top) < 2:
            break
        below, level = _inner(held), level + 1
    last = manifest.agg(F.max("level")).first()[0] or 0
    extra = top and (top[0]["node"] != 0 or last != level)
    rows = recipes.agg(F.count(F.lit(1)), F.max("number") + 1, F.count_distinct("number")).first()
    if extra or (not top and last) or (top and top[0]["n_docs"] != rows[0]) or rows[0] != (rows[1] or 0) or rows[0] != rows[2]:
        raise ValueError("the recipes don't agree with the manifest")
    if root is not None and (not top or bytes(top[0]["root"]) != root):
        raise ValueError("the store doesn't have the root that was asked for")
    return recipes


def _read(spark: SparkSession, path: str, root: bytes | None, with_ids: bool) -> DataFrame:
    """(doc_id, start, n_tokens, crc, ids) of each recipe."""
    recipes = check_manifest(spark, path, root)
    parts = store.keep(recipes.select("root", "chunks").dropDuplicates(["root"]).select("root", F.posexplode("chunks").alias("pos", "digest")), "token-parts")
    met = split_join(parts, spark.read.parquet(f"{path}/chunks"), "digest", ["root", "pos"], "left")
    whole = met.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "width", "ids"))).alias("parts"))
    whole = whole.mapInArrow(_documents(with_ids), "root binary, n bigint, crc bigint, ids binary")
    found = split_join(recipes.select("number", "doc_id", "start", "n_tokens", "root"), whole, "root", ["number"], "left")
    checked = F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error(F.lit("a recipe's number of ids is not that of its chunks")).cast("bigint"))
    return found.select("doc_id", "start", checked.alias("n_tokens"), "crc", "ids")


def verify_store(spark: SparkSession, path: str, root: bytes | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its ids as they are put together from the stored files."""
    with store.scratch():
        found = _read(spark, path, root, False).select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
        return store.keep(found, "token-facts", outer=True)


def read_documents(spark: SparkSession, path: str, root: bytes | None = None) -> DataFrame:
    """(doc_id, start, ids array<bigint>) of every document; chunks are checked, joined to their recipes and put end to end."""

    def wide(batches):
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return _read(spark, path, root, True).select("doc_id", "start", "n_tokens", "ids").mapInArrow(wide, "doc_id bigint, start bigint, ids array<bigint>")
