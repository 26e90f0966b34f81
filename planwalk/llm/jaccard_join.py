"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, and the components they form.

1. A table of counters says how many documents hold each shingle hash's slot. It is summed on the executors and
   broadcast; it has a slot for every 64 bytes of text, but LEAST_SLOTS at least and MOST_SLOTS at most (16 MB).
   (slot count, hash) orders all shingles rare-first, the same for every document; shingles that share a slot cost
   selectivity, not results.
2. Documents with equal sets become one node, known by the set's digest. A set's prefix is so long that two sets that
   link share one of their prefix shingles at least. Prefixes meet in an equi-join on the shingle.
3. A pair is left out if lengths or positions rule it out (at its first shared prefix shingle), or a histogram of the
   two sets' hashes does (the suffix filter: half their bucket-wise difference bounds the symmetric difference).
   What remains is verified on the two sets, once.
4. Pairs in a shingle's group are first taken between one member and the others, twice with different members, and those
   that pass are verified; pairs whose ends already are in one component are then needless for the components. In the
   groups that still hold several components, a pair is taken only where none of the BEFORE shingles ahead of it in one
   prefix is among those in the other, which holds where the two first meet: sets that share a long run of their prefixes
   meet there once. In large groups, sets that link must share two shingles at least of prefixes that are one longer, so
   members with short prefixes meet on (group, second shingle). All pairs that meet and pass the filters are verified,
   so no link is lost. Hot shingles are split over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from . import store
from .skew import split_join

#: Counters of the shingle table; bits of the map of needed documents; slices in which both travel.
LEAST_SLOTS, MOST_SLOTS, LEAST_BITS, MOST_BITS, SLICES = 1 << 20, 1 << 22, 1 << 20, 1 << 27, 64
#: Members outside its largest component up to which a group's pairs are taken without a second shingle.
FEW = 32
#: Longest prefixes that meet on two shingles, of which they hold the square; places ahead at which a pair may have met before.
SHORT, BEFORE = 16, 8
#: Histogram buckets of the suffix filter.
BINS = 64
BATCH_BYTES = 1 << 20


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    return np.unique(bt.shingles(hashes, size))


def _sets(batch_column: pa.Array, size: int):
    """Yields (row in batch, sorted shingle hashes) for each row."""
    data, bounds = bt.buffers(batch_column)
    for low, high in bt.groups(bounds, BATCH_BYTES):
        part = bounds[low : high + 1] - bounds[low]
        _, _, hashes, rows = bt.words(data[bounds[low] : bounds[high]], part, bt.SPACED)
        for k in range(high - low):
            yield low + k, shingle_set(hashes[rows[k] : rows[k + 1]], size)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _power(n: float, least: int, most: int) -> int:
    """The least power of two from n on, within bounds that are powers of two."""
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def _sum_slices(parts: DataFrame, join, kind: str) -> bytes:
    """SLICES rows (slice, data) of each task put together on the executors by `join`; what reaches the driver has a fixed size."""

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(x, kind)
                total[k] = join(total[k], part) if k in total else part
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()), "data": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    found = {r["slice"]: bytes(r["data"]) for r in parts.repartition(SLICES, "slice").mapInArrow(merge, "slice int, data binary").collect()}
    return b"".join(found[k] for k in range(SLICES)) if found else b""


def _slices(whole: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "data": pa.array([x.tobytes() for x in whole.reshape(SLICES, -1)], pa.binary())})


def slot_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many documents' shingles fall into each slot, over all documents."""
    slots = _power((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 64, LEAST_SLOTS, MOST_SLOTS)

    def count(batches):
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            parts, many = [], 0
            for _, found in _sets(batch.column(0), size):
                parts.append(found)
                many += len(found)
                if many > BATCH_BYTES:
                    total += np.bincount(_slot(np.concatenate(parts), slots), minlength=slots).astype(np.uint32)
                    parts, many = [], 0
            if parts:
                total += np.bincount(_slot(np.concatenate(parts), slots), minlength=slots).astype(np.uint32)
        yield _slices(total)

    # a full counter stays full
    add = lambda x, y: np.minimum(x.astype(np.int64) + y, 2**32 - 1).astype("<u4")
    whole = np.frombuffer(_sum_slices(texts.select("text").mapInArrow(count, "slice int, data binary"), add, "<u4"), "<u4")
    return whole if len(whole) else np.zeros(slots, np.uint32)


def _node(found: np.ndarray) -> int:
    """The number by which a set is known: 64 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _summaries(texts: DataFrame, size: int, num: int, den: int, counts) -> DataFrame:
    """(doc_id, n, node, bins, prefix) of each document: set size, the set's number, its histogram, its rarest shingles in
    order, one more than those of which a linked set has one."""

    def run(batches):
        weights = counts.value
        for batch in batches:
            n, nodes, bins, prefixes = [], [], [], []
            for _, found in _sets(batch.column(1), size):
                n.append(len(found))
                if not len(found):
                    nodes.append(None)
                    bins.append(None)
                    prefixes.append(None)
                    continue
                nodes.append(_node(found))
                bins.append(np.minimum(np.bincount((found >> np.uint64(32)).astype(np.int64) & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes())
                order = np.argsort(weights[_slot(found, len(weights))], kind="stable")
                prefixes.append(found[order[: len(found) - -(-num * len(found) // den) + 2]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bins, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "n", "node", "bins", "prefix"],
            )

    return texts.mapInArrow(run, "doc_id bigint, n bigint, node bigint, bins binary, prefix array<bigint>")


def _with_ends(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pairs (a, b), stored, with columns of table (node, ...) for both ends, named by end; a hot end is split."""
    out = pairs
    for end, other in ("ab", "ba"):
        side = table.select(F.col("node").alias(end), *(F.col(c).alias(short + end) for c, short in columns.items()))
        out = split_join(out, side, end, [other], counts=pairs.groupBy(end).count())
    return out


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose histograms leave room for enough shared shingles."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for k in (4, 5))
            apart = np.abs(x - y).sum(axis=1)
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            least = -(-num * (na + nb) // (num + den))
            yield batch.filter(pa.array(apart <= na + nb - 2 * least)).select([0, 1])

    return _with_ends(pairs, nodes, {"n": "n", "bins": "x"}).select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (bt.mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def needed_map(ids: DataFrame, bits: int) -> np.ndarray:
    """A map of so many bits with the bit of each id set, made on the executors."""

    def mark(batches):
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _bit(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if held.any():
            yield _slices(held)

    whole = np.frombuffer(_sum_slices(ids.mapInArrow(mark, "slice int, data binary"), np.bitwise_or, "u1"), np.uint8)
    return whole if len(whole) else np.zeros(bits // 8, np.uint8)


def _needed_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of wanted (node, low), made again from the texts of the ids `low`: sets of all documents would be
    as large as the texts. Beyond MOST_BITS / 16 ids the map passes more documents than those needed, which costs work only."""
    bits = _power(16 * wanted.count(), LEAST_BITS, MOST_BITS)
    held = texts.sparkSession.sparkContext.broadcast(needed_map(wanted.select("low"), bits))

    def run(batches):
        for batch in batches:
            at = _bit(batch.column(0).to_numpy(), bits)
            some = pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).cast(pa.bool_())
            sets = [x for _, x in _sets(batch.column(1).filter(some), size) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node bigint, shingles binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets really link."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                good.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    return _with_ends(pairs, sets, {"shingles": "s"}).select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every end of the edges (a, b): the smallest id it can reach.

    Each round takes the smallest label among a node's neighbours, then its label's label, so paths shrink by half;
    labels are stored in the shared folder after each round. Nothing but a count of changes reaches the driver.
    """
    both = store.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), name)
    counts = store.keep(both.groupBy("b").count(), name)
    labels = store.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), name)
    while True:
        near = split_join(both, labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b", ["a"], counts=counts).groupBy("a").agg(F.min("c").alias("c"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = lower.join(up, "component", "left").select("id", "old", F.least("component", F.coalesce("top", "component")).alias("component"))
        new = store.keep(new, name)
        labels = new.select("id", "component")
        if not new.where("component < old").take(1):
            return labels


def _label(table: DataFrame, labels: DataFrame | None, column: str, out: str) -> DataFrame:
    if labels is None:
        return table.withColumn(out, F.col(column))
    found = labels.select(F.col("id").alias(column), F.col("component").alias("component_"))
    return table.join(found, column, "left").select(*table.columns, F.coalesce("component_", column).alias(out))


def _least(na: str, nb: str, num: int, den: int) -> str:
    """SQL of the fewest shared shingles of two linked sets."""
    return f"(({num} * ({na} + {nb}) + {num + den - 1}) div {num + den})"


def _possible(pairs: DataFrame, num: int, den: int, shared: int = 1) -> DataFrame:
    """Length and position filter on rows (a, na, pa, b, nb, pb) of different sets, whose `shared`-th common shingle is
    at pa and pb or before; the ends in order, each pair once."""
    least = _least("na", "nb", num, den)
    fit = pairs.where(f"a <> b AND {den} * least(na, nb) >= {num} * greatest(na, nb)")
    fit = fit.where(f"least(na - pa, nb - pb) + {shared - 1} >= {least} AND {least} <= least(na, nb) - if(na = nb, 1, 0)")
    return fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ends(table: DataFrame, end: str, key: str, *more: str) -> DataFrame:
    """(key, end, its set size and position) of a table of prefix rows."""
    return table.select(key, F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("pos").alias(f"p{end}"), *(F.col(c).alias(c + end) for c in more))


def _apart(table: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows (key, node, n, pos, c) of a stored table whose key several components c have; and of those keys, stored,
    their rows (`count`) and their largest component (`most`, with `in_most` rows)."""
    each = table.groupBy(key, "c").agg(F.count(F.lit(1)).alias("in_most"))
    groups = each.groupBy(key).agg(F.sum("in_most").alias("count"), F.count(F.lit(1)).alias("kinds"), F.max_by("c", F.struct("in_most", "c")).alias("most"), F.max("in_most").alias("in_most"))
    groups = store.keep(groups.where("kinds > 1").drop("kinds"), name)
    return split_join(table, groups, key, ["node"], counts=groups.select(key, "count")), groups


def _of_different(rows: DataFrame, groups: DataFrame, key: str, where: str = "true") -> DataFrame:
    """Pairs in each group between a member outside its largest component and those of other components, unless they meet
    at one of the shingles ahead, too."""
    outside = rows.where("c <> most")
    met = split_join(_ends(rows, "b", key, "c", "before"), _ends(outside, "a", key, "c", "before", "few"), key, ["b"], counts=groups.select(key, "count"))
    return met.where(f"ca <> cb AND ({where}) AND NOT arrays_overlap(beforea, beforeb)").drop("beforea", "beforeb", "fewa")


def _candidates(turn: int, met: DataFrame, shared: DataFrame, nodes: DataFrame, labels: DataFrame | None, num: int, den: int) -> DataFrame | None:
    """Pairs to look at in a turn, from the prefix rows whose shingle several sets have; None if none can be left."""
    if turn == 0:
        return _possible(split_join(_ends(met, "b", "h"), _ends(met.where("node = hub"), "a", "h"), "h", ["b"], counts=shared.select("h", "count")), num, den)
    marked = store.keep(_label(met.select("h", "node", "n", "pos"), labels, "node", "c"), "jaccard-marked")
    rows, groups = _apart(marked, "h", "jaccard-groups")
    if groups.isEmpty():
        return None
    if turn == 1:
        rows = store.keep(rows, "jaccard-open")
        hub = rows.groupBy("h").agg(F.min_by("node", F.xxhash64("node")).alias("hub"))
        hubs = rows.join(hub, "h").where("node = hub")
        return _possible(split_join(_ends(rows, "b", "h", "c"), _ends(hubs, "a", "h", "c"), "h", ["b"], counts=groups.select("h", "count")).where("ca <> cb"), num, den)
    ahead = F.expr(f"slice(prefix, greatest(pos - {BEFORE}, 0) + 1, least(pos, {BEFORE}))")
    rows = rows.join(nodes.select("node", "prefix"), "node").withColumn("before", ahead).withColumn("few", F.expr(f"count - in_most <= {FEW}"))
    rows = store.keep(rows.drop("prefix"), "jaccard-open")
    if 2 * num <= den:  # two sets may then link by a single shingle
        return _possible(_of_different(rows, groups, "h"), num, den)
    short = SHORT * den // (den - num)
    # whatever links with a set of more than `short` shingles has at least num / den of them
    direct = _of_different(rows.where(f"few OR {den} * n >= {num} * {short}"), groups, "h", f"fewa OR greatest(na, nb) > {short}")
    direct = _possible(direct, num, den)
    again = rows.where(f"NOT few AND n <= {short}").select("h", "node", "n", "c", "before", F.col("pos").alias("pos1"))
    second = again.join(nodes.select("node", F.posexplode("prefix").alias("pos", "h2")), "node").where("pos > pos1")
    second = store.keep(second.select(F.xxhash64("h", "h2").alias("hh"), "node", "n", "pos", "c", "before", F.lit(False).alias("few")), "jaccard-second")
    if second.isEmpty():
        return direct
    rows, groups = _apart(second, "hh", "jaccard-groups")
    return direct.union(_possible(_of_different(rows, groups, "hh"), num, den, 2)).distinct()


def _linked(df: DataFrame, size: int, threshold: tuple[int, int], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(members, links), stored: members (doc_id, n, node, component, low) of each row of df, `low` being the smallest id
    of its component; links (a, b) of nodes, with their smallest ids."""
    spark: SparkSession = df.sparkSession
    num, den = threshold
    store.bound_batches(spark)
    with store.scratch():
        texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        counts = spark.sparkContext.broadcast(slot_counts(texts, size))
        stage = store.keep(_summaries(texts, size, num, den, counts), "jaccard-stage")
        known = stage.where("node IS NOT NULL AND doc_id IS NOT NULL")
        nodes = store.keep(known.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("prefix").alias("prefix")), "jaccard-nodes")
        # Smaller sets link with equal ones only, and those are one node.
        rows = nodes.where(f"{num} * (2 * n + 1) <= {num + den} * n").select("node", "n", "low", F.posexplode("prefix").alias("pos", "h")).where(f"pos <= n - ({num} * n + {den - 1}) div {den}")
        # The set of the smallest id goes first: copies are like what they were made from more than like each other.
        shared = store.keep(rows.groupBy("h").agg(F.min(F.struct("low", "node")).alias("first"), F.count(F.lit(1)).alias("count")).where("count > 1").select("h", "first.node", "count").withColumnRenamed("node", "hub"), "jaccard-shared")
        met = store.keep(split_join(rows.drop("low"), shared.select("h", "hub"), "h", ["node"], counts=shared.select("h", "count")), "jaccard-met")
        slim = nodes.select("node", "n", "bins")
        edges = labels = sets = tried = None
        for turn in range(3):
            pairs = _candidates(turn, met, shared, nodes, labels, num, den)
            if pairs is None:
                break
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            likely = store.keep(_suffix_filter(store.keep(pairs, "jaccard-possible"), slim, num, den), "jaccard-pairs")
            if likely.isEmpty():
                continue
            tried = likely if tried is None else tried.unionByName(likely)
            ids = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
            if sets is not None:
                ids = ids.join(sets.select("node"), "node", "left_anti")
            ids = store.keep(ids.join(nodes.select("node", "low"), "node"), "jaccard-ids")
            if not ids.isEmpty():
                more = store.keep(_needed_sets(texts.where("doc_id IS NOT NULL"), ids, size), "jaccard-sets")
                sets = more if sets is None else sets.unionByName(more)
            found = store.keep(_verify(likely, sets, num, den), "jaccard-links")
            if not found.isEmpty():
                edges = found if edges is None else edges.unionByName(found)
                labels = components(edges, "jaccard-labels")
        named = _label(nodes.select("node", "low"), labels, "node", "component")
        least = named.groupBy("component").agg(F.min("low").alias("low"))
        named = named.select("node", "component").join(least, "component")
        members = store.keep(split_join(stage.select("doc_id", "n", "node"), named, "node", ["doc_id"], "left"), "jaccard-members", outer=True)
        if edges is not None:
            lows = nodes.select("node", "low")
            edges = store.keep(_with_ends(edges, lows, {"low": "low_"}), "jaccard-edges", outer=True)
    return members, edges


def link(df: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(members, links). Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set is the distinct `size`-word shingles.

    members: one row (doc_id, n_shingles, component_id) for each row of df; component_id is the smallest id that links
    lead to, the row's own included. links: verified pairs (a, b) of sets' smallest ids; they connect each component,
    not every linked pair of which is listed once its ends are connected. None if no pair links.

    Two sets link if den * |both| >= num * |either|, threshold = (num, den). A text with fewer words than `size` has its
    whole sequence as one shingle; one without words, empty or null has an empty set and links with nothing. Ids are
    whole numbers. Rows are documents of their own, also those that repeat an id: an id by itself links nothing, so rows
    with one id and different texts may lie in different components. A row with a null id keeps a null component. An
    empty table gives empty results. Other columns are not read.
    """
    members, edges = _linked(df, size, threshold, id_col, text_col)
    members = members.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))
    return members, None if edges is None else edges.select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))


def keep_one(df: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of df for each component: of the rows with its smallest id one, of several different ones that with the
    smallest set number. Rows with a null id stay, and rows without words, one for each id."""
    members = _linked(df, size, threshold, id_col, text_col)[0].where("doc_id IS NOT NULL").withColumn("low", F.coalesce("low", "doc_id"))
    gone = members.where("doc_id <> low").select(F.col("doc_id").alias("gone_")).distinct()
    again = members.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again_"))
    lost = F.col(id_col) == F.col("gone_")
    if again.isEmpty():
        return df.join(gone, lost, "left_anti")
    same = F.col(id_col) == F.col("again_")
    plain = df.join(again, same, "left_anti").join(gone, lost, "left_anti")
    # rows that share an id are told apart by their sets
    columns, where = [*df.columns, "node_"], df.columns.index(text_col)
    schema = df.schema.simpleString()[7:-1] + ", node_ bigint"

    def run(batches):
        for batch in batches:
            found = [_node(x) if len(x) else None for _, x in _sets(batch.column(where), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=columns)

    kept = members.where("doc_id = low").groupBy(F.coalesce("component", "doc_id"), F.col("node").isNull()).agg(F.min("node").alias("kept_"), F.min("doc_id").alias("id_"))
    told = df.join(again, same, "left_semi").mapInArrow(run, schema).join(kept, (F.col(id_col) == F.col("id_")) & F.col("node_").eqNullSafe(F.col("kept_")), "left_semi")
    return plain.unionByName(told.dropDuplicates([id_col, "node_"]).select(*df.columns))
