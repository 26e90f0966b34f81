"""Benchmark decontamination: a distributed positional inverted index over the training documents.

The index is a Parquet table of segments, one for about SEGMENT_BYTES of neighbouring documents: for each term the
sorted positions at which it stands. Documents follow each other in a segment's positions with one free position
between, so no phrase crosses them. A segment is searched where it is read: postings never move between machines, and
no term's list outgrows a segment.

A phrase is looked for from its rarest term in the segment: each of that term's positions, less the term's offset in
the phrase, is a candidate start; the lists of the other terms, in order of rarity, are intersected with it at their
own offsets. A phrase with a term that the segment lacks costs one lookup.

Terms are 64-bit hashes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from . import store

SEGMENT_BYTES = 1 << 22
#: Windows that are held in memory and searched for at once, on average; a larger benchmark takes several blocks.
BLOCK_WINDOWS = 100_000

_SEGMENT = "segment bigint, doc_ids array<bigint>, doc_words array<int>, terms binary, counts binary, steps binary"


def benchmark_windows(df: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words) of each distinct window of each item, stored: `window` consecutive words, as hashes; an item with
    fewer words is one window, one without words none. A null id is the empty string."""

    def run(batches):
        for batch in batches:
            data, bounds = bt.buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for low, high in bt.groups(bounds, SEGMENT_BYTES):
                _, _, hashes, rows = bt.words(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], bt.ALNUM)
                for k in range(high - low):
                    words = hashes[rows[k] : rows[k + 1]].view(np.int64)
                    width = min(window, len(words))
                    if width:
                        many = np.unique(np.lib.stride_tricks.sliding_window_view(words, width), axis=0)
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(many) + 1, dtype=np.int32) * width), pa.array(many.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([names[low + k]] * len(many), pa.string()), flat], names=["item_id", "words"])

    store.bound_batches(df.sparkSession)
    items = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return store.keep(items.mapInArrow(run, "item_id string, words array<bigint>").distinct(), "benchmark-windows")


@dataclass
class Block:
    """Windows of some items: term of each place (-1: none), width, and the window's item."""

    items: list[str]
    terms: np.ndarray
    places: np.ndarray
    widths: np.ndarray
    owners: np.ndarray


def make_block(rows: list[tuple[str, list[int]]], window: int) -> Block:
    """The block of some windows (item, words)."""
    items = sorted({x for x, _ in rows})
    number = {x: k for k, x in enumerate(items)}
    words = np.zeros((len(rows), window), np.int64)
    for k, (_, x) in enumerate(rows):
        words[k, : len(x)] = x
    words = words.view(np.uint64)
    widths = np.array([len(x) for _, x in rows], np.int64)
    inside = np.arange(window) < widths[:, None]
    terms = np.unique(words[inside])
    return Block(items, terms, np.where(inside, np.searchsorted(terms, words), -1), widths, np.array([number[x] for x, _ in rows], np.int64))


def blocks(windows: DataFrame, window: int) -> Iterator[Block]:
    """The stated query set, stored, in blocks of about BLOCK_WINDOWS windows, one after the other; one at least."""
    n = -(-windows.count() // BLOCK_WINDOWS) or 1
    for k in range(n):
        part = windows if n == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k)
        yield make_block([(r["item_id"], r["words"]) for r in part.toLocalIterator()], window)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored segments of df's whole texts, with the postings of all their terms.

    A null or empty text has no words but is in its segment. Rows are documents of their own, repeated or not.
    """
    store.bound_batches(df.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, bounds = bt.buffers(batch.column(1))
            for low, high in bt.groups(bounds, SEGMENT_BYTES):
                _, _, hashes, rows = bt.words(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], bt.ALNUM)
                lens = np.diff(rows)
                at = np.arange(len(hashes)) + np.repeat(np.arange(high - low), lens)
                order = np.argsort(hashes, kind="stable")
                new = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0)) if len(order) else order
                found, counts = hashes[order[new]], np.diff(np.append(new, len(order)))
                at = at[order]
                steps = np.diff(at, prepend=0)
                steps[new] = at[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int64()), pa.array([batch.column(0).slice(low, high - low).to_pylist()], pa.list_(pa.int64())), pa.array([lens.tolist()], pa.list_(pa.int32())), *(pa.array([x.tobytes()], pa.binary()) for x in (found.astype("<u8"), counts.astype("<u4"), steps.astype("<u4")))],
                    names=["segment", "doc_ids", "doc_words", "terms", "counts", "steps"],
                )
                segment += 1

    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return store.keep(texts.mapInArrow(run, _SEGMENT), "positional-index")


@dataclass
class Segment:
    """One row of the index, opened: bounds[k]:bounds[k+1] are the sorted positions of terms[k]."""

    doc_ids: list
    doc_words: np.ndarray
    terms: np.ndarray
    bounds: np.ndarray
    positions: np.ndarray

    @classmethod
    def open(cls, row: dict) -> Segment:
        counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        run = np.cumsum(np.frombuffer(row["steps"], "<u4").astype(np.int64))
        first = bounds[:-1]
        positions = run - np.repeat(np.where(first > 0, run[np.maximum(first, 1) - 1], 0), counts)
        return cls(row["doc_ids"], np.array(row["doc_words"], np.int64), np.frombuffer(row["terms"], "<u8"), bounds, positions)

    def codes(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in this segment, -1 for those that it lacks."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def doc_starts(self) -> np.ndarray:
        """First position of each document, and the position behind the last one's."""
        return np.concatenate(([0], np.cumsum(self.doc_words + 1)))


def occurrences(seg: Segment, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of every occurrence of the block's windows in the segment."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(block.places) or not len(seg.terms):
        return none
    code = np.append(seg.codes(block.terms), -2)[block.places]
    live = np.flatnonzero((code != -1).all(axis=1))
    if not len(live):
        return none
    code, wide = code[live], block.places[live] >= 0
    sizes = np.where(wide, np.append(np.diff(seg.bounds), 0)[np.maximum(code, 0)], np.iinfo(np.int64).max)
    order = np.argsort(sizes, axis=1, kind="stable")
    anchor = order[:, 0]
    rows = np.arange(len(live))
    first, n = seg.bounds[code[rows, anchor]], sizes[rows, anchor]
    owner = np.repeat(rows, n)
    start = seg.positions[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] - anchor[owner]
    keep = start >= 0
    owner, start = owner[keep], start[keep]
    span = int(seg.doc_starts()[-1]) + 1
    lists = np.repeat(np.arange(len(seg.terms)), np.diff(seg.bounds)) * span + seg.positions
    for k in range(1, block.places.shape[1]):
        if not len(owner):
            break
        place = order[owner, k]
        want = code[owner, place]
        key = want * span + start + place
        at = np.minimum(np.searchsorted(lists, key), len(lists) - 1)
        good = ~wide[owner, place] | ((start + place < span) & (lists[at] == key))
        owner, start = owner[good], start[good]
    return live[owner], start


def _merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


_FOUND = "segment bigint, row int, doc_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def search(index: DataFrame, query: Iterable[Block]) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: merged spans of word positions (last exclusive) that lie in an
    occurrence of a window, and the sorted distinct ids of the items it belongs to.

    Blocks are searched in turn; what one finds is stored before the next is fetched, so the driver holds one block."""
    spark = index.sparkSession

    def find(block):
        held = spark.sparkContext.broadcast(block)

        def run(batches):
            block = held.value
            for batch in batches:
                for row in batch.to_pylist():
                    seg = Segment.open(row)
                    window, start = occurrences(seg, block)
                    firsts = seg.doc_starts()
                    doc = np.searchsorted(firsts, start, side="right") - 1
                    order = np.argsort(doc, kind="stable")
                    window, start, doc = window[order], start[order], doc[order]
                    spans: list[list] = [[] for _ in seg.doc_ids]
                    items: list[list[str]] = [[] for _ in seg.doc_ids]
                    some, at = np.unique(doc, return_index=True)
                    for k, a, b in zip(some.tolist(), at.tolist(), [*at.tolist()[1:], len(doc)]):
                        s = start[a:b] - firsts[k]
                        spans[k] = [{"first": x, "last": y} for x, y in _merge(s, s + block.widths[window[a:b]])]
                        items[k] = sorted({block.items[x] for x in block.owners[window[a:b]].tolist()})
                    n = len(seg.doc_ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(seg.doc_ids, pa.int64()), pa.array(seg.doc_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                        names=["segment", "row", "doc_id", "n_words", "spans", "items"],
                    )

        return index.mapInArrow(run, _FOUND)

    query = iter(query)
    block, more = next(query), next(query, None)
    if more is None:
        return find(block).select("doc_id", "n_words", "spans", "items")
    every = store.keep(find(block), "benchmark-found")
    while more is not None:
        found = find(more).where("size(spans) > 0")  # each document is in the first block's rows
        every, more = every.unionByName(store.keep(found, "benchmark-found")), next(query, None)
    joined = every.groupBy("segment", "row", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        "all",
        F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["last"] >= x["first"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.try_element_at(out, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(out, F.lit(-1))["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(out, F.array(x))),
    )
    return joined.select("doc_id", "n_words", merged.alias("spans"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) of every row of docs, for the windows of `window` words of the benchmark's items.

    A null or empty text has no words and no hits; an item without words has no window; items that repeat an id count
    once; a null item id counts as the empty string. Without documents or items the result has no rows or no hits.
    Document ids are whole numbers; item ids may be of any kind. Columns besides the ids and texts are not read.
    """
    with store.scratch():
        windows = benchmark_windows(benchmark, window, item_col, item_text)
        found = search(build_index(docs, id_col, text_col), blocks(windows, window))
        return store.keep(found, "benchmark-hits", outer=True)


def proximity(index: DataFrame, phrases: dict[str, str], within: int) -> DataFrame:
    """(doc_id, phrase_id, first, last): documents where all words of a phrase stand, in any order, inside `within`
    consecutive words; the first such shortest span from each place of the phrase's rarest word, last exclusive.

    The phrases are a stated query set; a phrase without words matches nothing."""
    names = list(phrases)
    data, bounds = bt.buffers(pa.array([phrases[x] for x in names], pa.string()))
    _, _, hashes, rows = bt.words(data, bounds, bt.ALNUM)
    wanted = [(x, np.unique(hashes[a:b])) for x, a, b in zip(names, rows[:-1], rows[1:]) if b > a]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment.open(row)
                firsts = seg.doc_starts()
                out: list[dict] = []
                for name, terms in wanted:
                    code = seg.codes(terms)
                    if (code < 0).any():
                        continue
                    lists = sorted((seg.positions[seg.bounds[k] : seg.bounds[k + 1]] for k in code), key=len)
                    seen = set()
                    for p in lists[0].tolist():
                        near = [x[np.searchsorted(x, p - within + 1) : np.searchsorted(x, p + within)] for x in lists[1:]]
                        if not all(len(x) for x in near):
                            continue
                        d = int(np.searchsorted(firsts, p, side="right")) - 1
                        span = _shortest([np.array([p]), *near], int(firsts[d]), int(firsts[d + 1]) - 1, within)
                        if span and (d, *span) not in seen:
                            seen.add((d, *span))
                            out.append({"doc_id": seg.doc_ids[d], "phrase_id": name, "first": span[0] - int(firsts[d]), "last": span[1] - int(firsts[d])})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("phrase_id", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    return index.mapInArrow(run, "doc_id bigint, phrase_id string, first bigint, last bigint")


def _shortest(lists: list[np.ndarray], low: int, high: int, within: int) -> tuple[int, int] | None:
    """The shortest span in [low, high) of at most `within` places with one of each list; the first if several are."""
    places = sorted((int(x), k) for k, each in enumerate(lists) for x in each if low <= x < high)
    count, have, a, best = [0] * len(lists), 0, 0, None
    for x, k in places:
        count[k] += 1
        have += count[k] == 1
        while have == len(lists):
            y, j = places[a]
            if x + 1 - y <= within and (best is None or x + 1 - y < best[1] - best[0]):
                best = y, x + 1
            count[j] -= 1
            have -= count[j] == 0
            a += 1
    return best


def report(found: DataFrame) -> DataFrame:
    """The contract's digest of `hits`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of whose words at most the share `most` is hit, with docs' columns; rows with a null id stay."""
    found = hits(docs, benchmark, window, id_col, text_col)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"])
    gone = found.where((n_hit > 0) & (n_hit > most * F.col("n_words")) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("gone_"), "left_anti")
