"""Spelling variants: words one edit apart, found by comparing tiles of code-point matrices.

Two words are near if their common prefix and suffix together reach the longer one's length less one. Words meet in
groups: a word of length m has, for each window of WINDOW places, the group of all that it holds outside that window; a
word of length m - 1 joins the groups of m with a window that is one place shorter. A pair that is near meets in the
group of the window in which its common prefix ends, and only there it counts. A group's words differ inside the window
only, so with the 90 letters of the word rule it has 90 * 90 + 90 members at most, however many words there are.

In a group, members lie in padded matrices of code points. Groups of about one size form one stack of matrices, large
ones are cut into blocks, and a tile compares every row of one block with every row of another at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .bytetext import FOLD_BYTES
from .skew import split_join

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run is damaged if this divides the checksum of its document and itself.
DAMAGE = 97
#: Places of a word that a group leaves open.
WINDOW = 2
#: Rows of a block; comparisons of code points that are held at once.
TILE, TILE_CELLS = 256, 1 << 22
#: Words that a task counts before it passes them on; code points of a text that are cut into runs at once.
COUNTED, PIECE = 1 << 18, 1 << 20

_LETTERS = "A-Za-zÀ-ÿ"
_RUN, _REST = re.compile(f"[{_LETTERS}]+"), re.compile(f"[{_LETTERS}]*")
_FOLD = FOLD_BYTES.tobytes()


def runs(text: str) -> Counter[str]:
    """The maximal runs of letters, A-Z lower-cased, and how often the text has each."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        end = _REST.match(text, min(at + PIECE, len(text))).end()
        found.update(_RUN.findall(text[at:end].encode().translate(_FOLD).decode()))
        at = end
    return found


def damaged(found: Counter[str], doc_id: int | None) -> Iterator[tuple[str, int]]:
    """Each run and its count; those that the checksum picks lose a code point."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGE == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        yield run, n


def _count(batches):
    total: Counter[str] = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if text:
                for word, n in damaged(runs(text), doc_id):
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
            if len(total) >= COUNTED:
                yield out()
                total = Counter()
    yield out()


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts, as damaged, of LEAST_LENGTH code points and `least` occurrences at least."""
    store.bound_batches(df.sparkSession)
    texts = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return texts.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, a row each, padded with 0; their lengths."""
    wide = np.array(words)
    points = wide.view(np.uint32).reshape(len(words), -1)
    return points, (points > 0).sum(axis=1)


def _to_right(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same rows, each ending at the last column."""
    width = points.shape[1]
    at = np.arange(width) - (width - lengths)[:, None]
    return np.where(at >= 0, np.take_along_axis(points, np.maximum(at, 0), axis=1), 0)


def _common(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many columns from the first on agree, for each row of x with each row of y in every matrix of a stack."""
    run = np.cumprod(x[:, :, None, :] == y[:, None, :, :], axis=-1, dtype=np.uint8).sum(axis=-1, dtype=np.int64)
    return np.minimum(run, least)


class Tiles:
    """The rows of several groups, and the near pairs in each."""

    def __init__(self, words: list[str], longest: np.ndarray, window: np.ndarray):
        self.points, self.lengths = _matrix(words)
        self.right = np.ascontiguousarray(_to_right(self.points, self.lengths)[:, ::-1])
        self.longest, self.window = longest, window

    def compare(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near pairs between the blocks x and y of row numbers, (groups, rows), -1 for none; the pairs of x with x come once."""
        step = max(1, TILE_CELLS // max(1, x.shape[1] * y.shape[1] * self.points.shape[1]))
        for low in range(0, len(x), step):
            a, b = x[low : low + step], y[low : low + step]
            la, lb = self.lengths[a][:, :, None], self.lengths[b][:, None, :]
            least, most = np.minimum(la, lb), np.maximum(la, lb)
            front = _common(self.points[a], self.points[b], least)
            back = _common(self.right[a], self.right[b], least)
            here = (self.longest[a][:, :, None] == most) & (self.longest[b][:, None, :] == most)
            here &= (self.window[a][:, :, None] == front // WINDOW) & (self.window[b][:, None, :] == front // WINDOW)
            good = (front + back >= most - 1) & (front < most) & here & (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
            if x is y:
                good &= np.triu(np.ones(good.shape[1:], bool), 1)
            g, i, j = np.nonzero(good)
            yield a[g, i], b[g, j]

    def pairs(self, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near pairs in the groups that lie between the bounds."""
        sizes = np.diff(bounds)
        class_of = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for k in np.unique(class_of[(sizes > 1) & (sizes <= TILE)]):
            some = np.flatnonzero((class_of == k) & (sizes <= TILE))
            at = np.arange(1 << k)
            block = np.where(at < sizes[some, None], bounds[some, None] + at, -1)
            yield from self.compare(block, block)
        for g in np.flatnonzero(sizes > TILE):
            rows = np.arange(bounds[g], bounds[g] + -(-sizes[g] // TILE) * TILE)
            blocks = np.where(rows < bounds[g + 1], rows, -1).reshape(-1, 1, TILE)
            for i, block in enumerate(blocks):
                for other in blocks[i:]:
                    yield from self.compare(block, block if other is blocks[i] or np.shares_memory(other, block) else other)


def _near(batches):
    """Near pairs, in both directions, of rows (group, longest, window, word, n) that come by group."""
    held: pa.Table | None = None

    def work(table: pa.Table):
        group = table.column("group").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        alone = np.diff(cuts) == 1
        many = np.repeat(~alone, np.diff(cuts))
        if not many.any():
            return
        table = table.filter(pa.array(many))
        bounds = np.concatenate(([0], np.cumsum(np.diff(cuts)[~alone])))
        words = table.column("word").to_pylist()
        n = table.column("n").to_numpy()
        tiles = Tiles(words, table.column("longest").to_numpy().astype(np.int64), table.column("window").to_numpy().astype(np.int64))
        spelled = pa.array(words, pa.string())
        for a, b in tiles.pairs(bounds):
            if len(a):
                x, y = np.concatenate([a, b]), np.concatenate([b, a])
                yield pa.RecordBatch.from_arrays([spelled.take(pa.array(x)), pa.array(n[x]), spelled.take(pa.array(y)), pa.array(n[y])], names=["word", "n", "other", "other_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        group = held.column("group").to_numpy()
        whole = int(np.searchsorted(group, group[-1]))
        if whole:
            yield from work(held.slice(0, whole))
            held = held.slice(whole).combine_chunks()
    if held is not None:
        yield from work(held)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for every two near words of (word, n), in both directions."""
    length, longest, window = F.char_length("word"), F.col("longest"), F.col("window")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longest"))
    rows = rows.select("word", "n", "longest", F.explode(F.sequence(F.lit(0), F.floor((longest - 1) / WINDOW).cast("int"))).alias("window"))
    behind = WINDOW * window + WINDOW + 1 - (longest - length)
    group = F.xxhash64("longest", "window", F.substring("word", F.lit(1), WINDOW * window), F.substring("word", behind, length))
    rows = rows.select(group.alias("group"), F.col("longest").cast("int"), F.col("window").cast("int"), "word", "n")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_near, "word string, n bigint, other string, other_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where the way over forms ends. Each round doubles the steps that a word has gone."""
    steps = store.keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nexts = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = split_join(steps, nexts, "root", ["word"], "left")
        new = store.keep(new.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        steps = new.select("word", "root")
        if not new.where("moved").take(1):
            return steps


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each word of all texts, see vocabulary().

    form: the near word of largest n, the smallest in code-point order of several, if it has twice the word's n at
    least; else null. form_n: its n. root: where the way from the word over forms ends, the word itself if it has none.
    n doubles with every form, so no way returns.

    A null or empty text has no words; a text is read in pieces that end between runs, so its length doesn't matter. A
    null id counts as an empty one in the checksum; ids are whole numbers. Rows that repeat count each time. An empty
    table gives an empty result. Other columns are not read. Words of any letters compare alike; n and ties are exact.
    """
    with store.scratch():
        words = store.keep(vocabulary(df, id_col, text_col), "spelling-words")
        alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("bigint").alias("other_n"))
        best = F.struct((-F.col("other_n")).alias("less"), "other")
        told = near_pairs(words).unionByName(alone).groupBy("word", "n").agg(F.count("other").alias("n_near"), F.min(F.when(F.col("other").isNotNull(), best)).alias("best"))
        good = -F.col("best.less") >= 2 * F.col("n")
        told = store.keep(told.select("word", "n", "n_near", F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "spelling-forms")
        out = told.join(roots(told.where("form IS NOT NULL")), "word", "left")
        return store.keep(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling-variants", outer=True)
