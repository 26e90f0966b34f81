"""LM scoring by a probabilistic suffix tree over word tokens.

A token is a word `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, or the one end that closes each text. The symbols are
the training tokens and one more for every word that isn't among them. The context of a token is the up to DEPTH tokens
before it in its text. The tree holds a context if the training texts have it at least MIN_COUNT times, however many
tokens they are, and a divergence test tells its next-symbol distribution from that of the context without its first
token; what a held context ends in is held too. A context's counts are smoothed towards the shorter one's distribution
with the weight of its number of distinct next symbols; the root's leaves unknown words the share of tokens met once.
Each token is scored by the longest suffix of what precedes it that the tree holds.

Everything is learned from counts of all training tokens. Texts are cut into segments. A segment sends its distinct
words, counted, to the buckets that their hashes fall in, and gets their counts over all segments and short numbers for
them back. Then, for contexts of 1, 2, ... tokens, it sends the runs of a frequent context and its next word to buckets
of contexts. There the next words' counts meet, the divergence is tested, and the runs that are frequent contexts of the
next length get their numbers. Last, segments tell buckets which contexts others end in. A context with more than a set
share of all tokens is dealt to several buckets by its next words; the parts of its divergence are added up on the
driver, of which there are at most 2 * SPLIT_MOST. Nothing that grows with the texts is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from . import store

DEPTH, MIN_COUNT = 3, 20
#: Least bits by which a context must tell more than its suffix, each time it occurs; least G statistic per next symbol.
GAIN_BITS, G_LEAST = 0.02, 2.0
SEGMENT_BYTES = 1 << 22
#: The token that ends a text; no word has this hash but by a chance of 2**-64.
END = np.uint64(0xE4D)
#: Buckets in which the runs of so many segments meet.
BUCKETS, BUCKET_SEGMENTS = 64, 512
#: A context is split if it occurs more often than the greater of SPLIT_LEAST and all tokens / SPLIT_MOST.
SPLIT_LEAST, SPLIT_MOST = 100_000, 5000
#: Divergence is added up in whole units of 1 / UNIT nats, so that sums don't depend on their order.
UNIT = 1 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, each byte by byte over all of its numbers, compressed together."""
    head, body = [len(arrays)], []
    for x in arrays:
        wide = np.ascontiguousarray(x, dtype="<i8")
        size = 0 if not len(x) else 8 if wide.min() < 0 else (int(wide.max()).bit_length() + 7) // 8
        head += [len(x), size]
        body.append(wide.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    many = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 1 + 2 * many)[1:].reshape(-1, 2).tolist()
    at, out = 8 * (1 + 2 * many), []
    for n, size in head:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out.append(wide.view("<i8").ravel())
        at += n * size
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (not negative), a place of each, and each key's number among them: np.unique, by sorting numbers
    that hold key and place together where 63 bits are enough."""
    n = len(keys)
    bits = max(n - 1, 1).bit_length()
    if not n or int(keys.max()) >> (63 - bits):
        return np.unique(keys, return_index=True, return_inverse=True)
    both = (keys.astype(np.int64) << bits) | np.arange(n)
    both.sort()
    place = both & ((1 << bits) - 1)
    both >>= bits
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(both[1:], both[:-1], out=new[1:])
    number = np.empty(n, np.int64)
    number[place] = np.cumsum(new) - 1
    return both[new], place[new], number


def refine(p: np.ndarray, seen: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Probabilities after a context of `total` occurrences and `kinds` distinct next symbols, smoothed towards p."""
    return (seen + kinds * p) / (total + kinds)


def root(c: np.ndarray, n_tokens: int, n_once: int) -> np.ndarray:
    """Probabilities of tokens met c times; those never met share what tokens met once have."""
    unknown = max(n_once, 1) / max(n_tokens + (n_once == 0), 1)
    return np.where(c > 0, (1 - unknown) * c / max(n_tokens, 1), unknown)


def passes(units: np.ndarray, kinds: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The divergence test."""
    nats = units / UNIT
    return (2 * nats >= G_LEAST * kinds) & (nats / np.log(2) >= GAIN_BITS * total) & (total > 0)


def _hash(x: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    return bt.mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(more).astype(np.uint64))


_STAGE = "segment bigint, doc_ids array<bigint>, held_out array<boolean>, sizes array<int>, places binary, words binary"
_SENT = "bucket int, segment bigint, sent binary"
_MET = "segment bigint, bucket int, back binary"


def pack_counts(number: np.ndarray, count: np.ndarray, buckets: int, bucket: int, *more: np.ndarray) -> bytes:
    """A bucket's numbers (0: none) and counts: counts don't grow with the number, so in its order their steps are nearly all 0."""
    some = np.flatnonzero(number)
    sorted_counts = count[some[np.argsort(number[some])]]
    rank = np.where(number > 0, (number - 1 - bucket) // buckets + 1, 0)
    return pack(rank, sorted_counts[:1], -np.diff(sorted_counts), count[number == 0], *more)


def unpack_counts(data: bytes, buckets: int, bucket: int) -> list[np.ndarray]:
    """Counts, numbers and what was packed with them."""
    rank, first, steps, rest, *more = unpack(data)
    some, count = np.flatnonzero(rank), np.empty(len(rank), np.int64)
    count[some[np.argsort(rank[some])]] = np.concatenate((first, first - np.cumsum(steps)))
    count[rank == 0] = rest
    return [count, np.where(rank > 0, 1 + (rank - 1) * buckets + bucket, 0), *more]


def _no_segment(bucket: int) -> int:
    """The segment under which a bucket gives what concerns no segment."""
    return -1 - bucket


def _by_frequency(many: np.ndarray) -> np.ndarray:
    return np.argsort(-many, kind="stable")


def _stage(segment_bytes: int):
    """Segments: their texts' tokens as places among their distinct ones, the most frequent first, as small numbers pack well;
    the distinct ones are sorted, and `places` has also how often each occurs, from which their order follows."""

    def run(batches):
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, bounds = bt.buffers(batch.column(1))
            for low, high in bt.groups(bounds, segment_bytes):
                _, _, hashes, rows = bt.words(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], bt.SPACED)
                words, place = np.unique(np.insert(hashes, rows[1:], END), return_inverse=True)
                many = np.bincount(place)
                rank = np.empty(len(many), np.int64)
                rank[_by_frequency(many)] = np.arange(len(many))
                ids, held = (batch.column(k).slice(low, high - low).to_pylist() for k in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([(np.diff(rows) + 1).tolist()], pa.list_(pa.int32())), pa.array([pack(rank[place], many)], pa.binary()), pa.array([pack(np.diff(words.view(np.int64), prepend=0))], pa.binary())],
                    names=["segment", "doc_ids", "held_out", "sizes", "places", "words"],
                )
                segment += 1

    return run


def _given(back: list[dict] | None, columns: int, buckets: int = 0) -> list[np.ndarray]:
    """What the buckets gave a segment, in the order in which it was sent; with their number, counts are unpacked."""
    back = sorted(back or [], key=lambda x: x["bucket"])
    pieces = [unpack_counts(x["back"], buckets, x["bucket"]) if buckets else unpack(x["back"]) for x in back]
    return [np.concatenate(x) for x in zip(*pieces)] if pieces else [np.zeros(0, np.int64)] * columns


def _sent(segment: int, buckets: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([segment] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "segment", "sent"])


@dataclass
class Level:
    """A segment's contexts of one length and their next words: `at` says which run ends at each token of `place`.

    Runs are sorted by bucket, context and next word. What the buckets tell: how often each run occurs, its number as a
    context, the number of next words of its context, and whether that is held by the test."""

    place: np.ndarray
    at: np.ndarray
    context: np.ndarray
    word: np.ndarray
    total: np.ndarray
    parent_total: np.ndarray
    parent_seen: np.ndarray
    n: np.ndarray
    bucket: np.ndarray
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    number: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    held: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def cuts(self) -> np.ndarray:
        """Where a bucket's part of a context begins, and the end."""
        new = np.flatnonzero((np.diff(self.context) != 0) | (np.diff(self.bucket) != 0)) + 1
        return np.concatenate(([0], new, [len(self.context)])) if len(self.context) else np.zeros(1, np.int64)

    def send(self, segment: int) -> pa.RecordBatch:
        cuts = self.cuts()
        buckets, firsts = np.unique(self.bucket[cuts[:-1]], return_index=True)
        blobs = []
        # what the shorter context expects of the runs' occurrences, added up by context: a term is a whole number, so sums
        # don't depend on how texts are cut
        terms = self.n * np.rint(-np.log(np.maximum(self.parent_seen, 1) / self.parent_total) * UNIT).astype(np.int64)
        expected = np.add.reduceat(terms, cuts[:-1]) if len(terms) else terms
        for a, b in zip(firsts, [*firsts[1:], len(cuts) - 1]):
            own, some = cuts[a:b], slice(cuts[a], cuts[b])
            steps = np.diff(self.word[some], prepend=0)
            steps[own - cuts[a]] = self.word[own]
            blobs.append(pack(np.diff(self.context[own], prepend=0), np.diff(cuts[a : b + 1]), self.total[own], expected[a:b], steps, self.n[some]))
        return _sent(segment, buckets, blobs)

    def take(self, back: list[dict] | None, split: dict[str, np.ndarray] | None, buckets: int) -> None:
        self.seen, self.number, told = _given(back, 3, buckets)
        told = np.repeat(told, np.diff(self.cuts()))
        if split is not None and len(split["context"]):
            k = np.minimum(np.searchsorted(split["context"], self.context), len(split["context"]) - 1)
            told = np.where(split["context"][k] == self.context, split["told"][k], told)
        self.kinds, self.held = told >> 1, (told & 1).astype(bool)


def _meet_level(table: pa.Table, buckets: int, limit: int, last: bool) -> pa.Table:
    """A bucket's runs over all segments; see Level. Contexts above the limit go to the driver with their part of the divergence."""
    bucket = table.column("bucket")[0].as_py()
    parts = [unpack(x) for x in table.column("sent").to_pylist()]
    lens, many = [x[1] for x in parts], [len(x[4]) for x in parts]
    context = np.concatenate([np.repeat(np.cumsum(x[0]), x[1]) for x in parts])
    total = np.concatenate([np.repeat(x[2], x[1]) for x in parts])
    own_context, own_expected = np.concatenate([np.cumsum(x[0]) for x in parts]), np.concatenate([x[3] for x in parts])
    word = []
    for x in parts:
        run, first = np.cumsum(x[4]), np.cumsum(x[1]) - x[1]
        word.append(run - np.repeat(run[first] - x[4][first], x[1]))
    word = np.concatenate(word)
    n = np.concatenate([x[5] for x in parts])
    del parts
    wide = int(word.max(initial=0)).bit_length()
    if int(context.max(initial=0)) >> (63 - wide):
        raise ValueError("more contexts and words than one number tells apart")
    keys = (context << wide) | word
    found = np.unique(keys)
    group = np.searchsorted(found, keys)
    seen = np.bincount(group, n, minlength=len(found)).astype(np.int64)
    one = np.empty(len(found), np.int64)
    one[group] = np.arange(len(keys))
    context = found >> wide
    begins = np.flatnonzero(np.append(True, np.diff(context) != 0))
    whole = total[one]
    nats = np.add.reduceat(seen * np.log(np.where(seen > 0, seen / whole, 1.0)), begins)
    kinds, whole = np.add.reduceat((seen > 0).astype(np.int64), begins), whole[begins]
    expected = _sums(np.searchsorted(context[begins], own_context), own_expected, len(begins))
    units = np.rint(nats * UNIT).astype(np.int64) + expected
    split = whole > limit
    told = 2 * kinds + (passes(units, kinds, whole) & ~split)
    number = np.zeros(len(seen), np.int64)
    if not last:
        some = np.flatnonzero(seen >= MIN_COUNT)
        number[some[np.argsort(-seen[some], kind="stable")]] = 1 + np.arange(len(some)) * buckets + bucket
    told_of_run = np.repeat(told, np.diff(np.append(begins, len(context))))
    back, at = [], 0
    for x, size in zip(lens, many):
        own = group[at : at + size]
        back.append(pack_counts(number[own], seen[own], buckets, bucket, told_of_run[own[np.cumsum(x) - x]]))
        at += size
    back.append(pack(context[begins][split], kinds[split], units[split], whole[split]))
    segments = table.column("segment").to_pylist() + [_no_segment(bucket)]
    return pa.table({"segment": pa.array(segments, pa.int64()), "bucket": pa.array([bucket] * len(back), pa.int32()), "back": pa.array(back, pa.binary())})


def _meet_words(table: pa.Table, buckets: int) -> pa.Table:
    """Counts and numbers of a bucket's words; 0 numbers all that no training text has."""
    bucket = table.column("bucket")[0].as_py()
    parts = [unpack(x) for x in table.column("sent").to_pylist()]
    words = np.concatenate([np.cumsum(x[0]) for x in parts]).view(np.uint64)
    _, group = np.unique(words, return_inverse=True)
    count = np.bincount(group, np.concatenate([x[1] for x in parts])).astype(np.int64)
    number = np.zeros(len(count), np.int64)
    some = np.flatnonzero(count)
    number[some[np.argsort(-count[some], kind="stable")]] = 1 + np.arange(len(some)) * buckets + bucket
    cuts = np.cumsum([0, *(len(x[0]) for x in parts)])
    back = [pack_counts(number[group[a:b]], count[group[a:b]], buckets, bucket) for a, b in zip(cuts[:-1], cuts[1:])]
    back.append(pack(np.array([count.sum(), (count > 0).sum(), (count == 1).sum()])))
    segments = table.column("segment").to_pylist() + [_no_segment(bucket)]
    return pa.table({"segment": pa.array(segments, pa.int64()), "bucket": pa.array([bucket] * len(back), pa.int32()), "back": pa.array(back, pa.binary())})


def _meet_raised(table: pa.Table) -> pa.Table:
    """Of each context, whether any segment says that a held one ends in it."""
    parts = [unpack(x) for x in table.column("sent").to_pylist()]
    lens = [[len(x[k]) for k in range(0, len(x), 2)] for x in parts]
    flags = []
    for k in range(0, len(parts[0]), 2):
        _, group = np.unique(np.concatenate([np.cumsum(x[k]) for x in parts]), return_inverse=True)
        raised = np.bincount(group, np.concatenate([x[k + 1] for x in parts]), minlength=1) > 0
        cuts = np.cumsum([0, *(x[k // 2] for x in lens)])
        flags.append([raised[group[a:b]].astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:])])
    back = [pack(*x) for x in zip(*flags)]
    return pa.table({"segment": table.column("segment"), "bucket": table.column("bucket"), "back": pa.array(back, pa.binary())})


@dataclass
class Setting:
    """What every segment knows; `split` has, by length, what was found of contexts that several buckets share."""

    buckets: int
    depth: int
    n_tokens: int = 0
    n_distinct: int = 0
    n_once: int = 0
    limit: int = 0
    split: list[dict[str, np.ndarray]] = field(default_factory=list)


class Segment:
    """A segment's tokens, and its runs of the first `known` lengths and one more, DEPTH at most; of the known ones with what buckets told."""

    def __init__(self, row: dict, known: int, setting: Setting):
        self.number, self.doc_ids, self.held = row["segment"], row["doc_ids"], np.array(row["held_out"], bool)
        self.rows = np.concatenate(([0], np.cumsum(np.array(row["sizes"], np.int64))))
        rank, many = unpack(row["places"])
        self.place = _by_frequency(many)[rank]
        self.trained = np.repeat(~self.held, np.diff(self.rows))
        self.setting, self.levels = setting, []
        if known == 0:
            self.words = np.cumsum(unpack(row["words"])[0]).view(np.uint64)
            return
        counts, numbers = _given(row["n0"], 2, setting.buckets)
        count, number = counts[self.place], numbers[self.place]
        self.count = count
        self.local = np.unique(numbers, return_inverse=True)[1][self.place]
        first = np.zeros(len(self.place), bool)
        first[self.rows[:-1]] = True
        some = np.flatnonzero(~first)
        some = some[count[some - 1] >= MIN_COUNT]
        order, facts = self.local[some - 1], lambda i: (number[i - 1], count[i - 1], np.full(len(i), setting.n_tokens), count[i])
        for d in range(1, setting.depth + 1):
            level = self._level(some, order, number, facts)
            self.levels.append(level)
            if d >= known:
                break
            level.take(row[f"n{d}"], setting.split[d - 1], setting.buckets)
            # a run is a context of the token behind it; the last of `run` stands for none
            run = np.full(len(first), len(level.n))
            run[level.place] = level.at
            number_of, seen_of, total_of = (np.append(x, 0) for x in (level.number, level.seen, level.total))
            order_of = np.zeros(len(number_of), np.int64)
            named = np.flatnonzero(number_of)
            order_of[named[np.argsort(number_of[named])]] = np.arange(len(named))
            some = np.flatnonzero(~first)
            some = some[number_of[run[some - 1]] > 0]
            order = order_of[run[some - 1]]
            facts = partial(self._facts, run, number_of, seen_of, total_of)

    @staticmethod
    def _facts(run, number, seen, total, i) -> tuple[np.ndarray, ...]:
        before, own = run[i - 1], run[i]
        return number[before], seen[before], total[own], seen[own]

    def _level(self, some, order, number, facts) -> Level:
        """`order` numbers the contexts as they are sorted; `facts` tells, of the tokens that end runs, the context, its
        total, and the shorter context's total and count."""
        setting = self.setting
        _, one, at = distinct(order * (int(self.local.max(initial=0)) + 1) + self.local[some])
        n = np.bincount(at, self.trained[some], minlength=len(one)).astype(np.int64)
        ends = some[one]
        word, (context, total, parent_total, parent_seen) = number[ends], facts(ends)
        part, large = np.zeros(len(word), np.uint64), np.flatnonzero(total > setting.limit)
        part[large] = _hash(word[large]) % (-(-total[large] // setting.limit)).astype(np.uint64)
        bucket = (_hash(context, part) % np.uint64(setting.buckets)).astype(np.int32)
        order = np.argsort(bucket.astype(np.uint16) if setting.buckets <= 1 << 16 else bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return Level(some, back[at], *(x[order] for x in (context, word, total, parent_total, parent_seen, n, bucket)))

    def send_words(self) -> pa.RecordBatch:
        buckets = self.setting.buckets
        n = np.bincount(self.place, self.trained, minlength=len(self.words)).astype(np.int64)
        cuts = np.append(np.searchsorted(self.words, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)), len(self.words))
        some = np.flatnonzero(np.diff(cuts))
        return _sent(self.number, some, [pack(np.diff(self.words[cuts[b] : cuts[b + 1]].view(np.int64), prepend=0), n[cuts[b] : cuts[b + 1]]) for b in some])

    def unsure(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length but the last: contexts that the test doesn't hold, in order of bucket, their buckets, and whether a held one ends in them here."""
        above, out = np.zeros(len(self.place), bool), []
        for d in range(len(self.levels) - 1, 0, -1):
            longer, level = self.levels[d], self.levels[d - 1]
            above[longer.place] |= longer.held[longer.at]
            names, _, group = distinct(level.context)
            raised, known = np.zeros(len(names), bool), np.zeros(len(names), bool)
            raised[group[level.at[above[level.place]]]] = True
            known[group[level.held]] = True
            some = np.flatnonzero(~known)
            bucket = (_hash(names[some], d) % np.uint64(self.setting.buckets)).astype(np.int32)
            some, bucket = some[np.argsort(bucket, kind="stable")], np.sort(bucket)
            out.append((names[some], bucket, raised[some]))
        return out[::-1]

    def send_unsure(self) -> pa.RecordBatch:
        unsure = self.unsure()
        buckets = np.unique(np.concatenate([b for _, b, _ in unsure])) if unsure else np.zeros(0, np.int32)
        blobs = []
        for k in buckets:
            parts = []
            for names, bucket, raised in unsure:
                a, b = np.searchsorted(bucket, [k, k + 1])
                parts += [np.diff(names[a:b], prepend=0), raised[a:b].astype(np.int64)]
            blobs.append(pack(*parts))
        return _sent(self.number, buckets, blobs)

    def log10(self, back: list[dict] | None) -> np.ndarray:
        """log10 of each token's probability."""
        setting = self.setting
        flags = _given(back, max(len(self.levels) - 1, 0))
        p = root(self.count, setting.n_tokens, setting.n_once)
        unsure = self.unsure()
        for d, level in enumerate(self.levels):
            held = level.held
            if d < len(unsure):
                names = np.sort(unsure[d][0][flags[d] > 0])
                if len(names):
                    held = held | (names[np.minimum(np.searchsorted(names, level.context), len(names) - 1)] == level.context)
            some = held[level.at]
            at, place = level.at[some], level.place[some]
            p[place] = refine(p[place], level.seen[at], level.total[at], level.kinds[at])
        return np.log10(p)


def _each(batches, known: int, setting: Setting, f) -> Iterator[pa.RecordBatch]:
    """f(segment, row) of each row; one segment is in memory at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield f(Segment(row, known, setting), row)


def _exchange(frame: DataFrame, name: str, parts: int, send: Callable, meet: Callable, outer: int = 0) -> tuple[DataFrame, list[list[np.ndarray]]]:
    """(segment, name), stored by segment, with what the buckets give each segment back, and what they give for no segment."""
    with store.scratch():
        # stored before it goes back, so that what was sent is gone by then
        met = store.keep(frame.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(meet, _MET), f"lm-met-{name}", "none")
        back = store.keep_by(met.groupBy("segment").agg(F.collect_list(F.struct("bucket", "back")).alias(name)), f"lm-{name}", "segment", parts, "none", outer + 1)
    told = [unpack(bytes(x["back"])) for r in back.where(F.col("segment") < 0).select(name).collect() for x in r[name]]
    return back.where(F.col("segment") >= 0), told


def _whole(told: list[list[np.ndarray]]) -> dict[str, np.ndarray]:
    """Contexts whose parts several buckets told, sorted, and the sum of it as a bucket tells it of the others."""
    context, kinds, units, total = (np.concatenate(x) for x in zip(*told)) if told else [np.zeros(0, np.int64)] * 4
    names, one, group = np.unique(context, return_index=True, return_inverse=True)
    kinds, units = (np.array([int(x) for x in _sums(group, v, len(names))], np.int64) for v in (kinds, units))
    return {"context": names, "told": 2 * kinds + passes(units, kinds, total[one])}


def _sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, group, values)
    return out


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of df.

    The model learns from the rows of which held_out isn't true; every row is scored. base_score: sum over tokens of
    log10((c + 1) / (N + V + 1)), c being the token's count, N that of all and V that of distinct training tokens. score:
    the tree's log10 probability of the text's tokens, its end included.

    Null and empty text: the end alone. Without training rows the counts are 0 and every token is an unknown one.
    Repeated rows and ids each count and give a row; ids are whole numbers, null ids stay null; other columns are not
    read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    store.bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least, most = SPLIT_LEAST, SPLIT_MOST
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def each(known: int, f: Callable, setting: Setting) -> Callable:
        return lambda batches: _each(batches, known, setting, f)

    with store.scratch():
        with store.scratch():
            # stored before anything is sent, so that a task done again sends what it sent at first; a segment is one file at
            # most, so tables lie by segment without having moved
            stage = store.keep_by(texts.mapInArrow(_stage(SEGMENT_BYTES), _STAGE), "lm-stage", "segment", parts, "none")
            buckets = BUCKETS * max(1, -(-stage.count() // BUCKET_SEGMENTS))
            setting = Setting(buckets, depth)
            back, told = _exchange(stage, "n0", parts, each(0, lambda segment, _: segment.send_words(), setting), lambda table: _meet_words(table, buckets), outer=1)
            # segments from here on know their words by number, and lie as what they are given back does
            rows = store.keep_by(stage.drop("words"), "lm-frame", "segment", parts, "none", outer=True).join(back, "segment")
        n, v, once = (sum(int(x[0][k]) for x in told) for k in range(3))
        limit = max(least, -(-n // most))

        def meet_level(last: bool) -> Callable:
            return lambda table: _meet_level(table, buckets, limit, last)

        setting = Setting(buckets, depth, n, v, once, limit)
        for d in range(1, depth + 1):
            back, told = _exchange(rows, f"n{d}", parts, each(d, lambda segment, _: segment.levels[-1].send(segment.number), setting), meet_level(d == depth))
            rows = rows.join(back, "segment", "left")
            setting = Setting(buckets, depth, n, v, once, limit, [*setting.split, _whole(told)])
        back, _ = _exchange(rows, "raised", parts, each(depth + 1, lambda segment, _: segment.send_unsure(), setting), _meet_raised)
        rows = rows.join(back, "segment", "left")

        def finish(segment, row):
            value, rows, c = segment.log10(row["raised"]), segment.rows, segment.count
            return pa.RecordBatch.from_arrays(
                [pa.array(segment.doc_ids, pa.int64()), pa.array(segment.held), pa.array(np.diff(rows)), pa.array(bt.sums((c > 0).astype(np.int64), rows)), pa.array(np.full(len(segment.held), n, np.int64)), pa.array(bt.sums(np.log10((c + 1) / (n + v + 1)), rows)), pa.array(bt.sums(value, rows))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        scored = rows.mapInArrow(each(depth + 1, finish, setting), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
        return store.keep(scored, "lm-scores", outer=True)
