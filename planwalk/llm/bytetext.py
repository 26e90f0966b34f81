"""Vectorised work on the UTF-8 bytes of an Arrow string column.

Word rules here only name ASCII separators, so cutting bytes is the same as cutting characters.
Word identity is a 64-bit hash: a random 64-bit number per byte value, weighted by powers of an odd
constant modulo 2**64, summed, then mixed. Two different words agree with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once; arrays of eight bytes for each of them are held.
PIECE = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
#: Number of each byte, with and without lower-casing A-Z.
EXACT_SYMBOLS = _SYMBOL
FOLDED_SYMBOLS = _SYMBOL[_FOLD]
#: The byte map of that lower-casing.
FOLD_BYTES = _FOLD.astype(np.uint8)


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    words = np.ones(256, dtype=bool)
    for low, high in separators:
        words[low : high + 1] = False
    return words


#: Words `[^\x20\x09-\x0D]+`.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the weight and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        made = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = made[0], made[1]
    return _powers


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and the bounds of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if wide == pa.large_binary() else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(bounds[0]), int(bounds[-1])
    held = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return held, bounds - low


def groups(bounds: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of rows of about `limit` bytes each; a longer row stands alone."""
    out, low, n = [], 0, len(bounds) - 1
    while low < n:
        high = int(np.searchsorted(bounds, bounds[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n)
        out.append((low, high))
        low = high
    return out


def _cut(data: np.ndarray, bounds: np.ndarray, low: int, is_word: np.ndarray) -> int:
    """Where a piece from `low` may end without cutting a word: a row's bound, else behind a separator."""
    n, size = len(data), PIECE
    while low + size < n:
        row = int(np.searchsorted(bounds, low + size, side="right")) - 1
        if bounds[row] > low:
            return int(bounds[row])
        gaps = np.flatnonzero(~is_word[data[low : low + size]])
        if len(gaps):
            return low + int(gaps[-1]) + 1
        size *= 2
    return n


def span_hashes(piece: np.ndarray, start: np.ndarray, end: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    weight, inverse = powers(len(piece) + 1)
    total = np.zeros(len(piece) + 1, dtype=np.uint64)
    np.cumsum(symbols[piece] * weight[: len(piece)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, symbols: np.ndarray = FOLDED_SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of all words, and for each row the number of words before it."""
    starts, ends, hashes, low = [], [], [], 0
    while low < len(data):
        high = _cut(data, bounds, low, is_word)
        piece = data[low:high]
        inside = is_word[piece]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        rows = bounds[np.searchsorted(bounds, low, side="right") : np.searchsorted(bounds, high)] - low
        first[rows] = inside[rows]
        last[rows - 1] = inside[rows - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(span_hashes(piece, start, end, symbols))
        starts.append(start + low)
        ends.append(end + low)
        low = high
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, bounds)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words of one row; of its whole sequence if it has fewer; none if it has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        out = (out * np.uint64(_ODD)) ^ hashes[k : n - width + 1 + k]
        out = out ^ (out >> np.uint64(32))
    return mix(out)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i, 0 for empty runs."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
