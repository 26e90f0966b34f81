"""Byte-level BPE by the tokenizers library, with each distinct piece of text encoded once per worker.

A text is cut only where the tokenizer's own pre-tokenizer always cuts: before a single space or line break
between two characters that are not white space, behind such a line break, and between an ASCII letter and one
of `.,!?;:`. No merge crosses such a place, so the pieces' ids end to end are the text's ids. Pieces are known
by a 64-bit hash; a worker holds the ids of those it has met, at most MOST of them, and starts anew beyond.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from . import bytetext as bt

#: Pieces that a worker remembers (about 30 bytes each); a bound on memory that changes no result.
MOST = 3_000_000

#: Plain pieces that are handed over as one string.
TOGETHER = 200

#: A piece that starts with its only space and holds nothing that could be white space or a special string.
_PLAIN = re.compile(rb" [!-;=-~\x80-\xbf\xc3-\xdf]+")

_solid = np.zeros(256, dtype=bool)
_solid[0x21:0x7F] = True
_tail = np.zeros(256, dtype=bool)
_tail[0x80:0xC0] = True
#: First bytes of two-byte characters none of which is white space.
_lead = np.zeros(256, dtype=bool)
_lead[0xC3:0xE0] = True
_opens = _solid | _lead
_letter = np.zeros(256, dtype=bool)
_letter[65:91] = _letter[97:123] = True
_stop = np.zeros(256, dtype=bool)
_stop[[ord(x) for x in ".,!?;:"]] = True


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorted places where a piece begins, rows' bounds among them."""
    if len(data) < 3:
        return np.unique(bounds[bounds < len(data)])
    ends = _solid[data]
    ends[1:] |= _tail[data[1:]] & _lead[data[:-1]]
    opens = _opens[data]
    at = np.zeros(len(data), dtype=bool)
    free = ends[:-2] & opens[2:]
    at[1:-1] = free & (data[1:-1] == 0x20)
    lines = free & (data[1:-1] == 0x0A)
    at[1:-1] |= lines
    at[2:] |= lines
    at[1:] |= _letter[data[:-1]] & _stop[data[1:]]
    at[bounds[bounds < len(data)]] = True
    return np.flatnonzero(at)


def splittable(path: str) -> bool:
    """Whether the file's tokenizer cuts as this module takes it to: byte-level BPE with its own pattern and no normalizer."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    first = kind.get("pre_tokenizer") or {}
    added = [x["content"] for x in kind.get("added_tokens", [])]
    return (
        kind.get("normalizer") is None
        and first.get("type") == "ByteLevel"
        and first.get("use_regex", True)
        and not first.get("add_prefix_space", True)
        and all(x.startswith("<") and not re.search(r"[\s.,!?;:]", x) for x in added)
        and not any(x.get("lstrip") or x.get("rstrip") for x in kind.get("added_tokens", []))
        and kind.get("truncation") is None
        and kind.get("padding") is None
    )


class PieceEncoder:
    """Ids (or only their number) of texts given as bytes and row bounds."""

    def __init__(self, path: str, with_ids: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        if hasattr(self.coder.model, "_resize_cache"):
            self.coder.model._resize_cache(0)  # pieces are met once here
        self.split = splittable(path)
        self.with_ids = with_ids
        vocab = self.coder.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.starts[[i for s, i in vocab.items() if s.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.lens = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.int32) for x in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes new pieces. Plain ones go end to end, TOGETHER at a time: each starts with the only id that starts with a space."""
        plain = np.array([_PLAIN.fullmatch(x) is not None for x in pieces], dtype=bool)
        some = np.flatnonzero(plain).tolist()
        runs = [some[i : i + TOGETHER] for i in range(0, len(some), TOGETHER)]
        for part in (runs[i : i + 64] for i in range(0, len(runs), 64)):
            ids = self._ids([b"".join([pieces[k] for k in run]).decode() for run in part])
            every = np.concatenate(ids)
            where = np.flatnonzero(self.starts[every])
            rows = np.array([k for run in part for k in run])
            if len(where) == len(rows):
                self._hold(keys[rows], np.diff(np.append(where, len(every))), every)
            else:
                plain[rows] = False
        rest = np.flatnonzero(~plain)
        if len(rest):
            ids = self._ids([pieces[k].decode() for k in rest])
            self._hold(keys[rest], np.array([len(x) for x in ids], np.int64), np.concatenate(ids))

    def _hold(self, keys: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        at = self.used + np.cumsum(lens) - lens
        if self.with_ids:
            if self.used + len(ids) > len(self.pool):
                grown = np.zeros(2 * (self.used + len(ids)), np.int32)
                grown[: self.used] = self.pool[: self.used]
                self.pool = grown
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.lens = np.insert(self.lens, place, lens)
        self.at = np.insert(self.at, place, at)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids of each row; with_ids: all ids end to end too."""
        n = len(bounds) - 1
        if len(data) == 0:
            return np.zeros(n, np.int64), np.zeros(0, np.int32) if self.with_ids else None
        if not self.split:
            raw = data.tobytes()
            done = self.coder.encode_batch_fast([raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], add_special_tokens=False)
            lens = np.array([len(x) for x in done], np.int64)
            return lens, np.concatenate([np.array(x.ids, np.int32) for x in done]) if self.with_ids else None
        if len(self.keys) > MOST:
            self.forget()
        start = cuts(data, bounds)
        end = np.append(start[1:], len(data))
        hashes = bt.span_hashes(data, start, end, bt.EXACT_SYMBOLS)
        keys, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        held = at < len(self.keys)
        known[held] = self.keys[at[held]] == keys[held]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        lens = self.lens[at].astype(np.int64)[back]
        per_row = bt.sums(lens, np.searchsorted(start, bounds))
        if not self.with_ids:
            return per_row, None
        first = self.at[at][back]
        shift = np.repeat(first - (np.cumsum(lens) - lens), lens)
        return per_row, self.pool[shift + np.arange(len(shift))]


    def encode_groups(self, data: np.ndarray, bounds: np.ndarray, limit: int):
        """Yields (first row, row after the last, ids of each row, ids end to end or None) for groups of about `limit` bytes.

        A longer row stands alone and is encoded in slices that end where a piece begins.
        """
        for low, high in bt.groups(bounds, limit):
            a, z = int(bounds[low]), int(bounds[high])
            if z - a <= 2 * limit or not self.split:
                yield low, high, *self.encode(data[a:z], bounds[low : high + 1] - a)
                continue
            total, parts = 0, []
            while a < z:
                size, end = limit, z
                while a + size < z:
                    places = cuts(data[a : a + size], np.array([0, size]))
                    if len(places) > 1:
                        end = a + int(places[-1])
                        break
                    size *= 2
                lens, ids = self.encode(data[a:end], np.array([0, end - a]))
                total += int(lens[0])
                parts.append(ids)
                a = end
            yield low, high, np.array([total]), np.concatenate(parts) if self.with_ids else None


_held: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, with_ids: bool) -> PieceEncoder:
    """This worker's encoder for the file, made once."""
    if (path, with_ids) not in _held:
        _held[path, with_ids] = PieceEncoder(path, with_ids)
    return _held[path, with_ids]
