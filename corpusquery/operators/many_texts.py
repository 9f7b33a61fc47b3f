"""Finding very many texts in contents by the hashes of their windows.

A text of up to ``WINDOW`` characters is looked for whole, by one hash per
position and length.  A longer one is met through its window with the least
hash, and then by the hash of the whole text at the place that window points to.
A table takes some bytes per text, whatever its length, and the cost of a
content does not depend on the number of texts.  Hashes only tell places: what
stands there is handed on as text, and compared by the join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Longest texts that are looked for whole.
WINDOW = 16

# Bytes that a text takes in a table, at most, besides the flags.
TEXT_BYTES = 32

# Characters of contents that are hashed together.
PIECE = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SALT = 0xA0761D6478BD642F

# Stands after each content; no character has this number.
_END = np.array([0x110000], "<u4")


class _Hashes:
    """Hashes of the windows of texts that are laid one after the other."""

    def __init__(self, texts: list[str]):
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        flat = np.concatenate([part for c in codes for part in (c, _END)]).astype(np.uint64)
        powers = np.cumprod(np.full(len(flat), _BASE, np.uint64))
        self.back = np.cumprod(np.full(len(flat), _INVERSE, np.uint64))
        # Sums of the powers; what wraps around is the same on both sides of a difference.
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat + np.uint64(1)) * _MIX * powers)])

    def every(self, size: int) -> np.ndarray:
        """The hash at each position of the window of one size."""
        n = len(self.back) - size + 1
        return self._mixed((self.sums[size:] - self.sums[:n]) * self.back[:n], np.uint64(size * _SALT & 0xFFFFFFFFFFFFFFFF))

    def at(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The hashes of single windows."""
        salt = size.astype(np.uint64) * np.uint64(_SALT)
        return self._mixed((self.sums[begin + size] - self.sums[begin]) * self.back[begin], salt)

    @staticmethod
    def _mixed(value: np.ndarray, salt) -> np.ndarray:
        return (value ^ salt) * _MIX

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, "right") - 1


class _Keys:
    """A set of hashes, with a table of flags that most others fail."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.__setstate__(self.keys)

    def __getstate__(self) -> np.ndarray:
        return self.keys

    def __setstate__(self, keys: np.ndarray) -> None:
        self.keys = keys
        # Few keys get a sparser table that still lies in the cache.
        n = len(keys).bit_length()
        bits = max(10, min(20, n + 6)) if n < 16 else min(26, n + 4)
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, bool)
        self.flags[(keys >> self.shift).view(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the set, and the place of their keys."""
        may = np.flatnonzero(self.flags[(hashes >> self.shift).view(np.int64)])
        key = np.searchsorted(self.keys, hashes[may])
        same = self.keys[np.minimum(key, len(self.keys) - 1)] == hashes[may]
        return may[same], key[same]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and hash of texts, and of the longer ones the least window and where it lies."""
    for batch in batches:
        for _, texts in pieces(batch.column("text").to_pylist()):
            h = _Hashes(texts)
            least, back = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
            long = np.flatnonzero(h.sizes > WINDOW)
            if len(long):
                every = h.every(WINDOW)
                first, windows = h.begins[long], h.sizes[long] - WINDOW + 1
                ends = np.stack([first, first + windows], axis=1).ravel()
                least[long] = np.minimum.reduceat(every, ends)[::2]
                inner = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
                of = np.repeat(long, windows)
                hit = np.flatnonzero(every[inner] == least[of])
                own, at = np.unique(of[hit], return_index=True)
                back[own] = inner[hit[at]] - h.begins[own]
            columns = [h.sizes, h.at(h.begins, h.sizes).view(np.int64), least.view(np.int64), back]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_DESCRIBED)


_DESCRIBED = ["size", "hash", "least", "back"]


class TextTable:
    """What a task has to know of the texts that it looks for."""

    def __init__(self, texts: DataFrame):
        ddl = ", ".join(f"{c} bigint" for c in _DESCRIBED)
        found = texts.select("text").mapInArrow(_described, ddl).toArrow()
        size, hashes, least, back = (found.column(c).to_numpy() for c in _DESCRIBED)
        hashes, least = hashes.view(np.uint64), least.view(np.uint64)
        short = size <= WINDOW
        self.short = {int(k): _Keys(hashes[size == k]) for k in np.unique(size[short])}
        self.long = None
        if not short.all():
            # Texts that share their least window at one place and their size are one entry.
            entries = np.unique(np.rec.fromarrays([least[~short], back[~short], size[~short]], names="least,back,size"))
            self.window = _Keys(entries["least"])
            first = np.searchsorted(entries["least"], self.window.keys)
            self.first, self.count = first.astype(np.int32), np.diff(np.append(first, len(entries))).astype(np.int32)
            self.entry_back, self.entry_size = entries["back"].astype(np.int32), entries["size"].astype(np.int32)
            self.long = _Keys(hashes[~short])

    def places(self, contents: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Content, begin and size of one place of each text in each content, by hash."""
        h = _Hashes(contents)
        for size, keys in self.short.items():
            if size <= len(h.back):
                at, key = keys.find(h.every(size))
                yield self._once(h, at, np.full(len(at), size), key, len(keys.keys))
        if self.long is None or WINDOW > len(h.back):
            return
        at, key = self.window.find(h.every(WINDOW))
        # A window may belong to texts of several sizes, at several places.
        count = self.count[key].astype(np.int64)
        entry = np.repeat(self.first[key] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        of = np.repeat(h.owner(at), count)
        begin, size = np.repeat(at, count) - self.entry_back[entry], self.entry_size[entry]
        inside = (begin >= h.begins[of]) & (begin + size <= h.begins[of] + h.sizes[of])
        begin, size = begin[inside], size[inside]
        hit, key = self.long.find(h.at(begin, size))
        yield self._once(h, begin[hit], size[hit], key, len(self.long.keys))

    @staticmethod
    def _once(h: _Hashes, begin: np.ndarray, size: np.ndarray, key: np.ndarray, n_keys: int):
        of = h.owner(begin)
        _, one = np.unique(of * n_keys + key, return_index=True)
        return of[one], begin[one] - h.begins[of[one]], size[one]


def pieces(contents: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring contents that are hashed together, with the place of the first."""
    begin, total = 0, 0
    for i, content in enumerate(contents):
        total += len(content)
        if total >= PIECE or i == len(contents) - 1:
            yield begin, contents[begin : i + 1]
            begin, total = i + 1, 0
