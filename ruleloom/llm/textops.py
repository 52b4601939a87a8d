"""Vectorised text helpers that run inside Arrow tasks.

Spark partitions and shuffles the rows; these functions turn one slice of a text column into flat
numpy arrays (word starts, ends, document numbers, 64-bit word hashes) without a Python loop per
word. A slice holds at most about ``SLICE_BYTES`` bytes of text, so the memory of a task does not
follow the length of its partition. A single longer text makes a slice of its own.

Nulls count as empty texts. Words of kind ``alnum`` are the maximal runs
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; words of kind ``space`` are the maximal
runs ``[^\\x20\\x09-\\x0D]+``. Both patterns end at ASCII bytes only, so bytes serve as well as
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = {"alnum": np.zeros(256, bool), "space": np.ones(256, bool)}
_IS_WORD["alnum"][48:58] = _IS_WORD["alnum"][97:123] = _IS_WORD["alnum"][128:] = True
_IS_WORD["space"][[32, 9, 10, 11, 12, 13]] = False

# An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INV_BASE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of each."""
    if len(_tables.get("pow", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("pow", _BASE), ("inv", _INV_BASE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs on every machine."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """Independent hashes of the same keys."""
    return mix(x ^ np.uint64((0xD6E8FEB86659FD93 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))


class Slice:
    """Consecutive texts of one batch as a byte array with offsets."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1
        self._cum: np.ndarray | None = None
        self._of: np.ndarray | None = None

    def lowered(self) -> Slice:
        return Slice(self.first, _LOWER[self.data], self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document numbers of all words, in order."""
        w = _IS_WORD[kind][self.data]
        if not len(w):
            return (np.zeros(0, np.int64),) * 3
        before = np.empty_like(w)
        before[0], before[1:] = False, w[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before[edges] = False
        after = np.empty_like(w)
        after[-1], after[:-1] = False, w[1:]
        after[edges[1:] - 1] = False
        starts = np.flatnonzero(w & ~before)
        ends = np.flatnonzero(w & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        if self._cum is None:
            p, _ = _powers(len(self.data) + 1)
            self._cum = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * p[: len(self.data)], out=self._cum[1:])
        _, inv = _powers(len(self.data) + 1)
        return mix((self._cum[ends] - self._cum[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices of at most ``limit`` bytes, or one text where that is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, body = column.buffers()
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of k consecutive word hashes, ignoring document bounds."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += hashes[j : j + n]
    return mix(out)


def inside(docs: np.ndarray, k: int) -> np.ndarray:
    """For each start of k consecutive words, whether they stand in one document."""
    n = len(docs) - k + 1
    return docs[:n] == docs[k - 1 :] if n > 0 else np.zeros(0, bool)


def isin_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def sliding_min_positions(x: np.ndarray, w: int) -> np.ndarray:
    """The position of the rightmost minimum of every window of ``w`` values (of all, if fewer)."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    w = min(w, n)
    value, offset = x[: n - w + 1].copy(), np.zeros(n - w + 1, np.int64)
    for j in range(1, w):
        other = x[j : j + n - w + 1]
        less = other <= value
        value[less] = other[less]
        offset[less] = j
    return np.arange(n - w + 1, dtype=np.int64) + offset
