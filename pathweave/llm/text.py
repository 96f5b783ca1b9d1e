"""Vectorised word work on Arrow text columns: every helper here runs inside one task, on blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once. A longer document forms a block of its own.
BLOCK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE & _MASK, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse; sizes are rounded up so that few arrays are built."""
    size = max(BLOCK_BYTES + 1, 1 << int(n).bit_length()) if n > BLOCK_BYTES else BLOCK_BYTES + 1
    up, down = _powers(size)
    return up[:n], down[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per range [start, end) of 64-bit values, equal for equal contents wherever the range lies."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Block:
    """Consecutive documents: their bytes, and where each begins (n + 1 offsets)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column (null: empty) into blocks of about ``limit`` bytes; documents stay whole."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Block(i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


@dataclass
class Words:
    """The words of a block: byte ranges, hashes, and the first word of each document (n + 1 offsets)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def find_words(block: Block, is_word: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes with ``is_word``; ``fold`` maps bytes before hashing (such as A-Z to a-z)."""
    n = len(block.data)
    inside = is_word[block.data]
    edges = np.zeros(n + 1, np.bool_)
    edges[block.offsets] = True
    before = np.zeros(n, np.bool_)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edges[:n]))
    after = np.zeros(n, np.bool_)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edges[1:])) + 1
    values = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
    hashes = range_hashes(values[block.data], starts, ends)
    return Words(starts, ends, np.searchsorted(starts, block.offsets), hashes)


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words that lies within one document."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(words.first[1:], np.diff(words.first))
    at = np.flatnonzero(np.arange(n) + size <= last)
    return at, range_hashes(words.hashes, at, at + size)


def byte_class(keep) -> np.ndarray:
    """Table over the 256 byte values from a predicate."""
    return np.array([bool(keep(b)) for b in range(256)])


def lower_ascii() -> np.ndarray:
    table = np.arange(256)
    table[65:91] += 32
    return table


#: Words divided by the six white-space characters of ASCII.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of digits, letters and everything beyond ASCII, before A-Z is lower-cased.
LETTERED = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
