"""Vectorised words and rolling hashes over Arrow blocks of whole texts.

A block is the UTF-8 bytes of some consecutive rows, end to end. All functions work on
bytes with numpy, so a text costs a few passes over its bytes and no Python object for
each word. Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D; those bytes
never occur inside a multi-byte character, so byte and character views agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _randoms(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers; Philox gives the same ones on every machine."""
    return np.random.Generator(np.random.Philox(seed)).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_BYTE = _randoms(256, 11)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASES = {0: 0x9E6C63D0876A3F35, 1: 0xD1342543DE82EF95}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n or more."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        base = _BASES[which]
        up, down = (np.full(n, x, np.uint64) for x in (base, pow(base, -1, 2**64)))
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 4 * BLOCK_BYTES:  # those of a giant text aren't kept
            _powers[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Rows first..first+n of a batch: data holds their bytes, at[i]:at[i+1] those of row i."""

    first: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column (null: empty) into blocks of about size bytes; a longer text is a block of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield Block(i, bytes_[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Words:
    """start, end: byte spans of a block's words; at[i]:at[i+1] are the words of row i."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def words(block: Block) -> Words:
    inside = _IS_WORD[block.data]
    if not len(inside):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block) + 1, np.int64))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = block.at[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, block.at))


def word_hashes(block: Block, w: Words, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with fold, of its A-Z lower-cased bytes."""
    up, down = powers(len(block.data) + 1)
    total = np.zeros(len(block.data) + 1, np.uint64)
    np.cumsum((_BYTE_FOLDED if fold else _BYTE)[block.data] * up[: len(block.data)], out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start] + (w.end - w.start).astype(np.uint64))


def ngrams(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each n consecutive values of h, in order; those that cross rows are for the caller to leave out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1, which)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1] + np.uint64(n))


def inside_rows(at: np.ndarray, n: int) -> np.ndarray:
    """Which of the n-grams of all rows' values lie within a row."""
    total = int(at[-1])
    keep = np.zeros(max(0, total - n + 1), bool)
    counts = np.diff(at)
    for s, c in zip(at[:-1][counts >= n], counts[counts >= n]):
        keep[s : s + c - n + 1] = True
    return keep
