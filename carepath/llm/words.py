"""Words, shingles and their hashes for a whole column of texts at once.

A batch of texts is one byte array; words, lines and hashes are numpy operations on it, so the
cost is a few nanoseconds a byte and no Python object is made for a word. Every function takes
texts in blocks of about ``BLOCK_BYTES`` so that the memory of a task does not follow the size
of an Arrow batch; one text is never cut, so a longer text makes a longer block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
U64 = np.uint64
ODD = 0x9E3779B97F4A7C15

#: a word is a run of bytes other than these
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = values.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


BASE = 0xD6E8FEB86659FD93
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """BASE**i (or its inverse) for i < n, modulo 2**64."""
    known = _POWERS[kind]
    if len(known) < n:
        steps = np.full(max(n, 2 * len(known)), BASE if kind == "up" else inverse(BASE), U64)
        steps[0] = 1
        known = _POWERS[kind] = np.cumprod(steps, dtype=U64)
        if n > 4 * BLOCK_BYTES:  # one very long text: do not keep its table
            _POWERS[kind] = known[: 2 * BLOCK_BYTES].copy()
    return known[:n]


def byte_values(fold: bool) -> np.ndarray:
    """A 64-bit value for each byte; with ``fold`` ASCII capitals count as small letters."""
    letters = np.arange(256, dtype=U64)
    if fold:
        letters[65:91] += U64(32)
    return mix((letters + U64(1)) * U64(ODD))


VALUES = {fold: byte_values(fold) for fold in (False, True)}


@dataclass
class Texts:
    """Some whole texts as bytes; ``offsets`` has one entry more than there are texts."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def breaks(self) -> np.ndarray:
        found = np.zeros(len(self.data) + 1, bool)
        found[self.offsets] = True
        return found

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each word."""
        solid = ~SPACES[self.data]
        n = len(solid)
        first = solid.copy()
        first[1:] &= ~solid[:-1] | self.breaks[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | self.breaks[1:n]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @property
    def starts(self) -> np.ndarray:
        return self.bounds[0]

    @property
    def ends(self) -> np.ndarray:
        return self.bounds[1]

    @cached_property
    def first_word(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def words_of(self) -> np.ndarray:
        """Number of words of each text."""
        return np.diff(self.first_word)

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.count), self.words_of)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """64-bit hash of the bytes of each span."""
        n = len(self.data)
        sums = np.zeros(n + 1, U64)
        np.cumsum(VALUES[fold][self.data] * powers(n), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * powers(n + 1, "down")[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(ODD))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` words, and the offsets of the texts in it.

        A text of fewer words, but at least one, has one shingle: all its words.
        """
        return shingles(self.word_hashes, self.first_word, size)


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in small letters (ASCII and Latin-1), and which bytes start a capital."""
    capital = (data >= 0x41) & (data <= 0x5A)
    small = data.copy()
    small[capital] += 0x20
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        small[1:][latin] += 0x20
        capital[:-1] |= latin
    return small, capital


@dataclass
class Cores:
    """Words in small letters without the punctuation around them; words of punctuation alone are left out."""

    hashes: np.ndarray
    begin: np.ndarray
    place: np.ndarray  # index among all words
    first: np.ndarray  # offsets of the texts
    capital: np.ndarray  # bytes that start a capital


def cores(texts: Texts) -> Cores:
    data = texts.data
    small, capital = folded(data)
    solid = np.flatnonzero(((small >= 0x61) & (small <= 0x7A)) | ((data >= 0x30) & (data <= 0x39)) | (data >= 0x80))
    low, high = np.searchsorted(solid, texts.starts), np.searchsorted(solid, texts.ends)
    place = np.flatnonzero(high > low)
    begin, end = solid[low[place]], solid[high[place] - 1] + 1
    hashes = Texts(small, texts.offsets).span_hashes(begin, end)
    return Cores(hashes, begin, place, np.searchsorted(place, texts.first_word), capital)


def runs(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of each run of ``size`` hashes inside one text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    at = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]) - first[:-1], counts)
    n = len(hashes)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(hashes * powers(n), out=prefix[1:])
    return mix((prefix[at + size] - prefix[at]) * powers(n + 1, "down")[at] + U64(size)), at


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], made)
    length = np.repeat(np.minimum(counts, size), made)
    total = length.astype(U64) * U64(ODD)
    factor = 1
    for j in range(size):
        inside = j < length
        total += np.where(inside, hashes[np.minimum(at + j, max(len(hashes) - 1, 0))], U64(0)) * U64(factor)
        factor = factor * BASE % (1 << 64)
    return mix(total), offsets


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, last row + 1, texts) of consecutive rows; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    rows = len(column)
    if not rows:
        return
    wide = pa.types.is_large_string(column.type)
    _, where, content = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    begin = 0
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        end = min(end, rows)
        yield begin, end, Texts(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
        begin = end


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """One list per text of a flat array."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
