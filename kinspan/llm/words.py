"""Words of a batch of texts as NumPy arrays, without a Python loop over them.

An Arrow string column already holds its texts as one UTF-8 buffer. Words are
runs of bytes that are no separators (Unicode white space, and marks if asked); each gets a 64-bit hash from prefix sums
of ``table[byte] * BASE**position`` (modulo 2**64), so any word, prefix or suffix
of a word costs two look-ups and a multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that are taken at once; a longer text is taken alone.
CHUNK_BYTES = 2 << 20
SHINGLE_WORDS = 5

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation.
SPACES_AND_MARKS = SPACES.copy()
SPACES_AND_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least; those of a chunk are kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    found = []
    for base in (BASE, INVERSE):
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        found.append(np.cumprod(steps))
    if n <= CHUNK_BYTES + 1:
        _powers[:] = found
    return found[0], found[1]


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some texts: ``first[i]`` to ``first[i + 1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        return mix((self.sums[ends] - self.sums[starts]) * powers(len(self.sums))[1][starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def wide_blanks(data: np.ndarray) -> np.ndarray:
    """Places of the bytes of Unicode white space that takes two or three of them."""
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    one, two = (data[np.minimum(lead + k, max(len(data) - 1, 0))] for k in (1, 2))
    lead_byte = data[lead]
    short = (lead_byte == 0xC2) & ((one == 0x85) | (one == 0xA0))
    long = (lead_byte == 0xE2) & ((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)) | (one == 0x81) & (two == 0x9F))
    long |= (lead_byte == 0xE1) & (one == 0x9A) & (two == 0x80) | (lead_byte == 0xE3) & (one == 0x80) & (two == 0x80)
    found = [lead[short | long], lead[short | long] + 1, lead[long] + 2]
    return np.concatenate(found)


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, fold: np.ndarray = AS_IS) -> Words:
    """Words between separators; white space beyond ASCII separates too."""
    n = len(data)
    inside = ~separators[data]
    inside[wide_blanks(data)] = False
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    stops[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[fold[data]] * powers(n + 1)[0][:n], out=sums[1:])
    return Words(data, starts, ends, np.searchsorted(starts, offsets), sums)


def chunks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` (CHUNK_BYTES) bytes: first, last + 1, bytes, offsets."""
    data, offsets = as_bytes(column)
    size = CHUNK_BYTES if size is None else size
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0] - 1, 0 .. counts[1] - 1, ..."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def shingles(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, and how many each text has.

    A text of 1 to ``size`` - 1 words has one shingle, of all of them.
    """
    hashes, n = words.hashes(), words.counts()
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    inner = ranges(counts)
    left = np.repeat(n, counts) - inner
    at = np.repeat(words.first[:-1], counts) + inner
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        has = left > j
        part = hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] * powers(size + 2)[0][j + 1]
        total += part if has.all() else np.where(has, part, np.uint64(0))
    return mix(total), counts
