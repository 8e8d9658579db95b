"""Word boundaries and word hashes of whole Arrow text columns, without a Python loop over words.

All work is on the UTF-8 bytes.  A word is a run of bytes of one class, so classes that hold every byte from
0x80 up treat any non-ASCII character as part of a word.  Hashes are 64-bit, equal on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # text handled at once; a longer text is handled whole, alone

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# Everything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
# Digits, letters and every byte from 0x80.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("A") : ord("Z") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[0x80:] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * _STEP)


_BYTE_VALUES = randoms(256, 1)
_BYTE_VALUES_LOWER = _BYTE_VALUES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, _BASE if which == "up" else _BASE_INVERSE, dtype=np.uint64)
        have[0] = 1
        _powers[which] = have = np.cumprod(have)
    return have[:n]


@dataclass
class Words:
    """Words of consecutive texts: text ``d`` has the words ``first[d]`` to ``first[d + 1] - 1``."""

    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self, k: int) -> np.ndarray:
        """For each word, whether the ``k`` words from it on lie in its text."""
        owner_end = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self.hashes)) + k <= owner_end

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; meaningful where ``room(k)``."""
        n = max(len(self.hashes) - k + 1, 0)
        out = np.zeros(len(self.hashes), dtype=np.uint64)
        folded = np.full(n, k, dtype=np.uint64) * _STEP
        for i in range(k):
            folded = folded * _FOLD + self.hashes[i : i + n]
        out[:n] = mix(folded)
        return out


def slices(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into the bytes) of runs of rows; NULL counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(raw: np.ndarray, offsets: np.ndarray, members: np.ndarray, lower: bool = True) -> Words:
    """Words of one slice; ``members`` is a table of 256 flags, ``lower`` folds A-Z."""
    inside = members[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edges] |= inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] |= inside[last]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    values = (_BYTE_VALUES_LOWER if lower else _BYTE_VALUES)[raw]
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values * _power("up", len(raw)), out=prefix[1:])
    hashes = (prefix[stops] - prefix[starts]) * _power("down", len(raw) + 1)[starts]
    hashes = mix(hashes + (stops - starts).astype(np.uint64) * _STEP)
    return Words(np.searchsorted(starts, offsets), hashes)
