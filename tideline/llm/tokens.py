"""Words of whole texts as 64-bit numbers, taken straight from Arrow's buffers.

Nothing is made per word in Python: a slice of texts is one array of bytes, words are runs between white
space, and a word's number is a polynomial over its bytes from differences of a running sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tideline.llm.common import U64, mix

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
#: A number for each byte, A-Z as a-z.
NUMBER = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWERED]
#: Bytes that are looked at together; beyond, a text is cut at white space.
WINDOW = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``; only tables up to a few windows are kept."""
    size = max(WINDOW, n)
    if size not in _powers:
        made = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size, b, U64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=U64))
        if size > 4 * WINDOW:
            return made[0], made[1]
        _powers.clear()
        _powers[size] = (made[0], made[1])
    return _powers[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """All words of a column: where they are, their numbers, and how many each row has."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = buffers(column)
        raw, n = self.raw, len(self.raw)
        word = ~BLANK[raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = ~word[:-1]
        before |= edge[:-1]
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = ~word[1:]
        after |= edge[1:]
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))
        self.keys = self._numbers()

    def _numbers(self) -> np.ndarray:
        out = np.empty(len(self.starts), U64)
        i = 0
        while i < len(out):
            a = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, a + WINDOW, "right")))
            b = self.ends[j - 1]
            up, down = powers(int(b - a))
            sums = np.zeros(b - a + 1, U64)
            np.cumsum(NUMBER[self.raw[a:b]] * up[: b - a], out=sums[1:], dtype=U64)
            s = self.starts[i:j] - a
            out[i:j] = (sums[self.ends[i:j] - a] - sums[s]) * down[s]
            i = j
        return mix(out + (self.ends - self.starts).astype(U64))
