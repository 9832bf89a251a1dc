"""Sets of word shingles as sorted 64-bit hashes, their order by rarity, and the keys by which similar sets meet.

For a Jaccard threshold num/den two sets of sizes a <= b must share ceil(num (a + b) / (num + den))
elements.  From that follow both kinds of keys:

* light (small) sets emit, for every partner size, all their subsets of just the size that must be shared;
* heavy (large) sets put their rarest elements, as many as a partner cannot all lack, into inverted lists.

Rarity is counted in a fixed number of buckets.  Any order that all sets follow gives the same links, so
what shares a bucket or fills it only makes lists longer or shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash

from tideline.llm.common import U64, mix
from tideline.llm.tokens import Words

#: Buckets in which elements are counted, and the parts in which counts travel.
BUCKETS = 1 << 21
PARTS = 32
#: An element's bits below its level of rarity.
ELEMENT_BITS = 52
#: Steps of rarity to a doubling of a count.
STEPS = 32
#: Sizes that may be light.
MOST_LIGHT = 40
#: Costs against one row of a list: a subset's key is such a row, a partner has its text fetched and compared.
KEY_COST, PARTNER_COST = 1.0, 40.0


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, U64)
    for i in range(width):
        out = (out ^ (out >> U64(29))) * U64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(out)


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of its ``width``-word shingles, sorted; shorter texts have one, of all their words."""
    words = Words(column)
    runs = combine(words.keys, width)
    at = 0
    for n in words.counts.tolist():
        if n >= width:
            s = np.sort(runs[at : at + n - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield combine(words.keys[at : at + n], max(n, 1))
        at += n


def signature(s: np.ndarray) -> int:
    """126 bits that stand for a whole set; they fit a decimal of 38 digits."""
    return xxhash.xxh3_128_intdigest(s.tobytes()) >> 2


def decimals(values: list[int | None]) -> pa.Array:
    """Signatures as an Arrow column of decimal(38, 0)."""
    raw = b"".join((v or 0).to_bytes(16, "little") for v in values)
    live = np.array([v is not None for v in values], bool)
    mask = pa.py_buffer(np.packbits(live, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(values), [mask, pa.py_buffer(raw)])


def short(node: int) -> int:
    """The low 64 bits of a signature, signed: what candidates are looked for by."""
    x = node & ((1 << 64) - 1)
    return x - (1 << 64) * (x >> 63)


class Bound:
    """Sizes and overlaps for one threshold."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def need(self, a: int, b: int) -> int:
        """Elements that sets of these sizes must share."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, n: int) -> range:
        """Sizes that a set of size n can link with."""
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def prefix(self, n: int) -> int:
        """The rarest elements of which every partner has one at least."""
        return n - -(-self.num * n // self.den) + 1

    def shared(self, n: int) -> int:
        """How many of their ``kept`` elements a set of size n and a partner of that size or more share at least."""
        return 1 + self.prefix(n) // 4

    def kept(self, n: int) -> int:
        """Elements that go into lists: for each one more than the prefix, one more is shared."""
        return min(n, self.prefix(n) + self.shared(n) - 1)

    def subset_keys(self, n: int) -> int:
        return sum(comb(n, self.need(n, m)) for m in self.partners(n) if min(n, m) >= self.need(n, m) and (m != n or self.need(n, n) < n))

    def boundary(self, sizes: dict[int, tuple[float, float]]) -> int:
        """The largest light size, by cost.

        ``sizes`` has, for each small size, the sets of that size and the measured length of the lists that
        their rarest elements are in.  A light set costs its keys; a heavy one costs its rows of lists and the
        partners that it is compared with.  All sizes up to the boundary are cheaper light than heavy.
        """
        best, at, light, heavy = 0.0, 0, 0.0, 0.0
        for n in range(1, MOST_LIGHT + 1):
            count, length = sizes.get(n, (0.0, 1.0))
            light += count * KEY_COST * self.subset_keys(n)
            heavy += count * self.prefix(n) * (1 + PARTNER_COST * max(0.0, length - 1))
            if light - heavy <= best:
                best, at = light - heavy, n
        return at


def ranked(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the order of rarity: each element under its bucket's level."""
    low = s & U64((1 << ELEMENT_BITS) - 1)
    return levels[(low & U64(BUCKETS - 1)).astype(np.int64)].astype(U64) << U64(ELEMENT_BITS) | low


def rarest(s: np.ndarray, levels: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rarest elements of a set, rarest first."""
    x = ranked(s, levels)
    if k < len(x):
        x = np.partition(x, k - 1)[:k]
    return np.sort(x)


def subset_keys(s: np.ndarray, bound: Bound) -> tuple[np.ndarray, list[bool]]:
    """Keys of a light set and, for each, whether the set has the smaller of the two sizes it stands for."""
    n = len(s)
    elements = mix(s)
    total = elements.sum(dtype=U64)
    keys, lesser = [np.zeros(0, U64)], []
    for m in bound.partners(n):
        need = bound.need(n, m)
        if need > min(n, m) or (m == n and need == n):
            continue
        if n > need:
            out = np.array([*combinations(range(n), n - need)], np.int64)
            sums = total - elements[out].sum(axis=1, dtype=U64)
        else:
            sums = np.full(1, total, U64)
        sizes = np.array([min(n, m) << 20 | max(n, m)], U64)
        keys.append(mix(sums + mix(sizes)))
        lesser += [n <= m] * len(sums)
    return np.concatenate(keys), lesser
