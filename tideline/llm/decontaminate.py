"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

An item's windows are its runs of ``width`` words (all its words, where it has fewer).  Containment of a
window needs all its shingles, so one of them suffices to find it: the rarest, by the number of items
that hold it.  These necessary shingles are looked up among the shingles of each document; a match gives
a place for the window, which must lie inside the document (positional and length bounds) and is then
compared word by word.

The index of a block of items is bounded by ``block_words``; a larger benchmark is taken in blocks, each
against all documents, and the hits of a document are united.  With one block nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import kinds_of, map_texts, slices
from tideline.llm.scratch import Scratch

WIDTH = 10
SHINGLE = 3
#: Words of items in one block: about 40 MB of index.
BLOCK_WORDS = 400_000
#: Fixed value: ASCII bytes that are not part of words become spaces; letters are lowered.
TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class Index:
    """The windows of a block of items, found by their rarest shingles."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        split = [(i, w) for i, t in items if (w := words_of(t))]
        self.names = sorted({i for i, _ in split})
        number = {x: k for k, x in enumerate(self.names)}
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        ids = [[self.vocabulary[w] for w in ws] for _, ws in split]
        held = Counter(s for ws in ids for q in (1, 2, 3) for s in {tuple(ws[i : i + q]) for i in range(len(ws) - q + 1)})
        windows: dict[tuple[int, ...], set[int]] = {}
        for (name, _), ws in zip(split, ids):
            for i in range(max(1, len(ws) - width + 1)):
                windows.setdefault(tuple(ws[i : i + width]), set()).add(number[name])
        self.base = len(self.vocabulary) + 1
        found: dict[int, list[tuple[int, int, int]]] = {1: [], 2: [], 3: []}
        self.words, self.items = [], []
        for k, (window, names) in enumerate(windows.items()):
            q = min(SHINGLE, len(window))
            at = min(range(len(window) - q + 1), key=lambda i: (held[window[i : i + q]], window[i : i + q]))
            found[q].append((self.key(window[at : at + q]), k, at))
            self.words.append(window)
            self.items.append(sorted(names))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.matrix = np.zeros((len(self.words), width), np.int64)
        for k, w in enumerate(self.words):
            self.matrix[k, : len(w)] = w
        self.postings = {q: tuple(np.array(x, np.int64).reshape(-1, 3)[np.argsort([y[0] for y in x], kind="stable")].T) for q, x in found.items() if x}
        del self.words

    def key(self, shingle: tuple[int, ...]) -> int:
        out = 0
        for w in shingle:
            out = out * self.base + w
        return out

    def occurrences(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows that occur; ``first``, ``end`` bound each word's document."""
        starts, windows = [], []
        for q, (keys, window, offset) in self.postings.items():
            n = len(ids) - q + 1
            if n <= 0:
                continue
            at = np.flatnonzero(np.logical_and.reduce([ids[i : i + n] > 0 for i in range(q)]))
            shingle = np.zeros(len(at), np.int64)
            for i in range(q):
                shingle = shingle * self.base + ids[at + i]
            lo, hi = np.searchsorted(keys, shingle, "left"), np.searchsorted(keys, shingle, "right")
            some = hi > lo
            at, lo, count = at[some], lo[some], (hi - lo)[some]
            if not len(at):
                continue
            row = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(at, count)
            start, k = place - offset[row], window[row]
            fits = (start >= first[place]) & (start + self.lengths[k] <= end[place])
            start, k = start[fits], k[fits]
            same = np.ones(len(start), bool)
            for i in range(self.matrix.shape[1]):
                live = np.flatnonzero(same & (i < self.lengths[k]))
                same[live] = ids[start[live] + i] == self.matrix[k[live], i]
            starts.append(start[same])
            windows.append(k[same])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(windows)


def ranges(hit: np.ndarray) -> list[int]:
    """start, end of each run of True, flat."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edges.tolist()


def verdict(n_words: int, hits: list[int], items: list[str]) -> tuple:
    """The reported columns of a document from its hit runs and items."""
    marked = sum(b - a for a, b in zip(hits[::2], hits[1::2]))
    names = sorted(set(items))
    return n_words, marked, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), marked > 0


TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
NAMES = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def find(index: Index, texts: list[str | None]) -> list[tuple[int, list[int], list[str]]]:
    """For each text: number of words, hit runs, ids of the items with windows in it."""
    split = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    ids = np.fromiter(map(index.vocabulary.get, chain.from_iterable(split), repeat(0)), np.int64, int(counts.sum()))
    ends = np.cumsum(counts)
    starts = ends - counts
    start, window = index.occurrences(ids, np.repeat(starts, counts), np.repeat(ends, counts))
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + index.lengths[window], -1)
    hit = np.cumsum(edge)[:-1] > 0
    where: dict[int, set[int]] = {}
    for d, k in zip(np.searchsorted(ends, start, "right").tolist(), window.tolist()):
        where.setdefault(d, set()).update(index.items[k])
    return [
        (n, ranges(hit[a:b]) if d in where else [], [index.names[i] for i in where.get(d, ())])
        for d, (n, a, b) in enumerate(zip(counts.tolist(), starts.tolist(), ends.tolist()))
    ]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    keep_text: bool = False,
    **more: Column,
) -> DataFrame:
    """Which words of each document lie inside windows of benchmark items.

    One row per input row: doc_id, n_words, n_hit (words inside any occurrence), n_items (items with
    occurring windows), items_sha256 (their ids, sorted as strings, comma-joined) and contaminated; before
    these the columns named in ``more``, and the text with ``keep_text``.  Null
    and empty texts have no words.  Items without words, and an empty benchmark, match nothing.  An item
    whose id is null is known as "null"; items that share an id count as one.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(item_text), F.lit("")).alias("text"),
    )
    # Every word has a byte and a separator, so half the bytes bound the words.
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0.0))).first()[0]
    blocks = int(size // block_words) + 1
    if blocks == 1:
        return _one_block(docs, _rows(items), width, doc_id, text, keep_text, more)

    spread = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    scratch = Scratch(docs.sparkSession, "leaks")
    numbered = scratch.table("rows", docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in more.items())))
    out = None
    for b in range(blocks):
        # one index at a time; all rows come from the first block, further ones give those with hits
        shared = docs.sparkSession.sparkContext.broadcast(Index(_rows(spread.where(F.col("block") == b)), width))
        found = _hits(numbered.select("row", "doc_id", "text"), shared)
        part = scratch.table(f"hits-{b}", found if b == 0 else found.where(F.size("hits") > 0))
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    merged = out.groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, hits, names in zip(*(batch.column(c).to_pylist() for c in ("n_words", "hits", "items"))):
                hit = np.zeros(n, bool)
                for a, b in zip(hits[::2], hits[1::2]):
                    hit[a:b] = True
                rows.append(verdict(n, ranges(hit), names))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES))], ["row", "doc_id", *NAMES])

    united = merged.mapInArrow(unite, f"row bigint, doc_id bigint, {SCHEMA}")
    if more or keep_text:
        united = united.join(numbered.drop("doc_id"), "row")
    return united.select("doc_id", *more, *["text"] * keep_text, *NAMES)


def _rows(items: DataFrame) -> list[tuple[str, str]]:
    """The items of one block; ``block_words`` bounds them."""
    return sorted((r["item"], r["text"]) for r in items.select("item", "text").toLocalIterator())


def _one_block(docs: DataFrame, items: list[tuple[str, str]], width: int, doc_id: str, text: str, keep_text: bool, more: dict[str, Column]) -> DataFrame:
    kept = ("doc_id", *more, *["text"] * keep_text)
    shared = docs.sparkSession.sparkContext.broadcast(Index(items, width))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in slices(whole):
                rows = [verdict(*x) for x in find(index, batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES))], [*kept, *NAMES])

    schema = f"doc_id bigint{kinds_of(docs, more)}{', text string' * keep_text}, {SCHEMA}"
    return map_texts(docs, run, schema, doc_id=F.col(doc_id).cast("bigint"), **more, text=F.col(text))


def _hits(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in slices(whole):
                rows = find(index, batch.column("text").to_pylist())
                cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *cols], ["row", "doc_id", "n_words", "hits", "items"])

    return docs.mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, hits array<bigint>, items array<string>")
