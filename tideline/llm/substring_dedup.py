"""Substring dedup: content-defined chunks by a gear hash, deduplicated by digest.

A gear hash runs over the bytes of a text and is read at the ends of words; of every SPAN neighbouring ends
the one with the least hash (the last of equals) ends a chunk.  The hash only depends on the last 16 bytes,
so the same passage is cut at the same places wherever it stands, and text inserted before it shifts nothing.
Stretches without a cut are divided at fixed distances from the last, at the start of a character.

No passage of over 50 words is missed.  The hash at an end is the passage's own after 16 bytes, at most 8
words in; a cut there is the same in all copies once the SPAN - 1 ends on both its sides are too.  So cuts
agree from the 16th to the 43rd of 51 words, the first of them is the 23rd at most and the last the 36th at
least, and the run of repeated chunks between them has MIN_WORDS words or more.

A chunk is repeated if another document holds its digest.  Single chunks repeat by chance; what counts is
a run of neighbouring repeated chunks of at least ``min_words`` words, which is a passage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_long, kinds_of, map_texts, slices
from tideline.llm.scratch import Scratch

#: Ends of words of which one ends a chunk: chunks have 4.5 words on average, and SPAN at most.
SPAN = 8
#: In words of over LONG bytes (text without blanks) an end is also set with probability 2 ** -BITS at each byte.
BITS = 3
LONG = 64
LONGEST = 1024
#: Words in a run of repeated chunks that make it a passage.
MIN_WORDS = 12
GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 2024) & 0xFFFF for b in range(256)], np.uint16)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def cut_ends(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text, the last at its end."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    g = GEAR[raw]
    # the hash shifts left by one a byte and keeps 16 bits, so it holds the last 16 bytes; its high bits
    # depend on all of them
    h = np.zeros(n, np.uint16)
    for i in range(min(16, n)):
        h[i:] += g[: n - i] << np.uint16(i)
    solid = ~BLANK[raw]
    last = np.flatnonzero(solid & np.append(~solid[1:], True))
    begin = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
    long = last - begin >= LONG
    if long.any():
        cuts = np.flatnonzero((h >> np.uint16(16 - BITS)) == (1 << BITS) - 1)
        # the word that each cut is in or after
        at = np.searchsorted(begin, cuts, "right") - 1
        cuts = cuts[(at >= 0) & long[at] & (cuts < last[at])]
        last = np.sort(np.concatenate((last, cuts)))
    if len(last) >= SPAN:
        windows = np.lib.stride_tricks.sliding_window_view(h[last][::-1], SPAN)
        # read backwards, so that the last of equals is taken
        picked = len(last) - 1 - np.unique(windows.argmin(1) + np.arange(len(windows)))
        ends = np.sort(last[picked]) + 1
    else:
        ends = np.zeros(0, np.int64)
    ends = ends[ends < n]
    ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:
        parts, last = [], 0
        for e in ends.tolist():
            parts.append(np.arange(last + LONGEST - 3, e, LONGEST - 3))
            parts.append([e])
            last = e
        ends = np.concatenate(parts).astype(np.int64)
    # no cut inside a character
    for _ in range(3):
        inside = np.flatnonzero(raw[np.minimum(ends, n - 1)] & 0xC0 == 0x80)
        inside = inside[ends[inside] < n]
        ends[inside] -= 1
    return np.unique(ends)


def chunks_of(text: str | None) -> tuple[list[int], np.ndarray, list[int]]:
    """Digests, ends in bytes and numbers of words begun, of each chunk."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    buffer = np.frombuffer(raw, np.uint8)
    ends = cut_ends(buffer)
    if not len(ends):
        return [], ends, []
    blank = BLANK[buffer]
    begins = ~blank & np.concatenate(([True], blank[:-1]))
    words = np.diff(np.concatenate(([0], np.cumsum(begins)))[np.concatenate(([0], ends))])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    return [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts, ends.tolist())], ends, words.tolist()


def passages(repeated: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Runs [i, j) of repeated chunks with at least ``min_words`` words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], repeated.view(np.int8), [0])))).reshape(-1, 2)
    held = np.concatenate(([0], np.cumsum(words)))
    return [(i, j) for i, j in edges.tolist() if held[j] - held[i] >= min_words]


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text))


def runs_of(chunks: list[int], starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Byte ranges of chunks, those that touch joined."""
    out: list[tuple[int, int]] = []
    for i in chunks:
        if out and out[-1][1] == starts[i]:
            out[-1] = (out[-1][0], ends[i])
        else:
            out.append((starts[i], ends[i]))
    return out


def without(text: str, spare: str) -> str:
    """A text without the byte ranges that ``spare`` lists; cuts are at ends of words, so no character is split."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for said in spare.split(","):
        a, b = map(int, said.split(":"))
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def parts(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """A batch in runs of few rows; their arrays are views, so only one row's are worked on at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that share passages with others.

    One row per document with a passage: doc_id, n_chunks, n_repeated (chunks that other documents hold),
    passages (start:end in bytes, comma-joined), passage_bytes, spare_bytes (of chunks in passages whose
    first holder is another document: what deduplication removes), first_doc (the smallest doc_id that
    holds a chunk of its passages), spare (the bytes that go, as start:end, comma-joined) and row (a key of id
    and text).  Null, empty and short texts have none.  Rows that share a doc_id count as one document; rows
    without one are told apart by their texts, equal ones counting as one document, and come after all others:
    their doc_id is null, and first_doc where only such rows hold a passage.
    """
    scratch = Scratch(docs.sparkSession, "substrings")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                digests, sizes, words = [], [], []
                for t in batch.column("text").to_pylist():
                    d, e, w = chunks_of(t)
                    digests.append(as_long(np.array(d, np.uint64)))
                    sizes.append(np.diff(e, prepend=0).astype(np.int16))
                    words.append(np.array(w, np.int16))
                cols = [pa.array(digests, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int16())), pa.array(words, pa.list_(pa.int16()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *cols], ["doc_id", "row", "digests", "sizes", "words"])

    # a chunk has at most LONGEST bytes and so few words that both fit two bytes
    chunked = scratch.table("chunks", map_texts(docs, run, "doc_id bigint, row bigint, digests array<bigint>, sizes array<smallint>, words array<smallint>", doc_id=F.col(doc_id).cast("bigint"), row=row_key(doc_id, text), text=F.col(text)))
    # what is known of a digest holds for all that hold it, so an id that equals another row's key does no harm
    chunked = chunked.withColumn("key", F.coalesce("doc_id", "row"))
    held = chunked.select("key", "doc_id", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = held.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min("doc_id").alias("named")).where(F.col("first") < F.col("last"))
    shared = shared.select("digest", F.coalesce("named", "first").alias("first"), F.col("named").isNotNull().alias("named"))
    known = scratch.table("known", held.select("key", "digest").join(shared, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "first", "named")).alias("known")))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                docs, keys, keys_of_rows = (batch.column(c).to_pylist() for c in ("doc_id", "key", "row"))
                rows = []
                for i in range(batch.num_rows):
                    digests, sizes, words = (batch.column(c)[i].values.to_numpy() for c in ("digests", "sizes", "words"))
                    met = batch.column("known")[i].values
                    there = met.field("digest").to_numpy()
                    order = np.argsort(there)
                    at = order[np.minimum(np.searchsorted(there, digests, sorter=order), len(order) - 1)]
                    repeated = there[at] == digests
                    found = passages(repeated, words, min_words)
                    if not found:
                        continue
                    first, named = met.field("first").to_numpy()[at], met.field("named").to_numpy(zero_copy_only=False)[at]
                    ends = np.cumsum(sizes, dtype=np.int64)
                    starts = ends - sizes
                    inside = np.concatenate([np.arange(x, y) for x, y in found])
                    spare = inside[first[inside] != keys[i]]
                    cuts = runs_of(spare.tolist(), starts.tolist(), ends.tolist())
                    by_name = first[inside][named[inside]]
                    rows.append((
                        docs[i], len(digests), int(repeated.sum()), ",".join(f"{starts[x]}:{ends[y - 1]}" for x, y in found),
                        int(sizes[inside].sum(dtype=np.int64)), int(sizes[spare].sum(dtype=np.int64)), int(by_name.min()) if len(by_name) else None, ",".join(f"{x}:{y}" for x, y in cuts), keys_of_rows[i],
                    ))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "n_chunks", "n_repeated", "passages", "passage_bytes", "spare_bytes", "first_doc", "spare", "row"])

    schema = "doc_id bigint, n_chunks bigint, n_repeated bigint, passages string, passage_bytes bigint, spare_bytes bigint, first_doc bigint, spare string, row bigint"
    return chunked.join(known, "key").mapInArrow(judge, schema)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """All rows, each text without the passages that another document holds first.

    One row per input row: doc_id, the columns named in ``more``, text and spare_bytes (0 where nothing went).
    """
    found = repeated_passages(docs, min_words, doc_id, text).where(F.col("spare") != "").groupBy(F.col("row").alias("key")).agg(F.first("spare").alias("spare"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), *(c.alias(k) for k, c in more.items()), F.col(text).alias("text"), row_key(doc_id, text).alias("key")).join(found, "key", "left")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                new = [t if s is None or t is None else without(t, s) for t, s in zip(texts, batch.column("spare").to_pylist())]
                gone = [0 if t is None or t is n else len(t.encode("utf-8", "surrogatepass")) - len(n.encode("utf-8", "surrogatepass")) for t, n in zip(texts, new)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(new, pa.string()), pa.array(gone, pa.int64())], [*kept, "text", "spare_bytes"])

    kept = ("doc_id", *more)
    return rows.select(*kept, "text", "spare").mapInArrow(cut, f"doc_id bigint{kinds_of(docs, more)}, text string, spare_bytes bigint")
