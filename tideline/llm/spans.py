"""Spans of a text: how scans report them, and how texts are rewritten without them.

A span is (start, rank of its kind, end) in code points, end exclusive; sorting orders by start, then
by kind as its scan lists them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import kinds_of, map_texts, slices

Span = tuple[int, int, int]


def joined(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """``kind:start:end``, comma-joined, in order."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def digest(said: str) -> str:
    """Lowercase hex SHA-256 of a joined list of spans."""
    return hashlib.sha256(said.encode()).hexdigest()


def outside(spans: Sequence[Span], taken: Sequence[Span]) -> list[Span]:
    """Those spans that overlap none of ``taken``."""
    out, edges = [], sorted((a, b) for a, _, b in taken)
    at = 0
    for a, k, b in sorted(spans):
        while at < len(edges) and edges[at][1] <= a:
            at += 1
        if not any(x < b and a < y for x, y in edges[at : at + 4]):
            out.append((a, k, b))
    return out


def rest_of(start: int, end: int, taken: Sequence[Span], least: int = 1) -> list[tuple[int, int]]:
    """The parts of [start, end), ``least`` long or longer, that no span of ``taken`` covers."""
    out, at = [], start
    for a, _, b in sorted(taken):
        if a < end and b > at:
            out.append((at, a))
            at = max(at, b)
    out.append((at, end))
    return [(a, b) for a, b in out if b - a >= least]


def redacted(text: str, spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """The text with each span replaced by ``[kind]``; overlapping spans go as one, named after the first."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kinds[k]}]"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def scan(
    docs: DataFrame,
    base: Callable[[str], list[Span]],
    added: Callable[[str, list[Span]], list[tuple[Span, float]]],
    kinds: Sequence[str],
    n_base: int,
    prefix: str = "n_",
    redact: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
    **more: Column,
) -> DataFrame:
    """Runs the two parts of a scan over each whole text.

    ``base`` gives the spans of the fixed patterns, ``added`` what the method finds besides and the score
    of each span that it has judged.  One row per input row: doc_id, the columns named in ``more``, a count for each base kind,
    ``base_sha256``, ``spans``, ``n_added``, ``scores`` (kind:start:end=score) and, with ``redact``, the
    text without what was found.  A null text counts as empty, but stays null when redacted.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                cols: list[list] = [[] for _ in range(n_base + 4 + redact)]
                for t in batch.column("text").to_pylist():
                    found = base(t) if t else []
                    judged = added(t, found) if t else []
                    more = [s for s, _ in judged if s[1] >= n_base]
                    for k in range(n_base):
                        cols[k].append(sum(s[1] == k for s in found))
                    cols[n_base].append(digest(joined(found, kinds)))
                    cols[n_base + 1].append(joined(found + more, kinds))
                    cols[n_base + 2].append(len(more))
                    cols[n_base + 3].append(",".join(f"{kinds[k]}:{a}:{b}={x:.2f}" for (a, k, b), x in sorted(judged)))
                    if redact:
                        cols[n_base + 4].append(t if not found and not more else redacted(t, found + more, kinds))
                types = [pa.int64()] * n_base + [pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.string()] * redact
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, cols, types)], names)

    counts = [f"{prefix}{k}" for k in kinds[:n_base]]
    kept = ("doc_id", *more)
    names = [*kept, *counts, "base_sha256", "spans", "n_added", "scores"] + ["redacted"] * redact
    schema = ", ".join([f"doc_id bigint{kinds_of(docs, more)}", *(f"{c} bigint" for c in counts), "base_sha256 string", "spans string", "n_added bigint", "scores string"] + ["redacted string"] * redact)
    return map_texts(docs, run, schema, doc_id=F.col(doc_id).cast("bigint"), **more, text=F.col(text))
