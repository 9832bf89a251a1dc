"""Quality rules: fixed per-document counts, and the frequency of lines across the documents of a host.

Lines are normalised (lowered, white space collapsed, digits as 0) and hashed.  For each host the number
of distinct documents with a line is counted; documents with equal text count once, so that copies of a
good page do not look like boilerplate.  A line over the limit is removed from the host's documents, and a
document of which too few words remain is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import map_texts, slices
from tideline.llm.scratch import Scratch

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
DIGIT = re.compile(rb"[0-9]")

#: A line is boilerplate in more distinct documents of its host than this, however many the host has.
LINE_DOCS = 10
#: Common lines are joined in so many parts, dealt by document, so that one line does not fill a task.
PARTS = 16
#: Share of a document's words that must remain.
REMAINING = 0.5
MIN_WORDS = 50
REPEATED = 50


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words inside windows of ``width`` words that the text has twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    base = len(ids)
    if base < 2_000_000:
        key = (x[:n] * base + x[1 : n + 1]) * base + x[2 : n + 2]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.stack([x[i : i + n] for i in range(width)], 1), axis=0, return_inverse=True, return_counts=True)
    hit = np.zeros(len(words), bool)
    for i in range(width):
        hit[i : i + n] |= counts[inverse] > 1
    return int(hit.sum())


def counts_of(text: str) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and (hash, words) of each normalised line."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [(x, s) for x in text.split("\n") if (s := x.encode("utf-8", "surrogatepass").lower().split())]
    held = Counter(x for x, _ in lines)
    hashed = [(xxhash.xxh3_64_intdigest(DIGIT.sub(b"0", b" ".join(s))), len(s)) for _, s in lines]
    return len(words), chars, symbols, len(lines) - len(held), repeated_words(words), hashed


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str | Column = "source",
    line_docs: int = LINE_DOCS,
    remaining: float = REMAINING,
) -> DataFrame:
    """Counts and verdict of each document.

    One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_removed (words in lines over the limit).  A null text has no words and fails; a
    null host is a host of its own.  Documents are told apart by doc_id and text, so repeated rows get the
    same verdict, each its own row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for t in batch.column("text").to_pylist():
                    *head, lines = counts_of(t or "")
                    merged = Counter()
                    for h, n in lines:
                        merged[h] += n
                    digest = xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass"))
                    rows.append((*head, np.array([*merged], np.uint64).view(np.int64).tolist(), [*merged.values()], digest - (1 << 64) * (digest >> 63)))
                types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(types))], names)

    names = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "digest"]
    schema = "doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, line_words array<bigint>, digest bigint"
    host = F.col(host) if isinstance(host, str) else host
    counted = map_texts(docs, run, schema, doc_id=F.col(doc_id).cast("bigint"), host=host.cast("string"), text=F.col(text))
    scratch = Scratch(docs.sparkSession, "lines")
    counted = scratch.table("counted", counted.withColumn("host", F.coalesce("host", F.lit("\x00null"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))

    # the lines of a document are distinct, so each distinct document holds a line once
    pages = scratch.table("pages", counted.select("host", "digest", "lines", "line_words").dropDuplicates(["host", "digest"]))
    held = pages.select("host", "digest", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))))
    common = held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    parts = common.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    dealt = held.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(PARTS)).cast("int"))
    removed = dealt.join(parts, ["host", "line", "part"]).groupBy("host", "digest").agg(F.sum("words").alias("removed"))
    return (
        counted.drop("lines", "line_words")
        .join(removed, ["host", "digest"], "left")
        .withColumn("n_removed", F.coalesce("removed", F.lit(0)).cast("bigint"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed") >= remaining * F.col("n_words")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")
    )
