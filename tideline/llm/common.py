"""Shared pieces of the corpus operators: reading, batching and splitting documents.

Every operator walks whole texts in Arrow batches with ``mapInArrow``.  A batch is cut into
slices of bounded size first, so one run of very long texts never has to fit into a worker at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's reader only (the store may not be a local disk)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def in_fold(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where the fold is ``rest``; a null id is in no fold."""
    return F.coalesce(fold_of(doc_id, modulus) == rest, F.lit(False))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``limit`` bytes of text, one row at least."""
    n = batch.num_rows
    if batch.nbytes <= limit or n <= 1:
        yield batch
        return
    sizes = batch.column(text)
    lengths = np.array([len(x) if x is not None else 0 for x in (s.as_buffer() if s.is_valid else None for s in sizes)])
    start, held = 0, 0
    for i in range(n):
        if held and held + lengths[i] > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(lengths[i])
    yield batch.slice(start)


def map_texts(
    docs: DataFrame,
    fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    **columns: Column,
) -> DataFrame:
    """Runs ``fn`` over the named columns of ``docs`` only; other columns, whatever their names, stay out."""
    return docs.select(*(c.alias(k) for k, c in columns.items())).mapInArrow(fn, schema)


def kinds_of(df: DataFrame, columns: dict[str, Column]) -> str:
    """The columns as ``, name type`` for the end of a schema string."""
    types = dict(df.select(*(e.alias(c) for c, e in columns.items())).dtypes) if columns else {}
    return "".join(f", {c} {types[c]}" for c in columns)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lowered: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the output."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


class Memo(dict):
    """``memo[key]`` computes missing values with ``fn``; holds the values of up to ``limit`` keys, those asked for last.

    When half of that is full, it becomes the old half, from which values are taken back as they are asked
    for.  Keys have to be short: the caller keeps long ones out.
    """

    def __init__(self, fn, limit: int = 100_000):
        super().__init__()
        self.fn, self.half, self.old = fn, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.half:
            self.old = dict(self)
            super().clear()
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.old = {}
