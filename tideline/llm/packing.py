"""Packing into sequences by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest length as fit, then one
for each binary digit of the rest.  Pieces of equal length fall into one bucket, and each piece is a sequence, so no
sequence crosses documents and none is padded.  Sequences are numbered bucket by bucket, the longest first, so a batch
of neighbouring numbers has one length.

Ids are those of a word-level BPE vocabulary (lower case, ends of words marked) as its own library gives them.  Texts of
Latin letters, which are most, take a shorter way to the same ids: the distinct words of a slice are merged by rank,
with the end of a word as a byte of its own, and gathered by index.  Other texts go through the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import map_texts, slices
from tideline.llm.scratch import Scratch

LONGEST = 2048
END = 1
SLICE = 16 << 20
BUCKETS = 1024
#: Signs that need no care: ASCII and composed Latin letters without those whose lower case depends on what is around.
ODD = re.compile("[^\t-\r -~À-įı-ſ]")
MARK = " "
END_OF_WORD = "</w>"


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabularies of bytes, as sign to byte: visible Latin-1 stands for itself."""
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and not 0x7F <= b <= 0xA0]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a vocabulary whose tokens mark the ends of words, for many texts at once."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        signs = byte_signs()

        def raw(token: str) -> bytes:
            body = token.removesuffix(END_OF_WORD)
            return bytes(signs[c] for c in body) + MARK.encode() * (body != token)

        # bytes first, then each byte at the end of its word, then the merges in their order
        ranks = {bytes([b]): b for b in range(256)}
        for b in range(256):
            ranks.setdefault(bytes([b]) + MARK.encode(), len(ranks))
        for pair in told["model"]["merges"]:
            ranks.setdefault(raw("".join(pair if isinstance(pair, list) else pair.split(" "))), len(ranks))
        special = {x["content"] for x in told["added_tokens"]}
        self.ids = np.zeros(len(ranks), np.uint32)
        for token, i in told["model"]["vocab"].items():
            if token not in special:
                self.ids[ranks[raw(token)]] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.stop = ranks[b"\n" + MARK.encode()]
        self.split = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n").findall

    def merged(self, chunks: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that end with a line feed each, and where those of each chunk end."""
        ranks = np.array(self.merge(MARK.join(self.split(chunks)) + MARK), np.int64)
        stop = ranks == self.stop
        return self.ids[ranks[~stop]], np.cumsum(~stop)[stop]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        plain = [i for i, t in enumerate(texts) if not ODD.search(t)]
        odd = sorted(set(range(len(texts))) - set(plain))
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        if odd:
            for i, found in zip(odd, self.library.encode_batch([texts[i] for i in odd], add_special_tokens=False)):
                out[i] = np.array(found.ids, np.uint32)
        if plain:
            words = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.string()))
            told = words.values.dictionary_encode()
            chunks = pa.ListArray.from_arrays([0, len(told.dictionary)], told.dictionary)
            # an empty chunk, at either end of a text that begins or ends with space, has no ids
            bank, ends = self.merged(pc.binary_join(chunks, "\n")[0].as_py() + "\n")
            index, starts = told.indices.to_numpy(), np.concatenate([[0], ends])
            sizes = np.diff(starts)[index]
            stops = np.concatenate([[0], np.cumsum(sizes)])
            ids = bank[np.arange(stops[-1]) + np.repeat(starts[index] - stops[:-1], sizes)]
            bounds = stops[words.offsets.to_numpy()]
            for k, i in enumerate(plain):
                out[i] = ids[bounds[k] : bounds[k + 1]]
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a vocabulary file, made once in each worker."""
    return WordTokenizer(path)


def lengths_of(n: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of ``n`` ids: all powers of two up to ``longest``, descending."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def cut_documents(docs: DataFrame, path: str, longest: int = LONGEST, keep_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, with ``keep_ids``, ``ids``."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                rows, length, crc, tokens, start, kept = [], [], [], [], [], []
                for row, ids in enumerate(words.encode([t or "" for t in batch.column("text").to_pylist()])):
                    ids = np.append(ids, np.uint32(END))
                    raw, at = ids.astype("<u4").tobytes(), 0
                    cut = lengths_of(len(ids), longest)
                    for n in cut:
                        start.append(at)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                        if keep_ids:
                            kept.append(ids[at : at + n].astype(np.int32))
                        at += n
                    length += cut
                    rows += [row] * len(cut)
                    tokens += [len(ids)] * len(cut)
                columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * keep_ids
    return map_texts(docs, run, schema, doc_id=F.col("doc_id").cast("bigint"), text=F.col("text"))


def packed(docs: DataFrame, path: str, longest: int = LONGEST, keep_ids: bool = False) -> DataFrame:
    """The pieces of ``cut_documents``, each with ``sequence_id``, ``offset`` and ``bucket`` (its sequence's length).

    Numbers run from 0 without gaps, the buckets from the longest length down.  Within a bucket pieces are numbered by
    hash buckets, so none has to pass through one task.  A null or empty text is its end mark only; rows that share a doc_id
    are cut each for itself; no documents give no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table("pieces", cut_documents(docs, path, longest, keep_ids))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(BUCKETS)))
    # one row a length and hash bucket: at most BUCKETS times the number of lengths
    counts = dealt.groupBy("length", "deal").agg(F.count("*").alias("many"))
    earlier = F.sum("many").over(Window.orderBy(F.desc("length"), "deal").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "deal", F.coalesce(earlier, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("length", "deal").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    numbered = dealt.withColumn("inside", inside).join(F.broadcast(first), ["length", "deal"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("inside")).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("bucket")]
    return numbered.select(*columns, *["ids"] * keep_ids)
