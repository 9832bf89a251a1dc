"""Byte-level BPE: encoding by monoid tree reduction, decoding by concatenation up the tree.

A text is cut at places that no pattern match can cross (before a space that a visible character
follows), then into the matches of the pattern.  The encoding of one match is built from its halves:

* a single byte is its own token;
* two neighbours are joined by re-encoding a window around the seam.  A token sequence is *the* BPE
  encoding of its bytes exactly if each two neighbouring tokens are (encoding their joint bytes gives
  the same two tokens back), so a window may be accepted as soon as its outer tokens agree with the
  tokens outside it; until then it grows by one token on each side.

Ranks whose tokens cannot be built by merges would break that rule; ``Encoder`` checks for them once
and keeps them in a table of whole matches, as the usual libraries do.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Memo, map_texts, slices

MEMO_BYTES = 48
SEAM = re.compile(r" (?=\S)")
ODD_SPACE = re.compile(r" (?!\S)")


class Encoder:
    """Encodes and decodes by the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.pairs: Memo = Memo(self._stay, 150_000)
        self.windows: Memo = Memo(self._merge, 60_000)
        self.pieces: Memo = Memo(self._reduce)
        self.chunks: Memo = Memo(self._chunk, 250_000)
        self.whole = {token: rank for token, rank in ranks.items() if self._merge(token) != (rank,)}

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Plain merging, lowest rank first and leftmost among equals; for windows of a few tokens."""
        get, none = self.ranks.get, self.size
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return tuple([self.ranks[p] for p in parts])

    def _stay(self, pair: int) -> bool:
        a, b = divmod(pair, self.size)
        return self._merge(self.tokens[a] + self.tokens[b]) == (a, b)

    def agree(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay as they are when their bytes are encoded together."""
        return self.pairs[a * self.size + b]

    def forget(self) -> None:
        """Empties what is remembered of texts; workers outlive their tasks."""
        for memo in (self.pairs, self.windows, self.pieces, self.chunks):
            memo.clear()

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's product: the encoding of the joint bytes, from the encodings of both parts."""
        if not left or not right:
            return left or right
        if self.agree(left[-1], right[0]):
            return left + right
        tokens, k = self.tokens, 1
        while True:
            outer, inner = left[:-k], right[k:]
            window = b"".join([tokens[t] for t in left[-k:] + right[:k]])
            mid = self.windows[window] if len(window) <= MEMO_BYTES else self._merge(window)
            if (not outer or self.agree(outer[-1], mid[0])) and (not inner or self.agree(mid[-1], inner[0])):
                return outer + mid + inner
            k += 1

    def _reduce(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        if n == 1:
            return (self.single[piece[0]],)
        if n > MEMO_BYTES:
            return self._reduce_long(piece)
        half = n // 2
        return self.join(self.pieces[piece[:half]], self.pieces[piece[half:]])

    def _reduce_long(self, piece: bytes) -> tuple[int, ...]:
        """Long matches reduce level by level from short leaves, so that nothing long is remembered."""
        level = [self.pieces[piece[i : i + MEMO_BYTES]] for i in range(0, len(piece), MEMO_BYTES)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode_match(self, piece: bytes) -> tuple[int, ...]:
        """One match of the pattern."""
        rank = self.whole.get(piece)
        if rank is not None:
            return (rank,)
        return self.pieces[piece] if len(piece) <= MEMO_BYTES else self._reduce_long(piece)

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.find(chunk):
            ids += self.encode_match(piece.encode("utf-8", "surrogatepass"))
        return array("I", ids).tobytes()

    def encode(self, text: str) -> array:
        """Token ids of a whole text, without special tokens."""
        if ODD_SPACE.search(text):
            first, *rest = SEAM.split(text)
        else:
            first, *rest = text.split(" ")
        chunks, packed = self.chunks, [self._chunk(first)]
        packed += [chunks[" " + x] if len(x) < MEMO_BYTES else self._chunk(" " + x) for x in rest]
        return array("I", b"".join(packed))

    def decode(self, ids: Iterable[int]) -> bytes:
        """Concatenates token bytes: leaves of 1,024 ids, then leaf by leaf up the tree."""
        ids = ids if isinstance(ids, (list, array)) else list(ids)
        get = self.tokens.__getitem__
        level = [b"".join(map(get, ids[i : i + 1024])) for i in range(0, len(ids), 1024)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 16]) for i in range(0, len(level), 16)]
        return level[0] if level else b""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary file, made once in each worker."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True
) -> DataFrame:
    """Encodes each whole text and decodes its ids again.

    One row per input row: ``doc_id``, ``ids`` (array<int>, with ``keep_ids``), ``n_tokens``,
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers), ``decoded_sha256`` and
    ``round_trip`` (the decoded bytes are the text's).  A null text counts as empty: no ids, the digests
    of no bytes.  Null and repeated doc_ids pass through; other columns of ``docs`` are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for whole in batches:
            for batch in slices(whole):
                rows: list[tuple] = []
                for t in batch.column("text").to_pylist():
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    ids = enc.encode(t) if t else array("I")
                    back = enc.decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == raw, ids if keep_ids else None))
                cols = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in ((0, pa.int64()), (1, pa.string()), (2, pa.string()), (3, pa.bool_())))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if keep_ids:
                    cols.append(pa.array([r[4].tolist() for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        enc.forget()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return map_texts(docs, run, schema + ", ids array<int>" * keep_ids, doc_id=F.col(doc_id).cast("bigint"), text=F.col(text))


def decode_ids(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of a column of id arrays; null gives null."""
    @F.pandas_udf("binary")
    def back(column: pd.Series) -> pd.Series:
        enc = encoder(path, pattern)
        return column.map(lambda x: None if x is None else enc.decode([int(i) for i in x]))

    return back(ids)
