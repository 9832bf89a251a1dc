"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Words are symbols: the most frequent ones each their own, all others one symbol for each shape (how they
end).  The probability of a word is that of its symbol's class, times that of the symbol within its class,
times the word's share of its symbol.  Both softmaxes add up weights of features of the words before it: the
last word, the second and the third (skip features), and hashed n-grams; those within classes are hashed
together with the class.  Shares and priors are counts over all training documents.

Training is synchronous.  Texts are dealt into ROUNDS by a hash of what they say.  In each round the weights
are broadcast, tasks add up the gradient over all their tokens, the sums are added on the executors, and one
Adagrad step follows.  So results do not depend on how the input is split.

Counts of words grow with the corpus and stay in a table that texts are joined with by word; hashed n-grams
get more rows with the training tokens, up to a bound (``sizes_of``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import U64, as_long, kinds_of, map_texts, mix, slices
from tideline.llm.scratch import Scratch
from tideline.llm.tokens import LOWERED, Words

SHAPE_BITS = 10
SHAPES = 1 << SHAPE_BITS
#: Words that are symbols of their own, and words whose counts travel with the model.
FEATURES = 3072
KNOWN = 100_000
SYMBOLS = FEATURES + SHAPES
#: As many classes as symbols in each, so that both softmaxes cost the same.
CLASSES = SLOTS = 64
assert CLASSES * SLOTS == SYMBOLS
#: Stands before a text.
START = SYMBOLS
ANCHORS = 64
ROUNDS = 8
RATE, DAMP = 0.7, 2.0
BATCH, BLOCK = 1 << 13, 1 << 11
LONG_RUN = 16
#: Rows of a matrix that travel to the driver as one.
PACK = 1 << 12
#: The end of a text, as a token.
END_KEY = 0x1234567890ABCD << SHAPE_BITS
#: Rows of hashed n-grams: one to so many training tokens, at least and at most.
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 1 << 14, 1 << 13, 1 << 16


def sizes_of(tokens: int) -> tuple[int, int]:
    """Rows of n-grams in the class model, and rows of the model within classes."""
    rows = LEAST_ROWS
    while rows < MOST_ROWS and rows * TOKENS_A_ROW < tokens:
        rows *= 2
    return rows, 2 * rows


def token_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all tokens, each text closed by the end, and the number of tokens of each text.

    A key's low bits are the word's shape, a hash of its last three bytes.
    """
    words = Words(column)
    tail = np.zeros(len(words.ends), U64)
    for i in range(3):
        at = words.ends - 1 - i
        tail |= np.where(at >= words.starts, LOWERED[words.raw[np.maximum(at, 0)]], 0).astype(U64) << U64(8 * i)
    keys = (words.keys >> U64(SHAPE_BITS) << U64(SHAPE_BITS)) | (mix(tail) >> U64(64 - SHAPE_BITS))
    counts = words.counts + 1
    out = np.full(len(keys) + len(counts), END_KEY, np.int64)
    out[np.arange(len(keys)) + np.repeat(np.arange(len(counts)), words.counts)] = as_long(keys)
    return out, counts


@dataclass
class Vocabulary:
    """The most frequent words, by key: their counts and symbols."""

    keys: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each key, and whether it is in here."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def symbol(self, keys: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        shape = FEATURES + (keys & (SHAPES - 1))
        return np.where(known, self.symbols[at], shape) if len(self.keys) else shape


def fresh_of(counts: np.ndarray) -> np.ndarray:
    """Marks the first token of each text."""
    out = np.zeros(int(counts.sum()), bool)
    out[np.cumsum(counts) - counts] = True
    return out


@dataclass
class Net:
    """Classes and slots of symbols, priors from counts, and the weights of both softmaxes."""

    of_class: np.ndarray
    slot: np.ndarray
    prior: np.ndarray
    inner_prior: np.ndarray
    pairs: int
    weights: np.ndarray = field(repr=False)
    inner: np.ndarray = field(repr=False)

    @property
    def class_rows(self) -> int:
        return 3 * (SYMBOLS + 1) + self.pairs

    def rows(self, symbols: np.ndarray, fresh: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of tokens a to b: (4, n) of the class model and (3, n) within the class of each token."""
        lo = max(0, a - 3)
        x, new = symbols[lo:b].astype(np.uint32), fresh[lo:b]
        before, last = [], x
        for _ in range(3):
            shifted = np.full(len(x), START, np.uint32)
            shifted[1:] = last[:-1]
            shifted[new] = START
            before.append(shifted[a - lo :])
            last = shifted
        (one, two, three), own = before, self.of_class[x[a - lo :]].astype(np.uint32)
        size = np.uint32(SYMBOLS + 1)
        gram = one * size + two
        shift = lambda n: np.uint32(33 - n.bit_length())  # noqa: E731  numbers of rows are powers of two
        pair = np.uint32(0x9E3779B1)
        outer = np.stack([one, two + size, three + 2 * size, (gram * pair >> shift(self.pairs)) + 3 * size])
        n = shift(len(self.inner))
        skip = (two * np.uint32(CLASSES) + own) * np.uint32(0x85EBCA6B)
        inner = np.stack([(one * np.uint32(CLASSES) + own) * pair >> n, skip >> n, (gram * np.uint32(0x85EBCA77) ^ own * np.uint32(0xC2B2AE3D)) * pair >> n])
        return outer, inner

    def masses(self, symbols: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For both softmaxes: e to the sum of features, the total of each row, and the column that came true."""
        own = self.of_class[symbols]
        yield *_masses(self.weights, outer, self.prior, None), own
        yield *_masses(self.inner, inner, self.inner_prior, own), self.slot[symbols]

    def log_probability(self, symbols: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Natural logarithm of each symbol's probability, a batch at a time."""
        out = np.zeros(len(symbols))
        for a in range(0, len(symbols), BATCH):
            b = min(len(symbols), a + BATCH)
            at = np.arange(b - a)
            for mass, total, true in self.masses(symbols[a:b], *self.rows(symbols, fresh, a, b)):
                out[a:b] += np.log(mass[at, true] / total)
        return out

    def add_gradient(self, symbols: np.ndarray, fresh: np.ndarray, sums: np.ndarray, inner_sums: np.ndarray) -> None:
        """Adds the gradient of the log-likelihood of all tokens to the sums."""
        for a in range(0, len(symbols), BATCH):
            b = min(len(symbols), a + BATCH)
            at, rows = np.arange(b - a), self.rows(symbols, fresh, a, b)
            for into, features, (error, total, true) in zip((sums, inner_sums), rows, self.masses(symbols[a:b], *rows)):
                error /= total[:, None]
                error[at, true] -= 1
                for r in features:
                    subtract_by_row(into, r, error)


def _masses(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray, of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """exp(prior + sum of weights) and its sum by row, in blocks that stay in the cache; beyond 60 a sum of weights counts as 60."""
    n, width = rows.shape[1], weights.shape[1]
    out, total, ones = np.empty((n, width), np.float32), np.empty(n, np.float32), np.ones(width, np.float32)
    for a in range(0, n, BLOCK):
        z = out[a : a + BLOCK]
        np.take(weights, rows[0, a : a + BLOCK], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            z += weights.take(r[a : a + BLOCK], axis=0)
        z += prior if of is None else prior.take(of[a : a + BLOCK], axis=0)
        np.clip(z, -60, 60, out=z)
        np.exp(z, out=z)
        np.dot(z, ones, out=total[a : a + BLOCK])
    return out, total


def subtract_by_row(total: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
    """total[rows[i]] -= error[i], over runs of equal rows; long runs as products, short ones side by side."""
    # numbers of 16 bits sort fastest
    order = np.argsort(rows.astype(np.uint16) if len(total) <= 1 << 16 else rows, kind="stable")
    at = rows[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(np.append(first, len(at)))
    ones = np.ones(int(n.max()), np.float32)
    for k in np.flatnonzero(n > LONG_RUN):
        total[at[first[k]]] -= ones[: n[k]] @ error.take(order[first[k] : first[k] + n[k]], axis=0)
    # the rows of one turn differ, most runs are of one row, and nothing is copied but what is taken
    now, left = first[n <= LONG_RUN], n[n <= LONG_RUN]
    while len(now):
        row = at[now]
        held = total.take(row, axis=0)
        held -= error.take(order[now], axis=0)
        total[row] = held
        more = left > 1
        now, left = now[more] + 1, left[more] - 1


def balanced_classes(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Symbols in the order of their classes: halves of equal size along the main direction of what stands beside them."""
    x = np.sqrt(vectors / np.maximum(vectors.sum(axis=1, keepdims=True), 1))

    def split(idx: np.ndarray, parts: int) -> list[np.ndarray]:
        if parts == 1:
            return [idx]
        y = x[idx] - x[idx].mean(axis=0)
        v = 1 + np.arange(y.shape[1]) * 1e-3
        for _ in range(30):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-12
        # rounded, so that the order of sums decides nothing
        order = idx[np.argsort(np.round(y @ v, 9), kind="stable")]
        half = len(order) // 2
        return split(order[:half], parts // 2) + split(order[half:], parts // 2)

    return np.concatenate(split(np.arange(len(x)), parts))


def packed(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns of fixed width as bytes, a batch in one row: what goes to the driver is few large values, no rows to be unpacked."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [b"".join(c.to_pylist()) if pa.types.is_binary(c.type) else c.to_numpy().tobytes() for c in map(batch.column, columns)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in flat], list(columns))

    return rows.select(*columns).mapInArrow(pack, ", ".join(f"{c} binary" for c in columns))


def summed(rows: DataFrame) -> DataFrame:
    """Adds up (row, v) by row on the executors; v holds float32 values.  Result: rows and values of many rows at once, as bytes."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, v in zip(batch.column("row").to_pylist(), batch.column("v").to_pylist()):
                x = np.frombuffer(v, np.float32)
                if row in held:
                    held[row] += x
                else:
                    held[row] = x.astype(np.float64)
        keys = [*held]
        for a in range(0, len(keys), PACK):
            part = keys[a : a + PACK]
            flat = [np.array(part, np.int32).tobytes(), np.array([held[k] for k in part]).astype(np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in flat], ["row", "v"])

    return rows.repartition("row").mapInArrow(add, "row binary, v binary")


def as_rows(values: np.ndarray, shift: int = 0) -> pa.RecordBatch:
    """The rows of a matrix that are not zero."""
    at = np.flatnonzero(values.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(at + shift, pa.int32()), pa.array([x.tobytes() for x in values[at].astype(np.float32)], pa.binary())], ["row", "v"])


def _arrived(rows: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and values of a matrix whose size the model bounds, on the driver, up to PACK rows at a time."""
    for r in rows.collect():
        yield np.frombuffer(r["row"], np.int32), np.frombuffer(r["v"], np.float32).reshape(-1, width)


def _texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and first-token marks of written texts, about a million tokens at a time."""
    for whole in batches:
        for batch in slices(whole, "symbols", 1 << 20):
            parts = [np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()]
            if parts:
                yield np.concatenate(parts), fresh_of(np.array([len(x) for x in parts]))


@dataclass
class Model:
    """A fitted model: ``counts`` is the table of all training words, the rest is bounded."""

    vocabulary: Vocabulary
    net: Net
    shape_total: np.ndarray
    train_tokens: int
    train_words: int
    counts: DataFrame
    scratch: Scratch


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n) of every token of all documents, each task's counts combined before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new, waiting = [], 0

        def merge() -> None:
            nonlocal keys, n, waiting
            k, c = np.unique(np.concatenate(new), return_counts=True)
            both, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n, c]), len(both)).astype(np.int64)
            keys, waiting = both, 0
            new.clear()

        rows = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
        for whole in batches:
            for batch in slices(whole):
                new.append(token_keys(batch.column("text"))[0])
                waiting += len(new[-1])
                if waiting > 1 << 20:
                    merge()
                    if len(keys) > 1 << 20:
                        yield rows()
                        keys, n = keys[:0], n[:0]
        if new:
            merge()
        yield rows()

    return map_texts(docs, run, "key bigint, n bigint", text=F.col(text)).groupBy("key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Learns from all of ``docs``.  Null and empty texts have an end only; without documents every word is unknown."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "maxent")
    counts = scratch.table("counts", count_words(docs, text))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the known words are bounded; executors pick them, and the driver puts them in order, most frequent first
    top = packed(counts.orderBy(F.desc("n"), "key").limit(KNOWN), "key", "n").collect()
    keys, n = (np.frombuffer(b"".join(r[c] for r in top), np.int64) for c in ("key", "n"))
    at = np.lexsort((keys, -n))
    keys, n = keys[at], n[at]
    rank = np.arange(len(keys))
    symbols = np.where(rank < FEATURES, rank, FEATURES + (keys & (SHAPES - 1)))
    order = np.argsort(keys)
    vocabulary = Vocabulary(keys[order], n[order], symbols[order])

    # tokens and words of each shape that are not symbols of their own
    shape_n, shape_v = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in counts.groupBy(F.col("key").bitwiseAND(F.lit(SHAPES - 1)).alias("shape")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        shape_n[r["shape"]], shape_v[r["shape"]] = r["n"], r["v"]
    own = keys[:FEATURES] & (SHAPES - 1)
    shape_n -= np.bincount(own, n[:FEATURES], SHAPES)
    shape_v -= np.bincount(own, minlength=SHAPES)
    weight = np.zeros(SYMBOLS)
    weight[: min(len(n), FEATURES)] = n[:FEATURES]
    weight[FEATURES:] = shape_n

    texts = symbol_table(docs, vocabulary, text, scratch)
    net = blank_net(texts, weight, int(total[0]))
    train(spark, [texts.where(F.col("round") == k) for k in range(ROUNDS)], net)
    scratch.drop("symbols")
    return Model(vocabulary, net, shape_n + 0.5 * (shape_v + 1), int(total[0]), int(total[1]), counts, scratch)


def symbol_table(docs: DataFrame, vocabulary: Vocabulary, text: str, scratch: Scratch) -> DataFrame:
    """(round, symbols): each text as symbols of 16 bits; its round depends on the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                keys, counts = token_keys(batch.column("text"))
                symbols = shared.value.symbol(keys, *shared.value.place(keys)).astype(np.uint16)
                ends = np.cumsum(counts).tolist()
                packed = [symbols[a:b].tobytes() for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([batch.column("round"), pa.array(packed, pa.binary())], ["round", "symbols"])

    dealt = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(ROUNDS)).cast("int")
    out = scratch.table("symbols", map_texts(docs, run, "round int, symbols binary", round=dealt, text=F.col(text)), "round")
    shared.destroy()
    return out


def blank_net(texts: DataFrame, weight: np.ndarray, tokens: int) -> Net:
    """Classes from what stands beside each symbol, priors from ``weight``, and weights of zero."""

    def beside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SYMBOLS * 2 * ANCHORS, np.int64)
        for symbols, fresh in _texts_of(batches):
            inner = ~fresh[1:]
            a, b = symbols[:-1][inner].astype(np.int64), symbols[1:][inner].astype(np.int64)
            for of, by, shift in ((a, b, 0), (b, a, ANCHORS)):
                live = by < ANCHORS
                table += np.bincount(of[live] * (2 * ANCHORS) + by[live] + shift, minlength=len(table))
        yield as_rows(table.reshape(SYMBOLS, -1))

    vectors = np.zeros((SYMBOLS, 2 * ANCHORS))
    for at, v in _arrived(summed(texts.select("symbols").mapInArrow(beside, "row int, v binary")), 2 * ANCHORS):
        vectors[at] = v
    order = balanced_classes(vectors, CLASSES)
    of_class, slot = np.empty(SYMBOLS, np.int64), np.empty(SYMBOLS, np.int64)
    of_class[order], slot[order] = np.divmod(np.arange(SYMBOLS), SLOTS)
    smooth = weight + 0.5
    class_n = np.bincount(of_class, smooth, CLASSES)
    inner_prior = np.empty((CLASSES, SLOTS), np.float32)
    inner_prior[of_class, slot] = np.log(smooth / class_n[of_class])
    pairs, inner = sizes_of(tokens)
    net = Net(of_class, slot, np.log(class_n / class_n.sum()).astype(np.float32), inner_prior, pairs, np.zeros((0, CLASSES), np.float32), np.zeros((inner, SLOTS), np.float32))
    net.weights = np.zeros((net.class_rows, CLASSES), np.float32)
    return net


def train(spark: SparkSession, texts: list[DataFrame], net: Net) -> None:
    """One synchronous step for each round of texts; changes the weights of ``net``."""
    squares = np.zeros((net.class_rows + len(net.inner), CLASSES), np.float32)
    for part in texts:
        shared = spark.sparkContext.broadcast(net)

        def gradient(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            sums, inner = np.zeros(now.weights.shape, np.float32), np.zeros(now.inner.shape, np.float32)
            for symbols, fresh in _texts_of(batches):
                now.add_gradient(symbols, fresh, sums, inner)
            yield as_rows(sums)
            yield as_rows(inner, len(sums))

        # a row that no task has a gradient of stays as it is
        for at, got in _arrived(summed(part.select("symbols").mapInArrow(gradient, "row int, v binary")), CLASSES):
            squares[at] += got * got
            step = got * (RATE / (np.sqrt(squares[at]) + DAMP))
            of_class = at < net.class_rows
            net.weights[at[of_class]] += step[of_class]
            net.inner[at[~of_class] - net.class_rows] += step[~of_class]
        # the driver keeps its copy of what is only unpersisted
        shared.destroy()


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """Scores each whole text.

    One row per input row: doc_id, the columns named in ``more``, n_tokens (the end included), n_known
    (tokens that training has), train_tokens, base_score and score, both log10, and token_score, the mean of
    score.  A null or empty text is an end alone.  Words that training lacks share what one unknown word of
    their symbol has.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.vocabulary, model.net, np.log10(model.shape_total)))
    n_train, v_train = model.train_tokens, model.train_words
    kept = ("row", "doc_id", *more)
    scratch = model.scratch

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, net, log_shape = shared.value
        log_count = np.log10(vocabulary.counts + 0.5)
        for whole in batches:
            for batch in slices(whole):
                keys, counts = token_keys(batch.column("text"))
                at, known = vocabulary.place(keys)
                symbols = vocabulary.symbol(keys, at, known)
                said = net.log_probability(symbols, fresh_of(counts)) / np.log(10)
                part = np.where(known, log_count[at], 0.0) if len(log_count) else np.zeros(len(keys))
                # a word of a shape has its share of the shape; the unknown part of it is added from the table
                shaped = symbols >= FEATURES
                said[shaped] += part[shaped] - log_shape[symbols[shaped] - FEATURES]
                starts = np.cumsum(counts) - counts
                sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (known.astype(np.int64), part, said)]
                rare, many = [], []
                for a, b in zip(starts.tolist(), (starts + counts).tolist()):
                    k, n = np.unique(keys[a:b][~known[a:b]], return_counts=True)
                    rare.append(k)
                    many.append(n)
                cols = [pa.array(counts, pa.int64()), *map(pa.array, sums), pa.array(rare, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols], [*kept, "n_tokens", "known", "part", "said", "rare", "many"])

    schema = f"row bigint, doc_id bigint{kinds_of(docs, more)}, n_tokens bigint, known bigint, part double, said double, rare array<bigint>, many array<int>"
    texts = scratch.table("texts", map_texts(docs, run, schema, row=F.monotonically_increasing_id(), doc_id=F.col(doc_id).cast("bigint"), **more, text=F.col(text)))

    rare = texts.where(F.size("rare") > 0).select("row", F.inline(F.arrays_zip(F.col("rare").alias("key"), F.col("many").alias("times"))))
    n = F.coalesce(F.col("n"), F.lit(0))
    found = (
        rare.join(model.counts, "key", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(n + 0.5)).alias("rest"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    )
    rest = F.coalesce("rest", F.lit(0.0))
    base = float(np.log10(n_train + 0.5 * (v_train + 1)))
    score = F.col("said") + rest
    return texts.join(found, "row", "left").select(
        "doc_id", *more, "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("part") + rest - F.col("n_tokens") * base).alias("base_score"), score.alias("score"), (score / F.col("n_tokens")).alias("token_score"),
    )
