"""Quality classifier: random-indexing vectors, pooled per document, under a two-layer network.

Each term has a sparse random index vector that its bytes decide.  A term's vector is the sum of its own
index vector and those of its neighbours, over the training sample (random indexing); terms that the sample
lacks fall back to their shape.  A document is the mean of its words' vectors, the mean of their shapes'
vectors, and how far its words and lines repeat.  A network of two layers, trained in numpy, scores it; a
temperature fitted on held-back training rows calibrates the probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Memo, kinds_of, map_texts, slices

DIM = 32
NONZERO = 4
HIDDEN = 24
FEATURES = 2 * DIM + 5
EPOCHS = 60
#: Bounds: labelled documents of the training sample, words and shapes that get vectors.
SAMPLE = 6000
WORDS = 20_000
SHAPES = 2_000
#: Characters of the longest words whose rows are remembered.
LONG_WORD = 40
#: Label 1 is likelier than not from this score on.
CUT = 0.5

RUN = re.compile(r"(.)\1+")


def shape_of(word: str) -> str:
    """Letters as A or a, digits as 0, runs of one sign as two of it; of long shapes their signs, and how long they are."""
    out = RUN.sub(r"\1\1", "".join("0" if c.isdigit() else c if not c.isalpha() else "A" if c.isupper() else "a" for c in word))
    return out if len(out) <= 12 else f"{''.join(sorted({*out}))}~{len(out).bit_length()}"


def core_of(word: str) -> str:
    """The word without signs around it, lowered."""
    return word.strip("!#$%&*()|<>.,;:?\"'-_=+/[]{}").lower()


def index_vector(term: str) -> np.ndarray:
    """Sparse, ternary, and the same wherever it is made."""
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")))
    out = np.zeros(DIM, np.float32)
    out[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


@dataclass
class Vectors:
    """Rows of the vector table: words, then shapes, then one row for any other shape."""

    words: dict[str, int]
    shapes: dict[str, int]
    table: np.ndarray

    def rows(self, word: str) -> tuple[int, int]:
        shape = self.shapes.get(shape_of(word), len(self.table) - 1)
        return self.words.get(core_of(word), shape), shape


def repeats(words: list[str], text: str) -> list[float]:
    """Size, and shares of distinct words, of lines and of neighbouring words that repeat; characters a word."""
    n = len(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        np.log1p(n) / 8,
        len(set(words)) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(map(eq, words, islice(words, 1, None))) / n if n else 0.0,
        min(len(text) / n, 40) / 10 if n else 0.0,
    ]


def pooled(texts: list[str | None], vectors: Vectors, memo: Codes) -> np.ndarray:
    """One row of features for each text; a null or empty text gives zeros."""
    split = [t.split() if t else [] for t in texts]
    counts = np.array([len(w) for w in split])
    extra = np.array([repeats(w, t or "") for w, t in zip(split, texts)], np.float32).reshape(len(texts), -1)
    codes = np.fromiter((memo[w] for ws in split for w in ws), np.int64, int(counts.sum()))
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    live = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    base = np.int64(1 << 32)
    for i in live:
        at = codes[ends[i] - counts[i] : ends[i]]
        pairs, n = np.unique(at, return_counts=True)
        w = (n / counts[i]).astype(np.float32)
        out[i, :DIM] = w @ vectors.table[pairs // base]
        out[i, DIM:] = w @ vectors.table[pairs % base]
    return np.concatenate([out, extra], axis=1)


class Codes(Memo):
    """The rows of words as one number each; long words are looked up every time."""

    def __init__(self, vectors: Vectors):
        super().__init__(self.code)
        self.vectors = vectors

    def code(self, word: str) -> int:
        row, shape = self.vectors.rows(word)
        return (row << 32) + shape

    def __missing__(self, word: str) -> int:
        return super().__missing__(word) if len(word) <= LONG_WORD else self.code(word)


def row_memo(vectors: Vectors) -> Codes:
    return Codes(vectors)


@dataclass
class Model:
    """Vectors, the standardisation of features, both layers, and the temperature."""

    vectors: Vectors
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d)[:, 0] / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, vectors: Vectors, seed: int = 5) -> Model:
    """Adam on cross-entropy; the last fifth of the rows only fits the temperature."""
    rng = np.random.default_rng(seed)
    n_fit = max(1, len(x) * 4 // 5)
    mean, scale = x[:n_fit].mean(0), x[:n_fit].std(0) + 1e-3
    z = ((x - mean) / scale).astype(np.float32)
    layers = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    layers = [p.astype(np.float32) for p in layers]
    m, v, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(n_fit)
        for i in range(0, n_fit, 64):
            pick = order[i : i + 64]
            h = np.maximum(z[pick] @ layers[0] + layers[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30)))
            g = (p - y[pick, None]) / len(pick)
            back = (g @ layers[2].T) * (h > 0)
            t += 1
            for k, grad in enumerate((z[pick].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                grad = grad + 1e-4 * layers[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                layers[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = Model(vectors, mean, scale, layers, 1.0)
    held = slice(n_fit, None) if len(x) - n_fit >= 20 else slice(None)
    z, y = model.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.3), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0.5, z, -z) / t)) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def sample_of(rows: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``rank``, ``label_id``, ``label``, ``text`` of exactly ``sample`` labelled rows (all if there are fewer): those whose ids and texts hash lowest.

    The same rows in every run; of equal rows any.  The cut is found on hashes alone, so texts of the sample only move.
    """
    ranked = rows.withColumn("rank", F.xxhash64(F.col("label_id").cast("string"), F.col("text"), F.lit("quality")))
    last = ranked.select("rank", "label_id").join(labels, "label_id").select("rank").orderBy("rank").limit(sample).agg(F.max("rank")).first()[0]
    below = ranked.where(F.col("rank") <= F.lit(last)).join(labels, "label_id")
    return below.select("rank", "label_id", "label", "text").orderBy("rank").limit(sample)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """Learns from up to ``sample`` labelled rows for which ``train_rows``, a condition over ``label_id``, holds.

    Rows without a label, an id or a text teach nothing; where an id has several labels the lowest counts, and all rows
    of an id have it.  The sample bounds what is fitted: rows, not ids, are cut, and only counts of terms, vectors and
    features of its rows reach the driver.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("label_id")).agg(F.min(label).alias("label")).where(train_rows)
    texts = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    picked = sample_of(texts, known, sample)
    picked = picked.persist()
    try:
        vectors = fit_vectors(picked)
        shared = docs.sparkSession.sparkContext.broadcast(vectors)

        def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = row_memo(shared.value)
            for whole in batches:
                for batch in slices(whole):
                    x = pooled(batch.column("text").to_pylist(), shared.value, memo)
                    yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("label_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float32()))], ["rank", "id", "label", "x"])

        rows = picked.select("rank", F.col("label_id").cast("bigint"), F.col("label").cast("double"), "text").mapInArrow(features, "rank bigint, id bigint, label double, x array<float>").collect()
    finally:
        picked.unpersist()
    rows.sort(key=lambda r: (r["rank"], r["id"] or 0, r["x"]))
    if not rows:
        return Model(vectors, np.zeros(FEATURES), np.ones(FEATURES), [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1.0)
    return train(np.array([r["x"] for r in rows], np.float32), np.array([r["label"] for r in rows], np.float32), vectors)


def fit_vectors(texts: DataFrame) -> Vectors:
    """Random-indexing vectors of the sample's most frequent words and shapes.

    Two passes over the sample: counts of terms, cut to the bounds on Spark's side, then the sums of
    neighbours' index vectors, added up by term.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in (x for whole in batches for x in slices(whole)):
            seen: Counter = Counter()
            for t in batch.column("text").to_pylist():
                words = t.split()
                seen.update("w" + c for c in map(core_of, words) if c)
                seen.update("s" + s for s in map(shape_of, words))
            yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64())], ["term", "n"])

    terms = texts.select("text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    top = lambda kind, k: [r["term"][1:] for r in terms.where(F.col("term").startswith(kind) & (F.col("n") > 1)).orderBy(F.desc("n"), "term").limit(k).collect()]
    words, shapes = top("w", WORDS), top("s", SHAPES)
    n = len(words) + len(shapes) + 1
    names = [*("w" + w for w in words), *("s" + s for s in shapes), "other"]
    index = np.array([index_vector(x) for x in names], np.float32)
    plain = Vectors({w: i for i, w in enumerate(words)}, {s: len(words) + i for i, s in enumerate(shapes)}, index)
    shared = texts.sparkSession.sparkContext.broadcast(plain)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        memo = row_memo(vectors)
        size = (n + 1) * DIM
        sparse = np.argsort(-np.abs(vectors.table), axis=1, kind="stable")[:, :NONZERO]
        signs = np.take_along_axis(vectors.table, sparse, axis=1)
        # row n takes what would reach over the end of a document
        sparse, signs = np.vstack([sparse, sparse[:1]]), np.vstack([signs, 0 * signs[:1]])
        sums, held = np.zeros(size), np.zeros(n + 1, np.int64)
        for whole in batches:
            for batch in slices(whole):
                gap = [(n << 32) + n] * 2
                codes = np.fromiter((c for t in batch.column("text").to_pylist() for c in (*map(memo.__getitem__, t.split()), *gap)), np.int64)
                for at in (codes >> 32, codes & 0xFFFFFFFF):
                    held += np.bincount(at, minlength=n + 1)
                    for step in (1, 2):
                        for to, of in ((at[step:], at[:-step]), (at[:-step], at[step:])):
                            for k in range(NONZERO):
                                sums += np.bincount(to * DIM + sparse[of, k], signs[of, k], size)
        rows = np.flatnonzero(held[:n])
        sums = sums.reshape(n + 1, DIM).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(held[rows], pa.int64()), pa.array([x.tobytes() for x in sums[rows]], pa.binary())], ["row", "n", "v"])

    table = index * 1.0
    total, count_of = np.zeros((n, DIM), np.float32), np.zeros(n, np.float32)
    for r in texts.select("text").mapInArrow(add, "row bigint, n bigint, v binary").toLocalIterator():
        total[r["row"]] += np.frombuffer(r["v"], np.float32)
        count_of[r["row"]] += r["n"]
    seen = count_of > 0
    context = total[seen] / count_of[seen, None]
    table[seen] += context / (np.linalg.norm(context, axis=1, keepdims=True) + 1e-6)
    table /= np.linalg.norm(table, axis=1, keepdims=True) + 1e-6
    return Vectors(plain.words, plain.shapes, table.astype(np.float32))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", cut: float = CUT, keep_text: bool = False, **more: Column) -> DataFrame:
    """Scores each whole text.

    One row per input row: doc_id, the columns named in ``more``, the text with ``keep_text``, score (0 to 1, higher: label 1 likelier)
    and predicted (1 from ``cut`` on).  A null text scores as an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ("doc_id", *more, *["text"] * keep_text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = row_memo(model.vectors)
        for whole in batches:
            for batch in slices(whole):
                s = model.scores(pooled(batch.column("text").to_pylist(), model.vectors, memo)).astype(np.float64)
                keep = [batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32), pa.int32())], [*kept, "score", "predicted"])

    return map_texts(docs, run, f"doc_id bigint{kinds_of(docs, more)}{', text string' * keep_text}, score double, predicted int", doc_id=F.col(doc_id).cast("bigint"), **more, text=F.col(text))
