"""Language identification by a byte convolutional network.

Windows of a fixed number of bytes pass through filters of several widths, a maximum over all positions
and a softmax.  A filter over bytes is a sum of one weight per byte and place, so filters of width two
are a table over byte pairs and those of width four two such tables; scoring is table look-ups in batches
of windows.  The network is trained in numpy on a bounded sample of labelled texts and is a few megabytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import kinds_of, map_texts, slices

WINDOW = 160
WIDTHS = (2, 4)
FILTERS = 12
#: Bound of the training sample, in texts; each gives up to PIECES windows.
SAMPLE = 4000
PIECES = 3
EPOCHS = 12
UNKNOWN = "und"


def windows_of(raw: bytes) -> np.ndarray:
    """A whole text as rows of WINDOW bytes, the last filled up with spaces."""
    n = -(-len(raw) // WINDOW) or 1
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Filters of each width, their biases, and the softmax over languages."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def pair_tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, a table over byte pairs for each two places of its filters."""
        return {w: [(f[i][:, None] + f[i + 1][None]).reshape(65536, FILTERS) for i in range(0, w, 2)] for w, f in self.filters.items()}

    def pooled(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Maxima of all filters in each window before the bias, and the convolutions they come from."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        tops, maps = [], {}
        for w, parts in tables.items():
            n = WINDOW - w + 1
            conv = np.take(parts[0], pairs[:, :n], axis=0)
            for i, table in enumerate(parts[1:], 1):
                conv += np.take(table, pairs[:, 2 * i : 2 * i + n], axis=0)
            tops.append(conv.max(axis=1))
            maps[w] = conv
        return np.concatenate(tops, axis=1), maps

    def hidden(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + np.concatenate([self.bias[w] for w in WIDTHS]), 0)

    def logits(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)), np.float32)]
        for i in range(0, len(windows), 256):
            out.append(self.hidden(self.pooled(windows[i : i + 256], tables)[0]) @ self.out + self.out_bias)
        return np.concatenate(out)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, seed: int = 11) -> None:
        """Gradient steps with Adagrad; the maximum passes its gradient to one place of each filter."""
        rng = np.random.default_rng(seed)
        seen = {id(p): np.full(p.shape, 1e-6, np.float32) for p in self._parameters()}

        def step(p: np.ndarray, g: np.ndarray) -> None:
            seen[id(p)] += g * g
            p -= rate * g / np.sqrt(seen[id(p)])

        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, n = windows[pick], len(pick)
                top, maps = self.pooled(x, self.pair_tables_of(x))
                h = self.hidden(top)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), labels[pick]] -= 1
                p /= n
                back = (p @ self.out.T) * (h > 0)
                step(self.out, h.T @ p)
                step(self.out_bias, p.sum(0))
                for j, w in enumerate(WIDTHS):
                    g = back[:, j * FILTERS : (j + 1) * FILTERS]
                    place = maps[w].argmax(axis=1)
                    grad = np.zeros_like(self.filters[w])
                    which = np.broadcast_to(np.arange(FILTERS), place.shape)
                    for k in range(w):
                        np.add.at(grad[k], (np.take_along_axis(x, place + k, axis=1), which), g)
                    step(self.filters[w], grad)
                    step(self.bias[w], g.sum(0))

    def pair_tables_of(self, windows: np.ndarray) -> "_Pairs":
        return _Pairs(self)

    def _parameters(self) -> Iterator[np.ndarray]:
        yield from self.filters.values()
        yield from self.bias.values()
        yield self.out
        yield self.out_bias


class _Pairs(dict):
    """While filters change with every step, single-byte look-ups are cheaper than whole pair tables."""

    def __init__(self, net: Network):
        super().__init__()
        self.net = net

    def items(self):
        for w, f in self.net.filters.items():
            yield w, [_PairView(f[i], f[i + 1]) for i in range(0, w, 2)]


class _PairView:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    def __array_function__(self, func, types, args, kwargs):
        pairs = args[1]
        return np.take(self.first, pairs >> 8, axis=0) + np.take(self.second, pairs & 255, axis=0)


def sample_of(known: DataFrame, sample: int) -> DataFrame:
    """``rank``, ``lang``, ``text`` of at most ``sample`` rows of ``known`` (id, lang, text), shared out evenly by language.

    Each language gives its rows whose ids and texts hash lowest, up to its share; of equal rows any.  Beyond ``sample``
    languages the most frequent ones share.  The cut of each language is found on hashes alone.
    """
    totals = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    languages = [r["lang"] for r in totals.collect()]
    share = sample // max(1, len(languages))
    ranked = known.withColumn("rank", F.xxhash64(F.col("id").cast("string"), "text", F.lit("langid"))).where(F.col("lang").isin(languages))
    # a limit within each group, which Spark takes in every task before it shuffles
    first = lambda rows: rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("place") <= share)
    cuts = first(ranked.select("lang", "rank")).groupBy("lang").agg(F.max("rank").alias("last"))
    # a row a language
    return first(ranked.join(F.broadcast(cuts), "lang").where(F.col("rank") <= F.col("last"))).select("rank", "lang", "text")


def fit(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network:
    """Trains on up to ``sample`` texts for which ``train`` holds and ``lang`` is not null.

    Rows are cut, not ids: null, equal and few ids make no difference to the bound, and every language among them is
    learned.  Of a sampled text up to PIECES windows are used; scoring always covers whole texts.  Where nothing can be
    learned, every text is ``und``.
    """
    known = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole)):
            rank, lang, out = [], [], []
            for r, l, t in zip(*(batch.column(c).to_pylist() for c in ("rank", "lang", "text"))):
                w = windows_of(t.encode("utf-8", "surrogatepass"))
                for i in sorted({0, len(w) // 2, max(0, len(w) - 2)})[:PIECES]:
                    rank.append(r)
                    lang.append(l)
                    out.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rank, pa.int64()), pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["rank", "lang", "window"])

    picked = sample_of(known, sample)
    rows = sorted((r["rank"], r["lang"], bytes(r["window"])) for r in picked.mapInArrow(cut, "rank bigint, lang string, window binary").toLocalIterator())
    if not rows:
        return Network([UNKNOWN])
    languages = sorted({r[1] for r in rows})
    net = Network(languages)
    x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(r[1]) for r in rows])
    if len(languages) > 1:
        net.train(x, y)
    return net


def predict(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """The language of each whole text: the windows' log-probabilities, averaged by their bytes.

    One row per input row: doc_id, the columns named in ``more``, lang_pred and score.  ``und`` with score 0
    where the text is null or has no letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = ("doc_id", *more)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.pair_tables()
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                raw = [t.encode("utf-8", "surrogatepass") if t and any(map(str.isalpha, t)) else b"" for t in texts]
                live = [i for i, r in enumerate(raw) if r]
                lang: list = [UNKNOWN] * len(texts)
                score = [0.0] * len(texts)
                if live:
                    parts = [windows_of(raw[i]) for i in live]
                    z = net.logits(np.concatenate(parts), tables)
                    z -= z.max(1, keepdims=True)
                    logp = z - np.log(np.exp(z).sum(1, keepdims=True))
                    ends = np.cumsum([len(p) for p in parts])
                    weight = np.full(len(logp), WINDOW, np.float32)
                    weight[ends - 1] = [len(raw[i]) % WINDOW or WINDOW for i in live]
                    sums = np.add.reduceat(logp * weight[:, None], np.concatenate(([0], ends[:-1])), axis=0)
                    mean = sums / np.array([[len(raw[i])] for i in live])
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    for i, k, q in zip(live, p.argmax(1).tolist(), p.max(1).tolist()):
                        lang[i], score[i] = net.languages[k], min(1.0, q)
                keep = [batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return map_texts(docs, run, f"doc_id bigint{kinds_of(docs, more)}, lang_pred string, score double", doc_id=F.col(doc_id).cast("bigint"), **more, text=F.col(text))
