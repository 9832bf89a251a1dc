"""Asking models about rows, each thing once: a hook for any model, and two tiers of them.

A ``Scorer`` says how to make a model; a worker makes it once and asks it batch by batch.  Answers are kept in a table
by a digest of what was asked, so a run that is started again, or a second row that asks the same, costs no call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import verdict_of
from tideline.plans import routing
from tideline.sources.staging import staged

Model = Callable[[list[dict[str, Any]]], Sequence[str | None]]
ANSWER = "ask string, response string, error string"


@dataclass(frozen=True)
class Scorer:
    """A model under a name that also tells its version: answers are kept by it.

    ``load`` runs in the workers and returns what takes a list of rows (dicts of the inputs) and gives as many answers.
    A batch has at most ``batch_rows`` rows and, unless one row is larger, ``batch_bytes`` bytes.  With ``fail_open`` a
    row that the model fails on has no answer, and is asked again by the next run; else the run fails.
    """

    name: str
    load: Callable[[], Model]
    batch_rows: int = 32
    batch_bytes: int = 8 << 20
    fail_open: bool = True


_models: dict[str, Model] = {}


def _model(scorer: Scorer) -> Model:
    """The worker's model; workers outlive tasks, so it is made once in each."""
    if scorer.name not in _models:
        _models[scorer.name] = scorer.load()
    return _models[scorer.name]


def _size(row: dict[str, Any]) -> int:
    return sum(len(v) if isinstance(v, (str, bytes)) else 8 for v in row.values())


def batched(rows: Iterable[tuple[str, dict[str, Any]]], most_rows: int, most_bytes: int) -> Iterator[list[tuple[str, dict[str, Any]]]]:
    """Cuts rows, each with its digest, into batches within both bounds; a row beyond ``most_bytes`` is one of its own."""
    held: list[tuple[str, dict[str, Any]]] = []
    size = 0
    for row in rows:
        more = _size(row[1])
        if held and (len(held) == most_rows or size + more > most_bytes):
            yield held
            held, size = [], 0
        held.append(row)
        size += more
    if held:
        yield held


def _ask(scorer: Scorer, batch: list[tuple[str, dict[str, Any]]]) -> Iterator[tuple[str, str | None, str | None]]:
    """Answers of a batch; where it fails, of its rows one by one, so that one bad row costs only itself."""
    try:
        said = list(_model(scorer)([row for _, row in batch]))
        if len(said) != len(batch):
            raise ValueError(f"{scorer.name}: {len(said)} answers to {len(batch)} rows")
        for (ask, _), response in zip(batch, said):
            yield ask, response, None if response is not None else "no answer"
    except Exception as e:
        if not scorer.fail_open:
            raise
        if len(batch) == 1:
            yield batch[0][0], None, f"{type(e).__name__}: {e}"
        else:
            for row in batch:
                yield from _ask(scorer, [row])


def asking(rows: DataFrame, scorer: Scorer, inputs: Sequence[str]) -> DataFrame:
    """``ask``, ``response`` and ``error`` of each row of (ask, *inputs); every row is asked."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple[str, dict[str, Any]]]:
            for batch in batches:
                # a few rows at a time, so that a batch of large cells is never copied whole
                step = max(1, min(scorer.batch_rows, batch.num_rows * scorer.batch_bytes // max(1, batch.nbytes)))
                for i in range(0, batch.num_rows, step):
                    for row in batch.slice(i, step).to_pylist():
                        yield row.pop("ask"), row

        for batch in batched(flat(), scorer.batch_rows, scorer.batch_bytes):
            done = list(zip(*_ask(scorer, batch)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in done], names=["ask", "response", "error"])

    return rows.select("ask", *inputs).mapInArrow(run, ANSWER)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def known_answers(spark: SparkSession, scorer: Scorer, store: str) -> DataFrame:
    """``ask`` and ``response`` of all that this model has answered; of several answers to one thing the least."""
    path = f"{store}/model={scorer.name}"
    kept = spark.read.schema(ANSWER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], ANSWER)
    return kept.where(F.col("response").isNotNull()).groupBy("ask").agg(F.min("response").alias("response"))


def answered(rows: DataFrame, scorer: Scorer, inputs: Sequence[str], store: str) -> DataFrame:
    """Rows with the model's ``response`` to their ``inputs``; null where it failed.

    What ``store`` has is not asked again; rows that ask the same are one question.  New answers are appended in one
    commit: a task that is lost is asked again, a run that ended is not.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("ask", F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256))
    new = keyed.select("ask", *inputs).dropDuplicates(["ask"]).join(known_answers(spark, scorer, store).select("ask"), "ask", "left_anti")
    asking(new, scorer, inputs).write.mode("append").parquet(f"{store}/model={scorer.name}")
    return keyed.join(known_answers(spark, scorer, store), "ask", "left").drop("ask")


def verdicts(rows: DataFrame, scorer: Scorer, inputs: Sequence[str], store: str, tier: str, least: float = 0.6) -> DataFrame:
    """Rows with ``result``, ``event_type``, ``confidence``, ``reasoning`` by the model's answer, and ``tier``.

    A row without an answer passes: uncertain, without a type, at its own confidence.
    """
    told = answered(rows, scorer, inputs, store)
    said = F.when(F.col("response").isNotNull(), verdict_of(F.col("response"), least))
    passed = F.struct(F.lit("uncertain").alias("result"), F.lit(None).cast("string").alias("event_type"), F.col("confidence").alias("confidence"), F.lit("passed through unverified").alias("reasoning"))
    out = told.withColumn("v", F.coalesce(said, passed)).withColumn("answered", F.col("response").isNotNull())
    return out.drop("response", "event_type", "confidence").select("*", "v.*").drop("v").withColumn("tier", F.lit(tier))


def two_tiers(
    rows: DataFrame, one: Scorer, two: Scorer | None, inputs: Sequence[str], store: str, key_types: list[str],
    expected: dict[str, float] | None = None, least: float = 0.6,
) -> DataFrame:
    """Verdicts of a quick model, replaced by a slower one's where the first is in doubt.

    ``rows`` has stream_id, seq, t, confidence, motion and the inputs.  All rows go through the first tier, whose verdicts
    are written once; ``routing.routed`` says which escalate, and in streams whose types are seen far more often than
    ``expected`` all do.  Only those are asked of the second tier.  A verdict of the second tier holds for all rows of
    its stream and time (the last of several); where it has no answer, or there is no second tier, the first one's stays.
    """
    first = staged(verdicts(rows, one, inputs, store, "tier1", least), "tier1")
    if two is None:
        return first.drop("answered")
    marked = routing.routed(first, key_types)
    escalated = marked.where("escalate").select("stream_id", "seq")
    if expected is not None:
        odd = routing.label_anomalies(first.where(F.col("event_type").isNotNull()), expected).where("anomalous").select("stream_id").distinct()
        escalated = escalated.union(first.join(odd, "stream_id", "left_semi").select("stream_id", "seq")).distinct()
    # read twice, by the questions and by what their answers go to
    asked = staged(rows.join(escalated, ["stream_id", "seq"], "left_semi"), "asked")
    fields = ["result", "event_type", "confidence", "reasoning", "tier"]
    second = verdicts(asked, two, inputs, store, "tier2", least).where("answered")
    last = second.groupBy("stream_id", "t").agg(F.max_by(F.struct(*fields), "seq").alias("two"))
    merged = first.join(last, ["stream_id", "t"], "left")
    pick = lambda c: F.when(F.col("two").isNotNull(), F.col(f"two.{c}")).otherwise(F.col(c))
    return merged.withColumns({c: pick(c) for c in fields}).drop("two", "answered")

