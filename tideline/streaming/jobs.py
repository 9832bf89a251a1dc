"""Jobs online: one job a content, results told once, heartbeats and stalls."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tideline.streaming.folder import ROCKS

# The states a job ends in, and the least progress (in percent) of a job that is alive.
ENDED = ("complete", "failed", "cancelled")
LEAST_PROGRESS = 0.1


class Submissions(StatefulProcessor):
    """State of a content: its job, and that job's status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "job_id string, status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        job_id, status = self.job.get() if self.job.exists() else (None, None)
        out = []
        for _, told, job in sorted(r for x in rows for r in x[["seq", "status", "job_id"]].itertuples(index=False, name=None)):
            if told != "submitted":
                status = told if job == job_id else status
            elif job_id is None:
                job_id, status = job, "pending"
                out.append((key[0], job_id, "created"))
            elif status == "failed":
                status = "pending"
                out.append((key[0], job_id, "requeued"))
            else:
                out.append((key[0], job_id, "existing"))
        if job_id is not None:
            self.job.update((job_id, status))
        yield pd.DataFrame(out, columns=["sha256", "job_id", "action"])


def submitted(events: DataFrame) -> DataFrame:
    """(sha256, job_id, action) for each submission in ``events`` (sha256, seq, job_id, status).

    Status "submitted" asks for a job under the id ``job_id``; any other is news of that job.  The first submission of a
    content creates its job; later ones get the same id, and put it back in the queue if it has failed.  Rows of one batch are
    taken by seq.  A content is never forgotten: the same file is the same job for good.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy("sha256").transformWithStateInPandas(statefulProcessor=Submissions(), outputStructType="sha256 string, job_id string, action string", outputMode="Append", timeMode="None")


class Watch(StatefulProcessor):
    """State of a job: progress now and at the last tick, ticks so far, and whether its end was told."""

    def __init__(self, tick_sec: float):
        self.tick_ms = int(tick_sec * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "seq bigint, progress double, before double, ticks bigint, ended boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = not self.job.exists()
        seq, progress, before, ticks, ended = (-1, 0.0, None, 0, False) if fresh else self.job.get()
        out = []
        for number, status, done in sorted(r for x in rows for r in x[["seq", "status", "progress"]].itertuples(index=False, name=None)):
            if ended or number <= seq:
                continue
            seq, progress = int(number), float(done)
            if status in ENDED:
                ended = True
                out.append((key[0], "result", status, progress))
        self.job.update((seq, progress, before, ticks, ended))
        if ended:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        elif fresh:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick_ms)
        yield pd.DataFrame(out, columns=["job_id", "what", "detail", "progress"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        seq, progress, before, ticks, ended = self.job.get()
        if not ended:
            still = before is not None and abs(progress - before) < LEAST_PROGRESS
            self.job.update((seq, progress, progress, ticks + 1, False))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick_ms)
            yield pd.DataFrame([(key[0], "stalled" if still else "heartbeat", str(ticks + 1), progress)], columns=["job_id", "what", "detail", "progress"])


def watched(progress: DataFrame, tick_sec: float = 300.0) -> DataFrame:
    """(job_id, what, detail, progress) of the jobs in ``progress`` (job_id, seq, status, progress in percent).

    Every ``tick_sec`` of processing time a job that has not ended gives a heartbeat, or is stalled where it has made less than
    a tenth of a percent since the last tick, whether news came or not.  Its end is told once, at once; what comes after it, and
    rows that are not newer than the last, are passed over.
    """
    progress.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return progress.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Watch(tick_sec), outputStructType="job_id string, what string, detail string, progress double", outputMode="Append", timeMode="ProcessingTime")
