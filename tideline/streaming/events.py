"""Streaming forms of the timeline: stable files, first and last wins, sessions, and rules that look ahead."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.plans import rules

LOOK_AHEAD_SEC = 180.0


def stable_files(listing: DataFrame, stable_sec: float = 30.0, idle_sec: int = 3600) -> DataFrame:
    """(path, size) of files whose size has not changed for ``stable_sec``; growth starts the clock anew.

    ``listing`` is a stream of (path, size, seen), one row a file and poll, seen in seconds.  A path is given out once
    for each size it settles at.  A path that is not listed for ``idle_sec`` is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["path", "size"])
            return
        size, since, told, last = state.get if state.exists else (-1, 0.0, False, 0.0)
        out = []
        for rows in batches:
            for r in rows.sort_values("seen").itertuples():
                if r.size != size:
                    size, since, told = int(r.size), float(r.seen), False
                elif not told and r.seen - since >= stable_sec:
                    told = True
                    out.append((key[0], size))
                last = max(last, float(r.seen))
        state.update((size, since, told, last))
        state.setTimeoutTimestamp(int((last + idle_sec) * 1000) + 1)
        yield pd.DataFrame(out, columns=["path", "size"])

    timed = listing.withColumn("at", F.timestamp_seconds("seen")).withWatermark("at", "1 minute")
    return timed.groupBy("path").applyInPandasWithState(step, "path string, size bigint", "size bigint, since double, told boolean, last double", "append", GroupStateTimeout.EventTimeTimeout)


def first_of_each(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Re-delivered events once: the first of each id within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 seconds", late: str = "2 minutes", ts: str = "ts") -> DataFrame:
    """Chains of one type of a stream as session windows, given out when the watermark has passed them."""
    s = events.withWatermark(ts, late).groupBy("stream_id", "event_type", F.session_window(ts, gap).alias("w"))
    return s.agg(F.count("*").alias("cluster_size"), F.max("confidence").alias("confidence")).select("stream_id", "event_type", F.col("w.start").alias("start"), "cluster_size", "confidence")


def confirmed_by_kickoff(shots: DataFrame, kickoffs: DataFrame, late: str = "1 minute") -> DataFrame:
    """Shots that a kickoff follows after 10 to 90 s: a stream-stream join whose state ends with the look-ahead."""
    s = shots.withWatermark("ts", late).alias("s")
    k = kickoffs.withWatermark("ts", late).alias("k")
    gap = (F.col("k.ts") >= F.col("s.ts") + F.expr("INTERVAL 10 SECONDS")) & (F.col("k.ts") <= F.col("s.ts") + F.expr("INTERVAL 90 SECONDS"))
    return s.join(k, (F.col("s.stream_id") == F.col("k.stream_id")) & gap).select("s.stream_id", "s.seq", F.col("k.seq").alias("kickoff_seq"))


def _apart(lo: float, hi: float) -> Column:
    """lo < r.ts - l.ts < hi, in seconds."""
    after = lambda sec: F.expr(f"l.ts + INTERVAL '{sec}' SECOND")
    return (F.col("r.ts") > after(lo)) & (F.col("r.ts") < after(hi))


def shots_and_kickoffs(shots: DataFrame, kickoffs: DataFrame, late: str = "1 minute", lo: float = 10.0, hi: float = 90.0) -> DataFrame:
    """Every shot with each kickoff between ``lo`` and ``hi`` seconds after it (ends left out), or with none.

    A shot that no kickoff followed is given out once the watermark has passed its window; state ends there too.  The side that
    is further behind sets the watermark.
    """
    l, r = shots.withWatermark("ts", late).alias("l"), kickoffs.withWatermark("ts", late).alias("r")
    return l.join(r, (F.col("l.stream_id") == F.col("r.stream_id")) & _apart(lo, hi), "left_outer").select("l.stream_id", "l.seq", "l.ts", F.col("r.seq").alias("kickoff_seq"))


def without_neighbours(left: DataFrame, right: DataFrame, reach: dict[str, tuple[float, float]], late: str = "1 minute") -> DataFrame:
    """Left rows near which their stream has no right row of a type, between the seconds that ``reach`` gives each type.

    An outer join of two streams whose matched side is dropped: a row is given out when the watermark has passed all it
    could meet, and held no longer.
    """
    l, r = left.withWatermark("ts", late).alias("l"), right.where(F.col("event_type").isin(list(reach))).withWatermark("ts", late).alias("r")
    meets = F.lit(False)
    for kind, (lo, hi) in reach.items():
        meets = meets | ((F.col("r.event_type") == kind) & _apart(lo, hi))
    widest = _apart(min(lo for lo, _ in reach.values()), max(hi for _, hi in reach.values()))
    out = l.join(r, (F.col("l.stream_id") == F.col("r.stream_id")) & widest & meets, "left_outer")
    return out.where(F.col("r.seq").isNull()).select("l.*")


def caught(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Shots on target of ``events`` (stream_id, seq, ts, event_type, confidence) after which play simply goes on: the keeper caught.

    The online form of the catch rule without probes: no save or goal near, no corner, kickoff or goal kick after the shot
    within the rule's reach, the longest of which is the look-ahead.
    """
    near = rules.CATCH_SKIP
    reach = dict.fromkeys(rules.SAVES, (-near["save"], near["save"])) | {"goal": (-near["goal"], near["goal"]), "corner_kick": (0.0, near["corner"]), "kickoff": (0.0, near["kickoff"]), "goal_kick": (0.0, near["goal_kick"])}
    shots = events.where(F.col("event_type") == "shot_on_target").select("stream_id", "seq", "ts", "event_type", "confidence")
    out = without_neighbours(shots, events.select("stream_id", "seq", "ts", "event_type"), reach, late)
    return out.select("stream_id", "seq", F.lit("catch").alias("event_type"), (F.col("confidence") * 0.85).alias("confidence"))


def dead_time(events: DataFrame, quiet_sec: float = 45.0, after_sec: float = 1.0, shot: str = "shot_on_target", ts: str | None = None, idle_sec: int = 3600) -> DataFrame:
    """Shots after which a stream is quiet, as soon as an event at or past their window shows it.

    ``events`` has stream_id, seq, t and event_type and arrives in time order for each stream; only shots whose window
    is open are held.  With ``ts``, the column of arrival times, a stream without events for ``idle_sec`` has
    ended: what it holds is given out and its state goes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, times, last = state.get if state.exists else ([], [], 0)
        seqs, times = list(seqs), list(times)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], s) for s in seqs], columns=["stream_id", "seq"])
            return
        out = []
        for rows in batches:
            for r in rows.sort_values(["t", "seq"]).itertuples():
                held = list(zip(seqs, times))
                out += [(key[0], s) for s, t in held if r.t - t >= quiet_sec]
                held = [(s, t) for s, t in held if r.t - t <= after_sec]
                if r.event_type == shot:
                    held.append((int(r.seq), float(r.t)))
                seqs, times = [s for s, _ in held], [t for _, t in held]
                last = max(last, int(r.ts.timestamp() * 1000) if ts else 0)
        state.update((seqs, times, last))
        if ts:
            state.setTimeoutTimestamp(last + idle_sec * 1000 + 1)
        yield pd.DataFrame(out, columns=["stream_id", "seq"])

    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    rows = events.select("stream_id", "seq", "t", "event_type", F.col(ts).alias("ts")).withWatermark("ts", "1 minute") if ts else events
    return rows.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq bigint", "seqs array<bigint>, times array<double>, last bigint", "append", timeout)


def upsert_latest(path: str, key: str = "event_id", seq: str = "_seq"):
    """A foreachBatch sink that appends each batch's last row of every key; readers compact the table by ``seq``.

    A batch writes into a folder of its own, so one that is run again after a failure replaces itself.
    """
    from tideline.sources.events import compacted

    def write(batch: DataFrame, number: int) -> None:
        compacted(batch, key, seq).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def alarms(windows: DataFrame, name: str = "canary") -> DataFrame:
    """The same rows with observed metrics: windows, empty ones, distinct labels (approximate)."""
    return windows.observe(name, F.count("*").alias("windows"), F.count_if(F.col("label") == "DEAD").alias("dead"), F.approx_count_distinct("label").alias("labels"))
