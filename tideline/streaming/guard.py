"""Stops a run that cannot come to anything, after so many windows and before the rest is paid for."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

# Windows after which a scan is judged, the least share of live ones, and the least number of labels.
WINDOWS = 20
LEAST_LIVE = 0.05
LEAST_LABELS = 2


@dataclass
class Totals:
    """What the observed metrics (``events.alarms``) add up to."""

    windows: int = 0
    dead: int = 0
    labels: int = 0

    @property
    def live_share(self) -> float:
        return 1 - self.dead / self.windows if self.windows else 0.0


def hopeless(totals: Totals) -> str | None:
    """Why a scan should end, or nothing."""
    if totals.live_share < LEAST_LIVE:
        return f"only {totals.windows - totals.dead} of {totals.windows} windows have events"
    if totals.labels < LEAST_LABELS:
        return f"all of {totals.windows} windows have one label"
    return None


@dataclass
class Verdict:
    """What was said of a run, once."""

    totals: Totals
    why: str | None
    stopped: bool


@dataclass
class Guard(StreamingQueryListener):
    """Judges each run once, as soon as it has seen ``windows`` windows, and stops those that are hopeless.

    ``metrics`` is the name under which the run observes them.  With ``stop`` false it only says so.  Runs that do not
    observe these metrics are left alone; a restarted query is a new run and is judged anew.
    """

    spark: SparkSession
    metrics: str = "canary"
    windows: int = WINDOWS
    rule: Callable[[Totals], str | None] = hopeless
    stop: bool = True
    seen: dict[str, Totals] = field(default_factory=dict)
    verdicts: dict[str, Verdict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        super().__init__()

    def onQueryStarted(self, event) -> None:
        self.seen[str(event.runId)] = Totals()

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        row = (event.progress.observedMetrics or {}).get(self.metrics)
        if row is None or run in self.verdicts:
            return
        totals = self.seen.setdefault(run, Totals())
        totals.windows += row["windows"]
        totals.dead += row["dead"]
        totals.labels = max(totals.labels, row["labels"])
        if totals.windows >= self.windows:
            why = self.rule(totals)
            self.verdicts[run] = Verdict(totals, why, bool(why and self.stop))
            if why and self.stop:
                # stopping waits for the query, which may wait for its listeners
                threading.Thread(target=self._end, args=(str(event.progress.id),), daemon=True).start()

    def _end(self, query_id: str) -> None:
        query = self.spark.streams.get(query_id)
        if query is not None:
            query.stop()

    def onQueryIdle(self, event) -> None:
        """Nothing to judge."""

    def onQueryTerminated(self, event) -> None:
        self.seen.pop(str(event.runId), None)

    def watch(self) -> "Guard":
        """Begins to listen."""
        self.spark.streams.addListener(self)
        return self

    def leave(self) -> None:
        self.spark.streams.removeListener(self)
