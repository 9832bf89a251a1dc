"""A folder as a stream: polls of what lies in it, and files given out once they stop growing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

LISTING = "path string, size bigint, seen double"
FOUND = "path string, size bigint, error string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Subtree(InputPartition):
    """What one task lists: a folder with all below it, or the files right in it."""

    def __init__(self, path: str, recursive: bool):
        super().__init__(path)
        self.path, self.recursive = path, recursive


class FolderReader(DataSourceStreamReader):
    """Each trigger is a poll.  An offset is the time a poll was asked for, so it grows over restarts too; a poll that is
    run again after a failure says what lies there then, with the time of then, which is what its rows claim."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": int(time.time() * 1000)}

    def _open(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path)

    def partitions(self, start: dict, end: dict) -> list[Subtree]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = self._open()
        inside = fs.get_file_info(FileSelector(root, allow_not_found=True))
        return [Subtree(root, False), *(Subtree(x.path, True) for x in inside if x.type == FileType.Directory)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        from pyarrow.fs import FileSelector, FileType

        fs, _ = self._open()
        seen = time.time()
        for x in fs.get_file_info(FileSelector(partition.path, allow_not_found=True, recursive=partition.recursive)):
            if x.type == FileType.File and fnmatch(x.base_name, self.pattern):
                yield x.path, x.size, seen

    def commit(self, end: dict) -> None:
        """Nothing is kept between polls."""


class FolderSource(DataSource):
    """``format("folder")`` with options path (a local path or a URI) and pattern (of file names, ``*.mp4`` if none)."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("pattern", "*.mp4"))


def listing(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """A stream of (path, size, seen), one row a file and trigger; a folder that is not there has no files."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder").option("path", path).option("pattern", pattern).load()


class StableFiles(StatefulProcessor):
    """State of a path: size, since when, whether it was given out, and when it was last listed."""

    def __init__(self, stable_sec: float, idle_sec: float, retry_sec: float, callback: Callable[[str, int], Any] | None):
        self.stable_sec, self.idle_sec, self.retry_sec, self.callback = stable_sec, idle_sec, retry_sec, callback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "size bigint, since double, told boolean, last double")

    def _give(self, path: str, size: int) -> tuple[bool, pd.DataFrame]:
        """Calls back; on a failure the path is armed again, and the row says why."""
        error = None
        if self.callback is not None:
            try:
                self.callback(path, size)
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return error is None, pd.DataFrame({"path": [path], "size": [size], "error": pd.Series([error], dtype=object)})

    def _arm(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        size, since, told, last = self.file.get() if self.file.exists() else (-1, 0.0, False, 0.0)
        for seen_size, seen in sorted(((int(r.size), float(r.seen)) for x in rows for r in x.itertuples(index=False)), key=lambda r: r[1]):
            if seen_size != size:
                size, since, told = seen_size, seen, False
            elif not told and seen - since >= self.stable_sec:
                told, row = self._give(key[0], size)
                yield row
            last = max(last, seen)
        self.file.update((size, since, told, last))
        now = timerValues.getCurrentProcessingTimeInMs()
        waits = self.idle_sec if told or size < 0 or last - since < self.stable_sec else self.retry_sec
        self._arm(now + int(waits * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """A failed callback is tried again; a path that is listed no more is forgotten."""
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.file.exists():
            size, since, told, last = self.file.get()
            if now / 1000 - last >= self.idle_sec:
                self.file.clear()
            elif not told and last - since >= self.stable_sec:
                told, row = self._give(key[0], size)
                self.file.update((size, since, told, last))
                self._arm(now + int((self.idle_sec if told else self.retry_sec) * 1000))
                yield row
            else:
                self._arm(now + int(self.idle_sec * 1000))


def stable_files(
    polls: DataFrame, stable_sec: float = 30.0, idle_sec: float = 3600.0, retry_sec: float = 60.0, callback: Callable[[str, int], Any] | None = None
) -> DataFrame:
    """(path, size, error) of files of ``polls`` (path, size, seen) whose size has stayed for ``stable_sec``, once for each size they settle at.

    ``callback`` is called with path and size where the path's state is kept, before the row goes out; should a task be run
    again it may be called twice.  Where it raises, the row has the error, and the path is armed again: the next poll or, at
    the latest after ``retry_sec``, a timer calls once more.  A path that is not listed for ``idle_sec`` is forgotten, so that a
    file of the same name is a new one.
    """
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = StableFiles(stable_sec, idle_sec, retry_sec, callback)
    return polls.groupBy("path").transformWithStateInPandas(statefulProcessor=processor, outputStructType=FOUND, outputMode="Append", timeMode="ProcessingTime")
