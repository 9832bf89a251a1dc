"""A table of the last row of each key, appended to batch by batch and merged level by level.

A batch is a folder.  A list of the folders that count is written anew, under the next number, with every change, so a reader
sees the table before the change or after it.  As soon as ``fan`` folders of a level have come together they are merged into
one of the next level; so each row is rewritten once a level, and a reader opens at most ``fan`` folders of each.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.events import compacted

BUCKETS = 16
FAN = 8
#: Lists whose folders stay, for readers that have read an older one.
GRACE = 3


class UpsertTable:
    """``write`` serves as a foreachBatch sink; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "event_id", seq: str = "_seq", fan: int = FAN):
        self.spark, self.path, self.schema, self.key, self.seq, self.fan = spark, path.rstrip("/"), schema, key, seq, fan

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[str]:
        fs, at = self._fs(f"{self.path}/_lists")
        if not fs.exists(at):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().endswith(".json"))

    def _read(self, name: str) -> list[dict]:
        fs, at = self._fs(f"{self.path}/_lists/{name}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def folders(self) -> list[dict]:
        """The folders that count: level, first and last batch, name."""
        versions = self._versions()
        return self._read(versions[-1]) if versions else []

    def _commit(self, folders: list[dict]) -> None:
        versions = self._versions()
        number = int(versions[-1].split(".")[0]) + 1 if versions else 0
        fs, draft = self._fs(f"{self.path}/_lists/.{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(json.dumps(folders).encode())
        stream.close()
        _, final = self._fs(f"{self.path}/_lists/{number:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer has changed {self.path}")
        self._sweep()

    def _sweep(self) -> None:
        """Removes lists beyond GRACE, and folders that none of the others name."""
        versions = self._versions()
        old, kept = versions[:-GRACE], versions[-GRACE:]
        if not old:
            return
        held = {x["name"] for v in kept for x in self._read(v)}
        for v in old:
            for name in {x["name"] for x in self._read(v)} - held:
                fs, at = self._fs(f"{self.path}/data/{name}")
                fs.delete(at, True)
            fs, at = self._fs(f"{self.path}/_lists/{v}")
            fs.delete(at, False)

    def _put(self, rows: DataFrame, name: str) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")
        compacted(rows, self.key, self.seq).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{name}")

    def _rows(self, folders: list[dict]) -> DataFrame:
        out = None
        for x in folders:
            part = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/data/{x['name']}")
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], f"{self.schema}, bucket int") if out is None else out

    def write(self, batch: DataFrame, number: int) -> None:
        """Appends a batch; one that a restarted query brings again after it was counted changes nothing."""
        live = self.folders()
        if any(x["first"] <= number <= x["last"] for x in live):
            return
        name = f"batch-{number}"
        self._put(batch.select(*self.spark.createDataFrame([], self.schema).columns), name)
        self._commit([*live, {"level": 0, "first": number, "last": number, "name": name}])
        self.merge()

    def merge(self) -> None:
        """Merges levels that are full, the lowest first."""
        while True:
            live, levels = self.folders(), defaultdict(list)
            for x in live:
                levels[x["level"]].append(x)
            full = [k for k, v in levels.items() if len(v) >= self.fan]
            if not full:
                return
            parts = sorted(levels[min(full)], key=lambda x: x["first"])[: self.fan]
            new = {"level": min(full) + 1, "first": parts[0]["first"], "last": parts[-1]["last"], "name": f"level{min(full) + 1}-{parts[0]['first']}-{parts[-1]['last']}"}
            self._put(self._rows(parts).drop("bucket"), new["name"])
            names = {x["name"] for x in parts}
            self._commit([*(x for x in live if x["name"] not in names), new])

    def rows(self) -> DataFrame:
        """The last row of every key, as of now."""
        return compacted(self._rows(self.folders()).drop("bucket"), self.key, self.seq)

    def of(self, value: object) -> DataFrame:
        """The last row of one key; only its bucket is read."""
        one = F.lit(value).cast(dict(self.spark.createDataFrame([], self.schema).dtypes)[self.key])
        number = self.spark.range(1).select(F.pmod(F.xxhash64(one), F.lit(BUCKETS))).first()[0]
        found = self._rows(self.folders()).where((F.col("bucket") == number) & (F.col(self.key) == one))
        return compacted(found.drop("bucket"), self.key, self.seq)
