"""Intermediate tables in the folder that all executors share.

Writing a table cuts its lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where all runs on one machine, as in tests."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        said = f"{tempfile.gettempdir()}/tideline-scratch"
    return said.rstrip("/")


class Scratch:
    """Tables of one run.

    ``drop`` removes those that nothing reads any more.  What a result is still read from is removed when
    the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def table(self, name: str, df: DataFrame, *parts: str) -> DataFrame:
        """Writes ``df``, in folders by ``parts`` if any are named, and returns the written rows."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").partitionBy(*parts).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def close(self) -> None:
        """Removes all tables; does nothing once the session has ended."""
        if self.spark.sparkContext._jsc is not None:
            self._remove(self.root)

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
