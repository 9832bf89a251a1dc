"""Settings: defaults, overridden by the session's ``tideline.*`` and then by the environment, read when asked for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings of a run and their defaults.
DEFAULTS = {
    "WORKING_DIR": "/tmp/tideline", "CHUNK_DURATION_SEC": "30", "CHUNK_OVERLAP_SEC": "2.0", "PRE_EVENT_PAD_SEC": "3.0", "POST_EVENT_PAD_SEC": "5.0",
    "MIN_EVENT_CONFIDENCE": "0.65", "DETECTION_FRAME_STEP": "3", "MAX_WORKERS": "2", "WATCH_POLL_INTERVAL_SEC": "10.0", "WATCH_STABLE_TIME_SEC": "30.0", "VLLM_MIN_CONFIDENCE": "0.5",
}


def setting(spark: SparkSession, name: str) -> str | None:
    """One setting as text; null if it is unknown and nobody set it."""
    return os.environ.get(name) or spark.conf.get(f"tideline.{name.lower()}", None) or DEFAULTS.get(name)


def number(spark: SparkSession, name: str) -> float:
    return float(setting(spark, name))


def settings(spark: SparkSession) -> DataFrame:
    """(name, value) of all known settings, as they are now."""
    return spark.createDataFrame([(k, setting(spark, k)) for k in DEFAULTS], "name string, value string")


def teams(spark: SparkSession, path: str) -> DataFrame:
    """Saved teams, one JSON document a file: team_name and kits by name; stubs and unreadable files go."""
    kit = "struct<outfield_color:string,gk_color:string>"
    raw = spark.read.option("wholetext", True).text(path)
    v = F.from_json("value", f"team_name string, kits map<string,{kit}>")
    return raw.select(v.alias("v")).select("v.*").where(F.coalesce("team_name", F.lit("")) != "")
