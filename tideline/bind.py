"""Binds the generic tables to timelines: every day of the event table is one stream of about two hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE_OF = {"click": "shot_on_target", "purchase": "goal_kick", "error": "catch", "signup": "kickoff", "view": "corner_kick"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(column: Column, mapping: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in mapping.items():
        out = out.when(column == k, v)
    return out


def timeline(spark: SparkSession, sf_dir: str, mapping: dict[str, str] = TYPE_OF) -> DataFrame:
    """stream_id, seq, t (seconds), event_type, confidence, x, y, review_override, user_id, props."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.date_format(ts, "yyyy-MM-dd").alias("stream_id"),
        F.col("event_id").alias("seq"),
        ((F.unix_micros(ts) - F.unix_micros(F.date_trunc("DAY", ts))).cast("double") / 12000000.0).alias("t"),
        typed(F.col("event_type"), mapping).alias("event_type"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"),
        ((F.col("event_id") * 37 % 1000) / 1000.0).alias("x"),
        ((F.col("event_id") * 91 % 1000) / 1000.0).alias("y"),
        F.when(F.col("event_id") % 50 == 0, True).when(F.col("event_id") % 50 == 1, False).alias("review_override"),
        "user_id",
        "props",
    )


def timeline_sql(mapping: dict[str, str] = TYPE_OF) -> str:
    """The same as a DuckDB common table expression named tl."""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"""tl AS (SELECT strftime(ts, '%Y-%m-%d') AS stream_id, event_id AS seq,
 (epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP))::DOUBLE / 12000000.0 AS t,
 CASE event_type {cases} END AS event_type, least(1.0, value / 100.0) AS confidence,
 (event_id * 37 % 1000) / 1000.0 AS x, (event_id * 91 % 1000) / 1000.0 AS y,
 CASE event_id % 50 WHEN 0 THEN true WHEN 1 THEN false END AS review_override, user_id, props FROM events)"""


TL = timeline_sql()


def micro(column: Column) -> Column:
    """Seconds as whole microseconds, for results that two engines compare."""
    return F.floor(column * 1e6 + 0.5).cast("bigint")
