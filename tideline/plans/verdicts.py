"""Verdict rows: (stream_id, seq, t, result, event_type, confidence, reasoning), and how they become events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import schema


def merge_tiers(one: DataFrame, two: DataFrame) -> DataFrame:
    """First-tier rows, replaced by second-tier ones of equal stream and time; the last of several counts."""
    last = two.groupBy("stream_id", "t").agg(F.max_by(F.struct("confidence"), "seq").alias("two"))
    return one.join(last, ["stream_id", "t"], "left").withColumn("confidence", F.coalesce("two.confidence", "confidence")).withColumn("second_tier", F.col("two").isNotNull()).drop("two")


def should_include(threshold: Column, fallback: float = schema.DEFAULT_THRESHOLD) -> Column:
    """A reviewer's word, else whether the confidence reaches the type's threshold."""
    return F.coalesce(F.col("review_override"), F.col("confidence") >= F.coalesce(threshold, F.lit(fallback)))


def with_types(df: DataFrame) -> DataFrame:
    """Rows with their type's dimension; unknown types get nulls."""
    return df.join(F.broadcast(schema.event_types(df.sparkSession)), "event_type", "left")


def in_reel(reel: str, targets: Column) -> Column:
    """Whether any target is the reel or one of its parts (reel_...)."""
    return F.exists(targets, lambda x: (x == reel) | x.startswith(f"{reel}_"))


def verdict_events(verdicts: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """One or two events a verdict.

    Rejected rows, uncertain ones without a type and those under ``min_confidence`` go.  A confirmed row
    without a type is a shot on target.  Each save also gives the shot that it met, at 0.95 of its confidence.
    """
    kind = F.when((F.col("result") == "confirmed") & F.col("event_type").isNull(), "shot_on_target").otherwise(F.col("event_type"))
    kept = verdicts.where(F.col("result") != "rejected").withColumn("event_type", kind).where(F.col("event_type").isNotNull() & (F.col("confidence") >= min_confidence))
    own = F.struct(F.col("event_type"), F.col("confidence"), F.lit(0).alias("part"))
    shot = F.struct(F.lit("shot_on_target").alias("event_type"), (F.col("confidence") * 0.95).alias("confidence"), F.lit(1).alias("part"))
    parts = F.when(F.col("event_type").isin(schema.SAVE_TYPES), F.array(own, shot)).otherwise(F.array(own))
    rest = [c for c in kept.columns if c not in ("event_type", "confidence")]
    return kept.select(*rest, F.explode(parts).alias("p")).select(*rest, "p.*")


def candidate_events(candidates: DataFrame) -> DataFrame:
    """Events of candidates that no model scored: whistles are free kicks, all else shots, at 0.7 of the confidence."""
    kind = F.when(F.col("cue").startswith("whistle"), "free_kick_shot").otherwise("shot_on_target")
    return candidates.withColumn("event_type", F.coalesce(kind, F.lit("shot_on_target"))).withColumn("confidence", F.col("confidence") * 0.7)


def made_events(df: DataFrame, fps: float = 30.0) -> DataFrame:
    """Padded, clamped event rows: timestamp_start, timestamp_end, frame_start, frame_end, reel_targets.

    ``df`` has t, duration and event_type; padding comes from the type.  Frames cut towards zero.
    """
    pre, post, _ = schema.DEFAULT_PADDING
    typed = with_types(df)
    start = F.greatest(F.lit(0.0), F.col("t") - F.coalesce("pre_pad", F.lit(pre)))
    end = F.least(F.col("duration"), F.col("t") + F.coalesce("post_pad", F.lit(post)))
    return (
        typed.withColumn("timestamp_start", start).withColumn("timestamp_end", end)
        .withColumn("frame_start", (F.col("timestamp_start") * fps).cast("bigint")).withColumn("frame_end", (F.col("timestamp_end") * fps).cast("bigint"))
        .withColumn("reel_targets", F.coalesce("reels", F.array().cast("array<string>"))).withColumn("is_goalkeeper_event", F.coalesce("is_gk", F.lit(False)))
    )


def boundary_events(boundaries: DataFrame, fps: float = 30.0) -> DataFrame:
    """Events of refined boundaries (event_type, start, end, confirmed, reasoning, duration).

    Unconfirmed ones, unknown types and what is empty within the video go.  The model's word counts fully.
    """
    known = [t[0] for t in schema.EVENT_TYPES]
    start, end = F.greatest(F.lit(0.0), F.col("start")), F.least("duration", "end")
    rows = boundaries.withColumn("start", start).withColumn("end", end).where(F.col("confirmed") & (F.col("end") > F.col("start")) & F.col("event_type").isin(known))
    return (
        rows.drop("confirmed").withColumnsRenamed({"start": "timestamp_start", "end": "timestamp_end"}).withColumn("confidence", F.lit(1.0))
        .withColumn("reel_targets", F.array("event_type")).withColumn("is_goalkeeper_event", F.lit(False))
        .withColumn("frame_start", (F.col("timestamp_start") * fps).cast("bigint")).withColumn("frame_end", (F.col("timestamp_end") * fps).cast("bigint"))
    )


def reviewed(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows to append to an event log for reviews: (event_id, include, confidence), either may be null.

    A word on inclusion marks the event as reviewed; a confidence is cut to 0..1.  Unknown ids give no row.
    """
    u = updates.select("event_id", F.col("include").alias("__i"), F.col("confidence").alias("__c"))
    new = {
        "review_override": F.coalesce("__i", "review_override"), "reviewed": F.col("reviewed") | F.col("__i").isNotNull(),
        "confidence": F.when(F.col("__c").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__c")))).otherwise(F.col("confidence")),
    }
    return events.join(u, "event_id").select(*(new.get(c, F.col(c)).alias(c) for c in events.columns))
