"""What runs write: diagnostics, manifests, lists of tags, evaluations and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import clock


def diagnostics(stages: dict[str, DataFrame], folder: str) -> None:
    """One folder of JSON lines a stage, overwritten by each run."""
    for name, rows in stages.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")


def manifest(jobs: DataFrame, events: DataFrame, clips: DataFrame) -> DataFrame:
    """(job_id, manifest): one JSON document a job with its events and clips by reel.

    ``jobs`` has job_id, source_file, duration_sec, reels (array of names) and output_paths (map); ``events``
    job_id and the event's fields, ``clips`` job_id, reel, start, end, event_type, signature and members.  An
    event is listed under each of the job's reels that it targets; reels without rows have empty lists.
    """
    one = F.struct("event_id", "event_type", "timestamp_start", "timestamp_end", "confidence", "reel_targets")
    named = jobs.select("job_id", F.explode("reels").alias("reel"))
    listed = events.select("job_id", F.explode("reel_targets").alias("reel"), "timestamp_start", "event_id", one.alias("e")).groupBy("job_id", "reel").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("timestamp_start", "event_id", "e"))), lambda x: x["e"]).alias("events"))
    two = lambda c: F.round(c, 2)
    clip = F.struct(two(F.col("start")).alias("start_sec"), two(F.col("end")).alias("end_sec"), two(F.col("end") - F.col("start")).alias("duration_sec"), F.col("event_type").alias("primary_event_type"), F.col("signature").alias("primary_signature"), F.size("members").alias("event_count"))
    cut = clips.groupBy("job_id", "reel").agg(F.array_sort(F.collect_list(clip)).alias("clips"))
    reels = named.join(listed, ["job_id", "reel"], "left").join(cut, ["job_id", "reel"], "left")
    lists = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("reel", F.coalesce(c, F.array()).alias("v")))))
    by_reel = reels.groupBy("job_id").agg(lists("events").alias("events_by_reel"), lists("clips").alias("clips_by_reel"))
    total = events.groupBy("job_id").agg(F.count("*").alias("total_events"))
    body = F.struct("job_id", F.col("output_paths").alias("reels"), "source_file", F.col("duration_sec").alias("video_duration_sec"), F.coalesce("total_events", F.lit(0)).alias("total_events"), "events_by_reel", "clips_by_reel")
    return jobs.join(by_reel, "job_id", "left").join(total, "job_id", "left").select("job_id", F.to_json(body).alias("manifest"))


def tag_line(event_type: Column, start: Column, end: Column, team: Column, confidence: Column, keeper: Column, inferred: Column) -> Column:
    """type — mm:ss.ss → mm:ss.ss — team=... conf=0.00 [GK] [INF]"""
    mark = lambda c, text: F.when(F.coalesce(c, F.lit(False)), text).otherwise("")
    return F.concat(event_type, F.lit(" — "), clock(start), F.lit(" → "), clock(end), F.lit(" — team="), F.coalesce(team, F.lit("unknown")), F.format_string(" conf=%.2f", confidence), mark(keeper, " [GK]"), mark(inferred, " [INF]"))


def tags(events: DataFrame, folder: str) -> None:
    """A text file a job, its events in the order of time; ``events`` has job_id, timestamp_start and line."""
    events.repartition("job_id").sortWithinPartitions("job_id", "timestamp_start").select("job_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("job_id").text(folder)


def evaluation(per_type: DataFrame, totals: DataFrame, folder: str) -> None:
    """One JSON document: totals, and counts and rates by type."""
    rows = per_type.agg(F.array_sort(F.collect_list(F.struct(*per_type.columns))).alias("per_type")).withColumn("one", F.lit(1))
    totals.select(F.lit(1).alias("one"), F.struct("*").alias("totals")).join(rows, "one").drop("one").write.mode("overwrite").json(folder)


def training(records: DataFrame, folder: str) -> DataFrame:
    """JSON lines in a folder a split; returns how many records each split and label has."""
    records.write.mode("overwrite").partitionBy("split").json(folder)
    return records.groupBy("split", F.col("_meta.label").alias("label")).agg(F.count("*").alias("records"))
