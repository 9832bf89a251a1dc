"""Training records: prompts and answers of samples, augmentation, caps by class, and the split by game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Frames of a record, labels that may be mirrored, records a class at most.
FRAMES = 8
MIRRORED = ["goal", "save_catch", "save_parry", "shot_on_target", "shot_off_target", "shot_blocked", "goal_kick", "free_kick"]
CAPS = {
    "goal": 400, "save_catch": 600, "save_parry": 200, "shot_on_target": 300, "shot_off_target": 300, "shot_blocked": 200, "corner_kick": 200,
    "goal_kick": 300, "throw_in": 200, "free_kick": 250, "penalty": 50, "none": 400,
}
DEFAULT_CAP = 300


def records(samples: DataFrame, query: Column, response: Column) -> DataFrame:
    """(query, response, images, meta) of samples with frames enough; others go.

    ``samples`` has game, label, ms, half, window_start, window_end, t, frames and augmentation.
    """
    meta = F.struct(F.col("game"), F.col("label"), F.col("ms").alias("event_time_ms"), F.col("half"), F.round("t", 2).alias("video_ts"), F.col("augmentation"))
    return samples.where(F.size("frames") >= FRAMES).select(query.alias("query"), response.alias("response"), F.slice("frames", 1, FRAMES).alias("images"), meta.alias("_meta"))


def window_query(template: str) -> Column:
    """A prompt that names the window's length, for ``records``."""
    return F.format_string(template, F.col("window_end") - F.col("window_start"))


def class_response(reasons: dict[str, str]) -> Column:
    """The answer of the second stage: the label, 0.95 (0.85 for none), and the label's fixed reason."""
    why = F.lit("Cannot determine the event type.")
    for label, text in reasons.items():
        why = F.when(F.col("label") == label, text).otherwise(why)
    return F.to_json(F.struct(F.col("label").alias("event"), F.when(F.col("label") == "none", 0.85).otherwise(0.95).alias("confidence"), why.alias("reasoning")))


def chat_form(windows: DataFrame, prompt: str, prefix: str = "") -> DataFrame:
    """Records with one image mark a frame, its time behind it, above the prompt; targets as compact JSON.

    ``windows`` has game, split, window_no, window_start, window_end, frames, times and target (array of structs).
    """
    mark = F.transform(F.arrays_zip("frames", "times"), lambda z: F.when(z["times"].isNull(), "<image>").otherwise(F.format_string("<image>t=%.1fs", z["times"])))
    said = F.format_string(prompt, F.size("frames"), F.col("window_start"), F.col("window_end"))
    meta = F.struct(F.col("game").alias("game_id"), F.col("split"), F.col("window_no").alias("window_idx"), F.size("target").alias("n_gt_events_in_window"))
    return windows.select(F.concat(F.array_join(mark, "\n"), F.lit("\n\n"), said).alias("query"), F.to_json("target").alias("response"), F.transform("frames", lambda f: F.concat(F.lit(prefix), f)).alias("images"), meta.alias("_meta"))


def mirrored(rows: DataFrame) -> DataFrame:
    """Samples and, of labels that look alike in a mirror, their mirror images."""
    return rows.unionByName(rows.where(F.col("label").isin(MIRRORED)).withColumn("augmentation", F.lit("mirror")))


def capped(rows: DataFrame, key: Column, caps: dict[str, int] = CAPS, default: int = DEFAULT_CAP) -> DataFrame:
    """At most so many rows a label: those whose keys hash lowest, the same in every run."""
    cap = F.lit(default)
    for label, n in caps.items():
        cap = F.when(F.col("label") == label, n).otherwise(cap)
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64(key), key))
    return rows.withColumn("__r", rank).where(F.col("__r") <= cap).drop("__r")


def split(rows: DataFrame, key: Column, holdout: list[str], val_percent: int) -> DataFrame:
    """With ``split``: holdout games as they are named, of the rest a share by hash is val, all else train."""
    share = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(100)) < val_percent
    return rows.withColumn("split", F.when(F.col("game").isin(holdout), "holdout").when(share, "val").otherwise("train"))


def shifted(truths: DataFrame, shifts: list[float], window: float = 6.0, margin: float = 3.0) -> DataFrame:
    """Samples at each shift of a truth: its label where the window still shows it, else none; not near the ends of the video.

    ``truths`` has t, duration and label; the samples also have centre, shift and visible.
    """
    s = truths.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("centre", F.col("t") + F.col("shift")).where((F.col("centre") >= margin) & (F.col("centre") <= F.col("duration") - margin))
    s = s.withColumn("visible", F.abs(F.col("shift")) <= window / 2)
    return s.withColumn("label", F.when(F.col("visible"), F.col("label")).otherwise("none"))


def hard_negatives(truths: DataFrame, offsets: list[float], window: float = 4.0, margin: float = 3.0) -> DataFrame:
    """Samples of none just beside a truth, where their window does not show it."""
    return shifted(truths, offsets, window, margin).where(~F.col("visible"))
