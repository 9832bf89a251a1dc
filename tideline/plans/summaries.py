"""Counts that runs are judged by: refinement, grounding, frames, hits and misses, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import timeline as tm
from tideline.plans.evaluate import chance


def refinements(answers: DataFrame, types_with_evidence: list[str]) -> DataFrame:
    """By type: how many were asked, confirmed, rejected, failed, and asked without a clause of evidence.

    ``answers`` has event_type, confirmed (null where the call failed).
    """
    return answers.groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("rejected"), F.count_if(F.col("confirmed").isNull()).alias("errors"),
        F.count_if(~F.col("event_type").isin(types_with_evidence)).alias("no_evidence"),
    )


def grounding(judged: DataFrame) -> DataFrame:
    """By type and reason: kept, dropped, and how many had a ball; ``judged`` has event_type, keep, reason, ball_detected."""
    return judged.groupBy("event_type", "reason").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"), F.count_if("ball_detected").alias("with_ball"))


def frame_bests(boxes: DataFrame, wanted: str, person: str) -> DataFrame:
    """A row a stream: its most confident box of class ``wanted`` (the first of equals), and the most persons in a frame.

    ``boxes`` has stream_id, t (the frame's), seq, cls, x, y, confidence.
    """
    own = F.col("cls") == wanted
    best = boxes.where(own).groupBy("stream_id").agg(F.max_by(F.struct("t", "seq", "x", "y", "confidence"), F.struct("confidence", (-F.col("t")).alias("t"), (-F.col("seq")).alias("s"))).alias("b"), F.count("*").alias("boxes"))
    most = boxes.groupBy("stream_id", "t").agg(F.count_if(F.col("cls") == person).alias("n")).groupBy("stream_id").agg(F.max("n").alias("persons_max"))
    return most.join(best, "stream_id", "left").select("stream_id", "persons_max", F.coalesce("boxes", F.lit(0)).alias("boxes"), F.col("b.seq").alias("best_seq"), F.col("b.confidence").alias("best_confidence"))


def hits(truths: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """By type: truths, and those with a detection of the type within the tolerance; no pairing."""
    hit = tm.within(truths, found, -tolerance, tolerance, "left_semi", on=("stream_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("hit"))
    total = truths.groupBy("event_type").agg(F.count("*").alias("truths"))
    return total.join(hit, "event_type", "left").select("event_type", "truths", F.coalesce("hit", F.lit(0)).alias("hit"), (F.col("truths") - F.coalesce("hit", F.lit(0))).alias("missed"))


def lift(truths: DataFrame, cues: DataFrame, extent: DataFrame, tolerance: float) -> DataFrame:
    """By type of truth and cue: the share of truths with the cue near, what chance gives, and the difference.

    ``cues`` has stream_id, seq, t, cue; ``extent`` stream_id and duration.
    """
    seconds = extent.agg(F.sum("duration").alias("seconds")).withColumn("one", F.lit(1))
    rates = cues.groupBy("cue").agg(F.count("*").alias("cues"))
    near = tm.within(truths, cues, -tolerance, tolerance).select("event_type", F.col("r.cue").alias("cue"), "stream_id", "seq").distinct().groupBy("event_type", "cue").agg(F.count("*").alias("near"))
    total = truths.groupBy("event_type").agg(F.count("*").alias("truths"))
    out = near.join(total, "event_type").join(rates, "cue").withColumn("one", F.lit(1)).join(F.broadcast(seconds), "one")
    share = F.col("near") / F.col("truths")
    by_chance = chance(F.col("cues") / F.greatest(F.lit(1.0), F.col("seconds")), tolerance)
    return out.select("event_type", "cue", "truths", "near", share.alias("share"), by_chance.alias("chance"), (share - by_chance).alias("lift"))


def throughput(calls: DataFrame, *by: str) -> DataFrame:
    """By group: calls, flagged ones, total and mean seconds, calls a second; ``calls`` has seconds and flag."""
    n, total = F.count("*"), F.sum("seconds")
    return calls.groupBy(*by).agg(n.alias("calls"), F.count_if("flag").alias("flagged"), total.alias("seconds"), (total / n).alias("mean_seconds"), (n / F.greatest(total, F.lit(0.01))).alias("per_second"))


def deltas(now: DataFrame, before: DataFrame, key: str, *values: str) -> DataFrame:
    """Each value now, before and the difference; what only one side has counts as 0 on the other."""
    a, b = now.select(key, *(F.col(v).alias(f"{v}_now") for v in values)), before.select(key, *(F.col(v).alias(f"{v}_before") for v in values))
    both = a.join(b, key, "full").na.fill(0)
    return both.select(key, *(x for v in values for x in (f"{v}_now", f"{v}_before", (F.col(f"{v}_now") - F.col(f"{v}_before")).alias(f"{v}_delta"))))


# Jersey colours by name, as hue (0 to 180), saturation and value (0 to 1).
JERSEYS = {
    "white": (0.0, 0.05, 0.95), "silver": (0.0, 0.05, 0.65), "gray": (0.0, 0.06, 0.45), "black": (0.0, 0.08, 0.10),
    "red": (0.0, 0.85, 0.70), "dark_red": (0.0, 0.85, 0.40), "maroon": (0.0, 0.80, 0.28), "burgundy": (170.0, 0.72, 0.30),
    "orange": (12.0, 0.90, 0.85), "neon_orange": (10.0, 0.95, 0.95), "yellow": (28.0, 0.85, 0.90), "neon_yellow": (35.0, 0.95, 0.95),
    "green": (60.0, 0.80, 0.55), "dark_green": (60.0, 0.85, 0.28), "neon_green": (55.0, 0.95, 0.95), "teal": (88.0, 0.80, 0.55),
    "sky_blue": (103.0, 0.48, 0.85), "light_blue": (107.0, 0.58, 0.82), "blue": (112.0, 0.82, 0.65), "dark_blue": (115.0, 0.90, 0.32), "navy": (116.0, 0.92, 0.20),
    "purple": (135.0, 0.65, 0.50), "pink": (157.0, 0.45, 0.80), "hot_pink": (153.0, 0.80, 0.82), "neon_pink": (153.0, 0.90, 0.95),
}


def jersey_key(name: Column) -> Column:
    return F.translate(F.lower(name), " -", "__")


def with_jersey(df: DataFrame, name: str) -> DataFrame:
    """With the hue, saturation and value of a jersey's colour; unknown names get nulls."""
    dim = df.sparkSession.createDataFrame([(k, *v) for k, v in JERSEYS.items()], "__k string, hue double, saturation double, brightness double")
    return df.join(F.broadcast(dim), jersey_key(F.col(name)) == F.col("__k"), "left").drop("__k")


def match_kits(teams: DataFrame, kit: str = "Home") -> DataFrame:
    """A match's kits from saved teams (team_name, kits: map of outfield_color and gk_color); stubs and unknown kits go."""
    k = F.col("kits")[kit]
    return teams.where((F.coalesce("team_name", F.lit("")) != "") & k.isNotNull()).select(
        "team_name", k["outfield_color"].alias("outfield_color"), k["gk_color"].alias("gk_color"), F.lit("Opponent").alias("opponent"), F.lit("white").alias("opponent_outfield_color"), F.lit("neon_yellow").alias("opponent_gk_color"))
