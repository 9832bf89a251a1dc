"""Clocks: the video offset and the start of the second half that fit detections best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import timeline as tm

#: The shortest half-time, in seconds.
MIN_HALFTIME = 300.0


def grid(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... up to high."""
    return [low + i * step for i in range(int((high - low) / step + 1e-9) + 1)]


def scored(truths: DataFrame, found: DataFrame, points: DataFrame, half2_game: float, tolerance: float) -> DataFrame:
    """Score, squared error and matches of each grid point of a stream.

    ``truths`` has stream_id, seq, signal, half (0 or 1) and t on the game clock, ``found`` stream_id, seq,
    signal and t in the video, ``points`` stream_id, video_offset, half2_start and the weight of each signal.
    A truth matches if its nearest detection of the same signal is within the tolerance.
    """
    # a half's times depend on one of the two numbers only, so each is matched once for each of its values
    first = truths.where("half = 0").join(points.select("stream_id", F.col("video_offset").alias("shift")).distinct(), "stream_id").withColumn("t", F.col("t") + F.col("shift"))
    second = truths.where("half = 1").join(points.select("stream_id", F.col("half2_start").alias("shift")).distinct(), "stream_id").withColumn("t", F.col("t") - half2_game + F.col("shift"))
    at = first.unionByName(second).select("stream_id", "signal", "seq", "half", "shift", "t")
    pairs = tm.within(at, found.select("stream_id", "signal", "seq", "t"), -tolerance, tolerance, on=("stream_id", "signal"))
    near = pairs.groupBy("stream_id", "signal", "half", "shift", "seq").agg(F.min(F.abs(F.col("r.t") - F.col("t"))).alias("e"))
    sums = near.groupBy("stream_id", "signal", "half", "shift").agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("ssr"))
    side = lambda half, name: sums.where(F.col("half") == half).select("stream_id", "signal", F.col("shift").alias(name), F.col("n").alias(f"n{half}"), F.col("ssr").alias(f"ssr{half}"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = points.join(side(0, "video_offset"), ["stream_id", "signal", "video_offset"], "left").join(side(1, "half2_start"), ["stream_id", "signal", "half2_start"], "left")
    n = zero(F.col("n0")) + zero(F.col("n1"))
    return both.groupBy("stream_id", "video_offset", "half2_start").agg(
        F.sum(n * F.col("weight")).alias("score"), F.sum(F.coalesce("ssr0", F.lit(0.0)) + F.coalesce("ssr1", F.lit(0.0))).alias("ssr"), F.sum(n).alias("matches"))


def best(scores: DataFrame) -> DataFrame:
    """The grid point of the highest score, then of the least error (in thousandths), then the first."""
    key = F.struct("score", (-F.floor(F.col("ssr") * 1000)).alias("s"), (-F.col("video_offset")).alias("o"), (-F.col("half2_start")).alias("h"))
    return scores.groupBy("stream_id").agg(F.max_by(F.struct("video_offset", "half2_start", "score", "matches"), key).alias("b")).select("stream_id", "b.*")


def search(truths: DataFrame, found: DataFrame, weights: dict[str, float], half2_game: float = 2700.0, tolerance: float = 45.0, coarse: tuple = ((0.0, 600.0, 10.0), (300.0, 1800.0, 30.0)), fine: tuple = ((20.0, 2.0), (40.0, 5.0))) -> DataFrame:
    """Coarse search over offset and half-time, then a fine one around its winner.

    One row a stream: video_offset, half2_start, score, matches.  The second half starts at
    video_offset + half2_game + half-time.  Streams without any truth or detection give no row.
    """
    signals = F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.lit(float(w)).alias("weight")) for k, w in weights.items())))
    streams = truths.select("stream_id").distinct().join(found.select("stream_id").distinct(), "stream_id")
    offsets, breaks = grid(*coarse[0]), grid(max(coarse[1][0], MIN_HALFTIME), *coarse[1][1:])
    array = lambda values: F.explode(F.array(*map(F.lit, values)))
    points = streams.withColumn("video_offset", array(offsets)).withColumn("rest", array(breaks))
    place = lambda p: p.withColumn("half2_start", F.col("video_offset") + half2_game + F.col("rest")).drop("rest").withColumn("s", signals).select("stream_id", "video_offset", "half2_start", "s.*")
    rough = best(scored(truths, found, place(points), half2_game, tolerance))
    (reach, step), (reach2, step2) = fine
    near = rough.select("stream_id", F.col("video_offset").alias("o"), (F.col("half2_start") - F.col("video_offset") - half2_game).alias("c"))
    low, low2 = F.greatest(F.lit(0.0), F.col("o") - reach), F.greatest(F.lit(MIN_HALFTIME), F.col("c") - reach2)
    near = near.withColumn("k", array(list(range(int(2 * reach / step) + 1)))).withColumn("video_offset", low + F.col("k") * step).where(F.col("video_offset") <= F.col("o") + reach)
    near = near.withColumn("k", array(list(range(int(2 * reach2 / step2) + 1)))).withColumn("rest", low2 + F.col("k") * step2).where(F.col("rest") <= F.col("c") + reach2)
    return best(scored(truths, found, place(near.select("stream_id", "video_offset", "rest")), half2_game, tolerance))


def first_match(anchors: DataFrame, answers: DataFrame, radius: float = 180.0, step: float = 10.0) -> DataFrame:
    """The first time around each anchor (stream_id, seq, t, event_type) at which a model saw it, and the new offset.

    Times are looked at every ``step`` from t - radius, not before 0; ``answers`` has stream_id, event_type, t
    and is_match.  Anchors that nothing matches give null.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(int(2 * radius / step))))
    at = anchors.withColumn("k", k).withColumn("probe", F.greatest(F.lit(0.0), F.col("t") - radius) + F.col("k") * step).where(F.col("probe") <= F.col("t") + radius)
    yes = answers.where("is_match").select("stream_id", "event_type", F.round(F.col("t") * 1e6).cast("bigint").alias("at")).distinct()
    hit = at.withColumn("at", F.round(F.col("probe") * 1e6).cast("bigint")).join(yes, ["stream_id", "event_type", "at"])
    found = hit.groupBy("stream_id", "seq").agg(F.min("probe").alias("found"))
    return anchors.join(found, ["stream_id", "seq"], "left").withColumn("shift", F.col("found") - F.col("t"))
