"""Class-score rows (one array a time step) and what their peaks say about events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.timeline import containing


def class_percentiles(scores: DataFrame, p: float = 0.99) -> DataFrame:
    """The linearly interpolated percentile of each class of a stream."""
    long = scores.select("stream_id", F.posexplode("embedding").alias("class_no", "v"))
    return long.groupBy("stream_id", "class_no").agg(F.percentile("v", p).alias("p99"))


def class_peaks(scores: DataFrame, windows: DataFrame) -> DataFrame:
    """The best class of each window, in units of the class's 99th percentile; only positive scores count, the
    first class of equals wins."""
    inside = containing(scores, windows).select("stream_id", "window_no", F.posexplode("embedding").alias("class_no", "v"))
    top = inside.groupBy("stream_id", "window_no", "class_no").agg(F.max("v").alias("v")).where(F.col("v") > 0)
    unit = top.join(class_percentiles(scores), ["stream_id", "class_no"]).where(F.col("p99") > 0).withColumn("score", F.col("v") / F.col("p99"))
    best = F.max(F.struct("score", (-F.col("class_no")).alias("n")))
    return unit.groupBy("stream_id", "window_no").agg(best.alias("b")).select("stream_id", "window_no", (-F.col("b.n")).alias("class_no"), F.col("b.score").alias("score"))
