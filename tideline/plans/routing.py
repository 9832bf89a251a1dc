"""Two tiers of models: which rows go to the second, and checks of a run's quality while it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# When a row or a whole stream goes to the second tier.
LOW_CONFIDENCE = 0.6
HIGH_MOTION = 0.95
RATE_CAP = 0.5
RARE_SHARE = 0.03


def nearest_rank(values: Column, p: float) -> Column:
    """sorted[min(int(n p), n - 1)] of an array."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), (F.least(F.floor(n * p).cast("int"), n - 1) + 1))


def ranked_value(rows: DataFrame, value: str, p: float, *by: str, name: str, accuracy: int = 10_000) -> DataFrame:
    """The same of a column by group, without collecting a group: nulls do not count.

    A sketch of the group gives two values around the one asked for, by rank, so outliers do no harm.  Rows below, between
    and above them are counted; only the distinct values of the part that holds the rank are put in order.
    """
    by = by or ("stream_id",)
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    slack = 2 / accuracy
    ends = v.groupBy(*by).agg(F.percentile_approx("v", [max(p - slack, 0.0), min(p + slack, 1.0)], accuracy).alias("q"), F.count("*").alias("n"))
    part = F.when(F.col("v") < F.col("q")[0], 0).when(F.col("v") <= F.col("q")[1], 1).otherwise(2)
    parted = v.join(ends, [*by]).withColumn("part", part).drop("q")
    w = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    held = parted.groupBy(*by, "part").agg(F.count("*").alias("held"), F.first("n").alias("n")).withColumn("upto", F.sum("held").over(w))
    rank = F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    here = held.where((F.col("upto") > rank) & (F.col("upto") - F.col("held") <= rank)).select(*by, "part", (rank - F.col("upto") + F.col("held")).alias("place"))
    values = parted.join(here, [*by, "part"]).groupBy(*by, "v").agg(F.count("*").alias("times"), F.first("place").alias("place"))
    through = F.sum("times").over(W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    values = values.withColumn("upto", through).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("times") <= F.col("place")))
    return values.select(*by, F.col("v").alias(name))


def routed(rows: DataFrame, key_types: list[str], cap: float = RATE_CAP) -> DataFrame:
    """``reasons`` and ``escalate`` of each row (result, event_type, confidence, motion).

    Uncertain or unsure rows, key types and strong motion that was rejected escalate; where more than ``cap`` of a
    stream does, all of it does.
    """
    p95 = ranked_value(rows, "motion", HIGH_MOTION, name="p95")
    why = F.array_compact(F.array(
        F.when(F.col("result") == "uncertain", "uncertain"), F.when((F.col("result") == "confirmed") & (F.col("confidence") < LOW_CONFIDENCE), "low_confidence"),
        F.when((F.col("result") == "confirmed") & F.col("event_type").isin(key_types), "key_event"), F.when((F.col("result") == "rejected") & (F.col("motion") > F.col("p95")), "motion_mismatch"),
    ))
    r = rows.join(p95, "stream_id", "left").withColumn("reasons", why)
    rate = r.groupBy("stream_id").agg(F.avg((F.size("reasons") > 0).cast("double")).alias("rate"))
    r = r.join(rate, "stream_id")
    over = F.col("rate") > cap
    return r.withColumn("reasons", F.when(over, F.array_append("reasons", F.lit("rate_cap"))).otherwise(F.col("reasons"))).withColumn("escalate", F.size("reasons") > 0).drop("p95", "rate")


def label_anomalies(rows: DataFrame, expected: dict[str, float], factor: float = 3.0, least: int = 10) -> DataFrame:
    """Types of a stream seen more than ``factor`` times their expected share; streams under ``least`` rows are not judged."""
    from tideline.plans.rules import looked_up

    n = F.sum("n").over(W.partitionBy("stream_id"))
    c = rows.groupBy("stream_id", "event_type").agg(F.count("*").alias("n")).withColumn("total", n).where(F.col("total") >= least)
    share = F.col("n") / F.col("total")
    return c.withColumn("share", share).withColumn("anomalous", share > looked_up(F.col("event_type"), expected, RARE_SHARE) * factor)


def flat_confidences(rows: DataFrame, kinds: int = 2, least: int = 20) -> DataFrame:
    """Streams with more than ``least`` rows whose confidences, at two decimals, take at most ``kinds`` values."""
    return rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("confidence") * 100 + 0.5)).alias("values")).where((F.col("n") > least) & (F.col("values") <= kinds))


def canaries(windows: DataFrame) -> DataFrame:
    """Checks of a scan over (stream_id, label, latency): shares of non-empty, most frequent and active labels, kinds, p95."""
    active = ["SET_PIECE", "SHOT_SAVE", "GOAL", "ATTACK"]
    per = windows.groupBy("stream_id", "label").agg(F.count("*").alias("n"))
    top = per.groupBy("stream_id").agg(F.max("n").alias("top"), F.count("*").alias("kinds"))
    s = windows.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") != "DEAD").alias("live"), F.count_if(F.col("label").isin(active)).alias("active")
    ).join(top, "stream_id").join(ranked_value(windows, "latency", 0.95, name="p95"), "stream_id", "left")
    alarms = F.array_compact(F.array(
        F.when(F.col("live") < 0.05 * F.col("n"), "empty"), F.when(F.col("top") > 0.92 * F.col("n"), "one_label"), F.when(F.col("active") < 0.03 * F.col("n"), "inactive"),
        F.when(F.col("kinds") < 2, "few_kinds"), F.when(F.col("p95") > 180, "slow"),
    ))
    return s.withColumn("alarms", alarms)


def scored(rows: DataFrame, recorded: DataFrame, prompt: str) -> DataFrame:
    """Rows with the recorded answer to a prompt; a missing answer gives null, which parsers read as uncertain."""
    answers = recorded.where(F.col("prompt") == prompt).groupBy("stream_id", "t").agg(F.max_by("response", "seq").alias("response"))
    return rows.join(answers, ["stream_id", "t"], "left")
