"""Evaluation: matches of detections with truths, precision, recall and F1, confusion, sweeps and clock offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import timeline as tm


def prf(tp: Column, n_found: Column, n_true: Column) -> list[Column]:
    """precision, recall and F1; 0 where a divisor is 0."""
    p = F.when(n_found > 0, tp / n_found).otherwise(0.0)
    r = F.when(n_true > 0, tp / n_true).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def per_type(truths: DataFrame, found: DataFrame, pairs: DataFrame, by: str = "event_type") -> DataFrame:
    """Counts and P, R, F1 for each type; ``pairs`` has the type of each match."""
    t = truths.groupBy(by).agg(F.count("*").alias("n_true"))
    d = found.groupBy(by).agg(F.count("*").alias("n_found"))
    m = pairs.groupBy(by).agg(F.count("*").alias("tp"))
    all_ = t.join(d, by, "full").join(m, by, "left").na.fill(0)
    return all_.select(by, "n_true", "n_found", "tp", *prf(F.col("tp"), F.col("n_found"), F.col("n_true")))


def in_groups(counts: DataFrame, groups: dict[str, list[str]], by: str = "event_type") -> DataFrame:
    """The same over groups of types that may overlap: each type counts for every group that names it."""
    dim = counts.sparkSession.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], f"grp string, {by} string")
    s = counts.join(F.broadcast(dim), by).groupBy("grp").agg(F.sum("n_true").alias("n_true"), F.sum("n_found").alias("n_found"), F.sum("tp").alias("tp"))
    return s.select("grp", "n_true", "n_found", "tp", *prf(F.col("tp"), F.col("n_found"), F.col("n_true")))


def sweep(scored: DataFrame, thresholds: list[float], n_true: DataFrame, by: str = "event_type") -> DataFrame:
    """P, R, F1 of each type at each threshold over rows (type, confidence, hit)."""
    at = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    kept = F.col("confidence") >= F.col("threshold")
    s = at.groupBy(by, "threshold").agg(F.count_if(kept).alias("kept"), F.count_if(kept & F.col("hit")).alias("tp")).join(n_true, by)
    return s.select(by, "threshold", "kept", "tp", "n_true", *prf(F.col("tp"), F.col("kept"), F.col("n_true")))


def best_threshold(swept: DataFrame, by: str = "event_type") -> DataFrame:
    """The threshold with the best F1, the lowest of equals."""
    return swept.groupBy(by).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", (-F.col("threshold")).alias("n"))).alias("b")).select(by, "b.threshold", "b.f1")


def confusion(df: DataFrame, truth: str, said: str) -> DataFrame:
    return df.groupBy(truth, said).agg(F.count("*").alias("n"))


def best_offset(truths: DataFrame, found: DataFrame, offsets: list[float], tolerance: float) -> DataFrame:
    """The offset of a grid at which most truths have a detection within ``tolerance``; then least squared error, then first."""
    shifted = truths.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("t", F.col("t") + F.col("offset"))
    pairs = tm.within(shifted.select("stream_id", "seq", "offset", "t"), found.select("stream_id", "seq", "t"), -tolerance, tolerance)
    near = pairs.groupBy("stream_id", "offset", "seq").agg(F.min(F.abs(F.col("r.t") - F.col("t"))).alias("e"))
    s = near.groupBy("stream_id", "offset").agg(F.count("*").alias("matched"), F.floor(F.sum(F.col("e") * F.col("e")) * 1000).alias("ssr"))
    key = F.struct("matched", (-F.col("ssr")).alias("s"), (-F.col("offset")).alias("o"))
    return s.groupBy("stream_id").agg(F.max_by(F.struct("offset", "matched"), key).alias("b")).select("stream_id", "b.offset", "b.matched")


def chance(rate: Column, tolerance: float) -> Column:
    """The share of truths that cues at ``rate`` a second meet by chance."""
    return 1 - F.exp(-rate * 2 * tolerance)


def class_report(df: DataFrame, truth: str, said: str) -> DataFrame:
    """By class: tp, fp, fn, support, and precision, recall and F1 to four places; rows without either class count as classes too."""
    pairs = confusion(df, truth, said)
    sides = pairs.select(F.col(truth).alias("label"), (F.when(F.col(truth) == F.col(said), F.col("n")).otherwise(0)).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(F.col(truth) != F.col(said), F.col("n")).otherwise(0).alias("fn"))
    sides = sides.unionByName(pairs.where(F.col(truth) != F.col(said)).select(F.col(said).alias("label"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("bigint").alias("fn")))
    s = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r, f1 = (F.round(c, 4) for c in prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))
    return s.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def overall(report: DataFrame) -> DataFrame:
    """Accuracy, and the unweighted means over classes, of a ``class_report``."""
    mean = lambda c: F.round(F.avg(c), 4).alias(f"macro_{c}")
    return report.agg(F.sum("support").alias("samples"), F.sum("tp").alias("correct"), F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"))


def spread(swept: DataFrame, low: float = 0.3, high: float = 0.9, by: str = "event_type") -> DataFrame:
    """How much precision grows from the low to the high threshold of a ``sweep``."""
    at = lambda x: F.max(F.when(F.abs(F.col("threshold") - x) < 1e-9, F.col("precision")))
    return swept.groupBy(by).agg(at(low).alias("p_low"), at(high).alias("p_high"), (at(high) - at(low)).alias("spread"))


def reel_totals(scored: DataFrame, n_true: DataFrame, groups: dict[str, list[str]], thresholds: DataFrame | None = None, by: str = "event_type") -> DataFrame:
    """Counts and rates of groups of types over rows (type, confidence, hit), each type from its own threshold on (``by``, threshold)."""
    rows = scored if thresholds is None else scored.join(F.broadcast(thresholds.select(by, "threshold")), by, "left").where(F.col("confidence") >= F.coalesce("threshold", F.lit(0.0)))
    kept = rows.groupBy(by).agg(F.count("*").alias("n_found"), F.count_if("hit").alias("tp"))
    return in_groups(n_true.join(kept, by, "left").na.fill(0), groups, by)
