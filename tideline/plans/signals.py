"""Motion and sound: thresholds, bursts, quiet runs, and the windows that candidates give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import folds
from tideline.operators import timeline as tm

# Spikes, cues and their merging, in seconds.
SPIKE_MERGE = 8.0
SURGE_MERGE = 3.0
PAIR_REACH = 3.0
WINDOW_MOST = 12.0


def adaptive(df: DataFrame, value: str, half: int, sigmas: float = 0.7, floor: float = 0.8) -> DataFrame:
    """``threshold``: local mean plus ``sigmas`` population deviations, at least ``floor`` of the stream's mean."""
    out = tm.rolling(tm.with_totals(df, ("stream_id",), global_mean=F.avg(value)), value, half)
    return out.withColumn("threshold", F.greatest(F.col("local_mean") + sigmas * F.col("local_std"), floor * F.col("global_mean")))


def over_median(df: DataFrame, value: str, sigmas: float) -> DataFrame:
    """Rows whose share of the stream's largest value is over its median plus ``sigmas`` deviations."""
    part = tm.with_totals(df, ("stream_id",), __most=F.max(value)).withColumn("v", F.col(value) / F.col("__most")).drop("__most")
    limit = part.groupBy("stream_id").agg((F.median("v") + sigmas * F.stddev_pop("v")).alias("limit"))
    return part.join(limit, "stream_id").where(F.col("v") > F.col("limit"))


def bursts(df: DataFrame, loud: Column, gap: float, least: float, most: float) -> DataFrame:
    """Sessions of loud samples (start, end, centre, samples) between ``least`` and ``most`` seconds long."""
    s = tm.sessions(df.where(loud), gap).groupBy("stream_id", "session").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("samples"))
    return s.withColumn("centre", (F.col("start") + F.col("end")) / 2).where((F.col("end") - F.col("start") >= least) & (F.col("end") - F.col("start") <= most))


def dead_runs(df: DataFrame, least: int) -> DataFrame:
    """Runs of ``dead`` rows, ``least`` or longer, that live rows follow: start, end (the first live time), dead_samples."""
    first = F.min(F.struct("t", "seq"))
    runs = tm.islands(df, F.col("dead")).groupBy("stream_id", "island", "dead").agg(F.min("t").alias("start"), F.count("*").alias("dead_samples"), first.alias("f"))
    following = tm.scan(runs.withColumn("seq", F.col("f.seq")), ("stream_id",), ("start", "seq"), after={"end": F.col("f.t")}).drop("seq")
    return following.where(F.col("dead") & (F.col("dead_samples") >= least) & F.col("end").isNotNull())


def longest_low(df: DataFrame, low: Column, a: float, b: float) -> DataFrame:
    """The longest run of low rows between shares a and b of a stream, the first of equals."""
    mid = tm.with_totals(df, ("stream_id",), __lo=F.min("t"), __hi=F.max("t")).where((F.col("t") >= F.col("__lo") + a * (F.col("__hi") - F.col("__lo"))) & (F.col("t") <= F.col("__lo") + b * (F.col("__hi") - F.col("__lo"))))
    runs = tm.islands(mid.withColumn("low", low), F.col("low")).where("low").groupBy("stream_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("samples"))
    best = F.max_by(F.struct("start", "end", "samples"), F.struct("samples", (-F.col("start")).alias("n")))
    return runs.groupBy("stream_id").agg(best.alias("r")).select("stream_id", "r.*")


def merge_spikes(df: DataFrame, reach: float = SPIKE_MERGE) -> DataFrame:
    """Candidates closer than ``reach`` to the kept one merge: the more confident stays, clips are widened."""
    def both(a: folds.Row, b: folds.Row) -> folds.Row:
        win = b if folds.less(a[2], b[2]) else a
        return *win[:3], folds.least(a[3], b[3]), folds.greatest(a[4], b[4])

    return folds.merge_near(df, reach, both, ["t", "seq", "confidence", "clip_start", "clip_end"])


def merge_surges(df: DataFrame, reach: float = SURGE_MERGE) -> DataFrame:
    """Surges closer than ``reach`` to the kept one extend it; it keeps its time and takes the larger amplitude."""
    def both(a: folds.Row, b: folds.Row) -> folds.Row:
        through = None if b[2] is None else b[0] + b[2] - a[0]
        return *a[:2], folds.greatest(a[2], through), folds.greatest(a[3], b[3])

    return folds.merge_near(df, reach, both, ["t", "seq", "duration", "amplitude"])


def probe_window(t: Column, whistle: Column, clip_start: Column, clip_end: Column) -> Column:
    """(start, end): the 12 s before a whistle, else the clip; longer ones are cut to 12 s around their middle."""
    a = F.when(whistle.isNotNull(), F.greatest(F.lit(0.0), whistle - WINDOW_MOST)).otherwise(clip_start)
    b = F.when(whistle.isNotNull(), whistle).otherwise(clip_end)
    cut = F.greatest(F.lit(0.0), (a + b) / 2 - WINDOW_MOST / 2)
    return F.struct(F.when(b - a > WINDOW_MOST, cut).otherwise(a).alias("start"), F.when(b - a > WINDOW_MOST, cut + WINDOW_MOST).otherwise(b).alias("end"))


def _cuts(start: np.ndarray, end: np.ndarray, run: np.ndarray, pad: float, most: float) -> np.ndarray:
    """Whether a window is split before each flag of a stretch, in order.

    Splitting at the largest gap, and again, makes a tree: a flag's gap is the largest between the nearest larger one
    (or, before it, equal one: the first of equals splits first) on either side.  It splits iff the window between those
    two is too long.  Two passes with a stack of falling gaps find both neighbours.
    """
    n = len(start)
    gap = np.full(n, np.inf)
    gap[1:] = np.where(run[1:] == run[:-1], start[1:] - end[:-1], np.inf)
    left, right, stack = np.zeros(n, np.int64), np.full(n, n, np.int64), []
    for i, g in enumerate(gap.tolist()):
        while stack and gap[stack[-1]] < g:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack else 0
        stack.append(i)
    # the first flag of a run has no gap; what begins there is no split
    return (gap < np.inf) & (end[right - 1] + pad - np.maximum(0.0, start[left] - pad) > most)


def flag_windows(flags: DataFrame, gap: float, pad: float, most: float) -> DataFrame:
    """Flags (t, seq, label, zone) merged while gaps are at most ``gap`` and the zone stays, then padded.

    A flag spans from ``start`` to ``end`` where it has these (neither may fall along t, seq), else its t alone.  Windows over
    ``most`` seconds are split at their largest gap, and again, until each fits or is one flag; the first of equal gaps
    splits.  Whether a flag splits its window shows within ``most`` seconds of it, so streams are dealt by stretches that
    know that much of their neighbours.  Columns: stream_id, start, end, labels, n_flags.
    """
    spans = flags if "start" in flags.columns else flags.withColumn("start", F.col("t")).withColumn("end", F.col("t"))
    spans = spans.select("stream_id", "t", "seq", "label", "zone", "start", "end")
    apart = lambda before, v: (v["start"] - before["end"] > gap) | ~v["zone"].eqNullSafe(before["zone"])
    runs = tm.numbered(spans, F.struct("start", "end", "zone"), apart, ("stream_id",), "run")
    reach = most + 2 * pad
    width = 8 * reach
    near = F.sequence(F.floor((F.col("t") - reach) / width), F.floor((F.col("t") + reach) / width))
    dealt = runs.withColumn("stretch", F.explode(near))

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "seq"])
        rows["cut"] = _cuts(rows["start"].to_numpy(), rows["end"].to_numpy(), rows["run"].to_numpy(), pad, most)
        return rows[np.floor(rows["t"] / width) == rows["stretch"]]

    kept = dealt.groupBy("stream_id", "stretch").applyInPandas(split, ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", cut boolean").drop("stretch")
    # the cuts of a run, counted from its start
    parts = tm.numbered(kept, F.struct("run", "cut"), lambda before, v: v["cut"] | (before["run"] != v["run"]), ("stream_id",), "part")
    at = F.struct("t", "seq")
    windows = parts.groupBy("stream_id", "part").agg(F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.array_sort(F.collect_set("label")).alias("labels"), F.count("*").cast("int").alias("n_flags"))
    return windows.select("stream_id", F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"), "labels", "n_flags")


def active_runs(samples: DataFrame, least: float, keep_open: bool, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Runs of active samples of ``least`` seconds or more: start, end (the first sample after, or the last of all), centre, peak, first_seq.

    ``samples`` has t, seq, active and amplitude.  A run that is still open at the end of its stream goes
    unless ``keep_open``.
    """
    marked = tm.islands(tm.scan(samples, by, after={"__next": F.col("t")}), F.col("active"), *by).where("active")
    runs = marked.groupBy(*by, "island").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.max_by("__next", F.struct("t", "seq")).alias("after"), F.max("amplitude").alias("peak"), F.min_by("seq", F.struct("t", "seq")).alias("first_seq"))
    runs = runs.withColumn("end", F.coalesce("after", "last")).where((F.col("end") - F.col("start") >= least) & (F.lit(keep_open) | F.col("after").isNotNull()))
    return runs.select(*by, "start", "end", ((F.col("start") + F.col("end")) / 2).alias("centre"), "peak", "first_seq")


def whistles(samples: DataFrame, least: float = 0.2, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Runs of whistle samples with the place of their strongest band; ``samples`` also has bands (array of energies)."""
    runs = active_runs(samples, least, True, by)
    inside = samples.where("active").select(*by, "t", F.posexplode("bands").alias("band", "energy"))
    spans = runs.select(*by, "start", "end", "first_seq").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / 30), F.floor(F.col("end") / 30))))
    met = inside.withColumn("b", F.floor(F.col("t") / 30)).join(spans, [*by, "b"]).where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end")))
    sums = met.groupBy(*by, "first_seq", "band").agg(F.sum("energy").alias("energy"))
    top = sums.groupBy(*by, "first_seq").agg(F.max_by("band", F.struct("energy", (-F.col("band")).alias("n"))).alias("band"))
    return runs.join(top, [*by, "first_seq"], "left")


def surges(samples: DataFrame, least: float = 0.5, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Closed runs of surge samples; their peak is a share of the stream's loudest sample."""
    most = samples.groupBy(*by).agg(F.max("amplitude").alias("most"))
    runs = active_runs(samples, least, False, by).join(most, list(by))
    return runs.withColumn("peak", F.col("peak") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)).drop("most")


def merged_cues(whistles: DataFrame, surges: DataFrame, window: float = 3.0) -> DataFrame:
    """Whistles and surges as one list of cues (stream_id, t, cue, length, peak); both have stream_id, seq, t, length and peak.

    In time order each whistle takes the first surge within the window that is still free; the two become one
    cue at the earlier time, with the longer length and the higher peak.
    """
    pairs = folds.greedy_match(whistles, surges, window, first_fit=True)
    side = lambda df, p: df.select("stream_id", F.col("seq").alias(f"{p}_seq"), *(F.col(c).alias(f"{p}_{c}") for c in ("t", "length", "peak")))
    both = pairs.join(side(whistles, "truth"), ["stream_id", "truth_seq"]).join(side(surges, "found"), ["stream_id", "found_seq"]).select(
        "stream_id", F.least("truth_t", "found_t").alias("t"), F.lit("whistle_and_surge").alias("cue"), F.greatest("truth_length", "found_length").alias("length"), F.greatest("truth_peak", "found_peak").alias("peak"))
    alone = lambda df, key, cue: df.join(pairs.select("stream_id", F.col(key).alias("seq")), ["stream_id", "seq"], "left_anti").select("stream_id", "t", F.lit(cue).alias("cue"), "length", "peak")
    return both.unionByName(alone(whistles, "truth_seq", "whistle")).unionByName(alone(surges, "found_seq", "energy_surge"))
