"""Windows, runs, sessions and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bind import TL, micro, timeline
from tideline.catalog import query
from tideline.operators import timeline as tm
from tideline.queries.joins import MICRO, is_, kind

W_ALL = "PARTITION BY stream_id ORDER BY t, seq"


@query("adaptive_threshold", f"""WITH {TL}, g AS (SELECT *, avg(confidence) OVER (PARTITION BY stream_id) AS gm,
 avg(confidence) OVER ({W_ALL} ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING) AS lm, stddev_pop(confidence) OVER ({W_ALL} ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING) AS ls FROM tl)
SELECT stream_id, seq, CAST(floor(greatest(lm + 0.7 * ls, 0.8 * gm) * 1e6) AS BIGINT) AS threshold_u FROM g""")
def adaptive_threshold(spark, sf_dir):
    """Local mean plus 0.7 deviations over 60 rows on each side, at least 0.8 of the stream's mean."""
    from tideline.plans.signals import adaptive

    return adaptive(timeline(spark, sf_dir), "confidence", 60).select("stream_id", "seq", F.floor(F.col("threshold") * 1e6).cast("bigint").alias("threshold_u"))


@query("moving_average", f"WITH {TL} SELECT stream_id, seq, CAST(floor(avg(confidence) OVER ({W_ALL} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) * 1e6) AS BIGINT) AS mean_u FROM tl")
def moving_average(spark, sf_dir):
    """Centred mean over five samples, cut at the ends."""
    return tm.rolling(timeline(spark, sf_dir), "confidence", 2).select("stream_id", "seq", F.floor(F.col("local_mean") * 1e6).cast("bigint").alias("mean_u"))


@query("padded_zscore", f"""WITH {TL}, m AS (SELECT *, sum(confidence) OVER w / 20 AS m, sum(confidence * confidence) OVER w / 20 AS q FROM tl WINDOW w AS ({W_ALL} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
SELECT stream_id, seq, (confidence - m) / greatest(sqrt(greatest(q - m * m, 0.0)), 1e-8) > 1.5 AS peak FROM m""")
def padded_zscore(spark, sf_dir):
    """Samples over 1.5 rolling deviations, where the windows are padded with zeros and always divide by their length."""
    d = tm.rolling_padded(timeline(spark, sf_dir), "confidence", 20)
    z = (F.col("confidence") - F.col("pad_mean")) / F.greatest(F.col("pad_std"), F.lit(1e-8))
    return d.select("stream_id", "seq", (z > 1.5).alias("peak"))


@query("global_threshold", f"""WITH {TL}, n AS (SELECT *, confidence / max(confidence) OVER p AS v FROM tl WINDOW p AS (PARTITION BY stream_id)),
s AS (SELECT stream_id, median(v) + 1.2 * stddev_pop(v) AS h FROM n GROUP BY stream_id) SELECT n.stream_id, count(*) AS above FROM n JOIN s USING (stream_id) WHERE v > h GROUP BY n.stream_id""")
def global_threshold(spark, sf_dir):
    """Samples, in units of the stream's largest, over its median plus 1.2 deviations."""
    from tideline.plans.signals import over_median

    return over_median(timeline(spark, sf_dir), "confidence", 1.2).groupBy("stream_id").agg(F.count("*").alias("above"))


@query("consecutive_gaps", f"WITH {TL}, d AS (SELECT DISTINCT stream_id, t FROM tl), g AS (SELECT stream_id, t, lead(t) OVER (PARTITION BY stream_id ORDER BY t) - t AS gap FROM d) SELECT stream_id, count(*) AS gaps, {MICRO.format('max(gap)')} AS longest_u FROM g WHERE gap IS NOT NULL GROUP BY stream_id")
def consecutive_gaps(spark, sf_dir):
    """Gaps between neighbouring distinct times."""
    g = tm.gaps(timeline(spark, sf_dir)).withColumn("gap", F.col("gap_end") - F.col("gap_start"))
    return g.groupBy("stream_id").agg(F.count("*").alias("gaps"), micro(F.max("gap")).alias("longest_u"))


RUNS = f"""WITH {TL}, f AS (SELECT *, confidence >= 0.5 AS f, lead(t) OVER w AS nt FROM tl WINDOW w AS ({W_ALL})),
n AS (SELECT *, sum(CASE WHEN f IS DISTINCT FROM pf THEN 1 ELSE 0 END) OVER ({W_ALL}) AS i FROM (SELECT *, lag(f) OVER ({W_ALL}) AS pf FROM f))
SELECT stream_id, {MICRO.format('min(t)')} AS start_u, {MICRO.format('coalesce(arg_max(nt, t), max(t))')} AS end_u, count(*) AS samples, {MICRO.format('max(confidence)')} AS peak_u, arg_max(seq, confidence) AS first_peak
FROM n WHERE f GROUP BY stream_id, i"""


@query("spike_runs", RUNS.replace(", arg_max(seq, confidence) AS first_peak", "").replace("coalesce(arg_max(nt, t), max(t))", "coalesce(max(nt), max(t))"))
def spike_runs(spark, sf_dir):
    """Runs of samples at or above a threshold, from the first to the first below."""
    r = tm.runs_above(timeline(spark, sf_dir), F.col("confidence"), F.lit(0.5))
    return r.select("stream_id", micro(F.col("start")).alias("start_u"), micro(F.col("end")).alias("end_u"), "samples", micro(F.col("peak")).alias("peak_u"))


@query("burst_sessions", f"""WITH {TL}, k AS (SELECT * FROM tl WHERE confidence >= 0.5), s AS (SELECT *, sum(CASE WHEN t - pt > 5.0 THEN 1 ELSE 0 END) OVER ({W_ALL}) AS s FROM (SELECT *, lag(t) OVER ({W_ALL}) AS pt FROM k))
SELECT stream_id, {MICRO.format('min(t)')} AS start_u, count(*) AS samples, {MICRO.format('(min(t) + max(t)) / 2')} AS centre_u FROM s GROUP BY stream_id, s HAVING max(t) - min(t) >= 2.0 AND max(t) - min(t) <= 120.0""")
def burst_sessions(spark, sf_dir):
    """Bursts of loud samples bridging gaps of 5 s, kept if 2 to 120 s long."""
    from tideline.plans.signals import bursts

    b = bursts(timeline(spark, sf_dir), F.col("confidence") >= 0.5, 5.0, 2.0, 120.0)
    return b.select("stream_id", micro(F.col("start")).alias("start_u"), "samples", micro(F.col("centre")).alias("centre_u"))


@query("label_regions", f"""WITH {TL}, n AS (SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM pe THEN 1 ELSE 0 END) OVER ({W_ALL}) AS i FROM (SELECT *, lag(event_type) OVER ({W_ALL}) AS pe FROM tl))
SELECT stream_id, event_type, {MICRO.format('(min(t) + max(t)) / 2')} AS centre_u, count(*) AS samples FROM n WHERE event_type IN ('catch', 'kickoff') GROUP BY stream_id, i, event_type""")
def label_regions(spark, sf_dir):
    """Runs of equal labels among the wanted ones, and their centres."""
    runs = tm.islands(timeline(spark, sf_dir), F.col("event_type"))
    r = kind(runs, "catch", "kickoff").groupBy("stream_id", "island", "event_type").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("samples"))
    return r.select("stream_id", "event_type", micro((F.col("a") + F.col("b")) / 2).alias("centre_u"), "samples")


@query("dead_run_set_pieces", f"""WITH {TL}, d AS (SELECT *, event_type = 'corner_kick' AS dead FROM tl), n AS (SELECT *, sum(CASE WHEN dead IS DISTINCT FROM pd THEN 1 ELSE 0 END) OVER ({W_ALL}) AS i FROM (SELECT *, lag(dead) OVER ({W_ALL}) AS pd FROM d)),
r AS (SELECT stream_id, i, dead, min(t) AS a, count(*) AS n, arg_min(t, (t, seq)) AS first_t FROM n GROUP BY stream_id, i, dead), x AS (SELECT *, lead(first_t) OVER (PARTITION BY stream_id ORDER BY i) AS nt FROM r)
SELECT stream_id, {MICRO.format('a')} AS start_u, {MICRO.format('nt')} AS end_u, n AS dead_samples FROM x WHERE dead AND n >= 2 AND nt IS NOT NULL""")
def dead_run_set_pieces(spark, sf_dir):
    """Dead runs of two or more before live play: set pieces from the run's start to the live sample."""
    from tideline.plans.signals import dead_runs

    d = dead_runs(timeline(spark, sf_dir).withColumn("dead", F.col("event_type") == "corner_kick"), 2)
    return d.select("stream_id", micro(F.col("start")).alias("start_u"), micro(F.col("end")).alias("end_u"), F.col("dead_samples"))


@query("time_bins_best", f"""WITH {TL}, b AS (SELECT *, CASE WHEN hi > lo THEN least(CAST(floor((t - lo) / ((hi - lo) / 40)) AS INTEGER), 39) ELSE 0 END AS bin FROM (SELECT *, min(t) OVER p AS lo, max(t) OVER p AS hi FROM tl WINDOW p AS (PARTITION BY stream_id)))
SELECT stream_id, bin, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, bin ORDER BY confidence DESC, t, seq) AS r FROM b) WHERE r = 1""")
def time_bins_best(spark, sf_dir):
    """The most confident row of each of 40 stretches: the cap on candidates."""
    return tm.time_bins(timeline(spark, sf_dir), 40, F.desc("confidence")).select("stream_id", "bin", "seq")


@query("gap_midpoints", f"""WITH {TL}, h AS (SELECT *, t < 3600 AS first_half FROM tl), g AS (SELECT *, lead(t) OVER (PARTITION BY stream_id, first_half ORDER BY t, seq) AS nt FROM h)
SELECT stream_id, seq, {MICRO.format('(t + nt) / 2')} AS mid_u FROM g WHERE nt - t > 60""")
def gap_midpoints(spark, sf_dir):
    """Midpoints of gaps over 60 s within a half: places that surely show nothing."""
    h = timeline(spark, sf_dir).withColumn("first_half", F.col("t") < 3600)
    return tm.scan(h, ("stream_id", "first_half"), after={"nt": F.col("t")}).where(F.col("nt") - F.col("t") > 60).select("stream_id", "seq", micro((F.col("t") + F.col("nt")) / 2).alias("mid_u"))


@query("longest_low_run", f"""WITH {TL}, e AS (SELECT *, confidence < 0.6 AS low, min(t) OVER p AS a, max(t) OVER p AS b FROM tl WINDOW p AS (PARTITION BY stream_id)), m AS (SELECT * FROM e WHERE t >= a + 0.2 * (b - a) AND t <= a + 0.8 * (b - a)),
n AS (SELECT *, sum(CASE WHEN low IS DISTINCT FROM pl THEN 1 ELSE 0 END) OVER ({W_ALL}) AS i FROM (SELECT *, lag(low) OVER ({W_ALL}) AS pl FROM m)), r AS (SELECT stream_id, min(t) AS s, max(t) AS f, count(*) AS n FROM n WHERE low GROUP BY stream_id, i)
SELECT stream_id, {MICRO.format('s')} AS start_u, {MICRO.format('f')} AS end_u, n AS samples FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, s) AS k FROM r) WHERE k = 1""")
def longest_low_run(spark, sf_dir):
    """The longest low run in the middle three fifths: half-time by its quiet; the first of equals."""
    from tideline.plans.signals import longest_low

    r = longest_low(timeline(spark, sf_dir), F.col("confidence") < 0.6, 0.2, 0.8)
    return r.select("stream_id", micro(F.col("start")).alias("start_u"), micro(F.col("end")).alias("end_u"), "samples")


@query("first_active_stretch", f"""WITH {TL}, q AS (SELECT *, min(confidence) OVER ({W_ALL} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m, count(*) OVER ({W_ALL} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM tl)
SELECT stream_id, min(seq) AS seq FROM q WHERE n = 4 AND m > 0.3 GROUP BY stream_id""")
def first_active_stretch(spark, sf_dir):
    """Where the first four high samples in a row begin: kickoff by its motion."""
    rows, block = tm.in_blocks(timeline(spark, sf_dir), 3, ("stream_id",))
    w = block.rowsBetween(0, 3)
    q = tm.own(rows.withColumn("m", F.min("confidence").over(w)).withColumn("n", F.count("*").over(w)))
    return q.where((F.col("n") == 4) & (F.col("m") > 0.3)).groupBy("stream_id").agg(F.min("seq").alias("seq"))


@query("gap_spot_checks", f"""WITH {TL}, d AS (SELECT DISTINCT stream_id, t FROM tl), g AS (SELECT stream_id, t AS a, lead(t) OVER (PARTITION BY stream_id ORDER BY t) AS b FROM d),
p AS (SELECT stream_id, a, b, a + k * 45.0 AS t FROM (SELECT *, unnest(range(1, 200)) AS k FROM g WHERE b - a >= 90.0) WHERE a + k * 45.0 < b - 10)
SELECT stream_id, {MICRO.format('t')} AS t_u FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS r FROM p) WHERE r <= 30""")
def gap_spot_checks(spark, sf_dir):
    """Probes every 45 s in gaps of 90 s and more, the first 30 of a stream."""
    return tm.gap_probes(timeline(spark, sf_dir), 90.0, None, 45.0, 10.0, 30).select("stream_id", micro(F.col("t")).alias("t_u"))


@query("corner_gap_probes", f"""WITH {TL}, d AS (SELECT DISTINCT stream_id, t FROM tl WHERE {is_('shot_on_target')}), g AS (SELECT stream_id, t AS a, lead(t) OVER (PARTITION BY stream_id ORDER BY t) AS b FROM d),
p AS (SELECT stream_id, a, b, a + k * 60.0 AS t FROM (SELECT *, unnest(range(1, 20)) AS k FROM g WHERE b - a >= 150.0 AND b - a <= 600.0) WHERE a + k * 60.0 < b - 10)
SELECT stream_id, {MICRO.format('t')} AS t_u FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS r FROM p) WHERE r <= 20""")
def corner_gap_probes(spark, sf_dir):
    """Probes every 60 s in gaps of 150 to 600 s between shots, the first 20 of a stream."""
    return tm.gap_probes(kind(timeline(spark, sf_dir), "shot_on_target"), 150.0, 600.0, 60.0, 10.0, 20).select("stream_id", micro(F.col("t")).alias("t_u"))


@query("offset_probes", f"WITH {TL}, e AS (SELECT stream_id, max(t) AS d FROM tl GROUP BY stream_id) SELECT stream_id, seq, {MICRO.format('p')} AS probe_u FROM (SELECT tl.stream_id, seq, d, unnest([t + 30.0, t + 45.0, t + 60.0, t + 75.0, t + 90.0]) AS p FROM tl JOIN e USING (stream_id) WHERE event_type = 'shot_on_target') WHERE p <= d")
def offset_probes(spark, sf_dir):
    """Probes at fixed offsets after each shot, inside the stream."""
    from tideline.plans.rules import KICKOFF_PROBES

    tl = timeline(spark, sf_dir)
    ends = tl.groupBy("stream_id").agg(F.max("t").alias("d"))
    return tm.offset_probes(kind(tl, "shot_on_target").join(ends, "stream_id"), KICKOFF_PROBES, F.col("d")).select("stream_id", "seq", micro(F.col("probe")).alias("probe_u"))


@query("sliding_windows", f"""WITH {TL}, e AS (SELECT stream_id, max(t) AS d FROM tl GROUP BY stream_id) SELECT stream_id, k AS window_no, {MICRO.format('greatest(0.0, k * 10.0 - 2.5)')} AS start_u, {MICRO.format('least(d, greatest(0.0, k * 10.0 - 2.5) + 15.0)')} AS end_u FROM e, LATERAL (SELECT unnest(range(0, CAST(ceil(d / 10.0) AS BIGINT))) AS k)""")
def sliding_windows(spark, sf_dir):
    """Centred windows of 15 s every 10 s."""
    extent = timeline(spark, sf_dir).groupBy("stream_id").agg(F.max("t").alias("duration"))
    w = tm.sliding_windows(extent, 10.0, 15.0)
    return w.select("stream_id", F.col("window_no").cast("bigint").alias("window_no"), micro(F.col("window_start")).alias("start_u"), micro(F.col("window_end")).alias("end_u"))


@query("uniform_subsample", f"""WITH {TL}, n AS (SELECT *, row_number() OVER ({W_ALL}) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM tl)
SELECT stream_id, seq FROM n WHERE list_contains([CAST(floor(k * n / 24.0) AS BIGINT) for k in range(0, 24)], i)""")
def uniform_subsample(spark, sf_dir):
    """24 rows of each stream at equal index distances."""
    rows = timeline(spark, sf_dir).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq"))).alias("rows"))
    picked = F.transform(tm.uniform_indices(24, F.size("rows")), lambda i: F.get("rows", i)["seq"])
    return rows.select("stream_id", F.explode(picked).alias("seq"))


@query("frame_times", f"""WITH {TL} SELECT stream_id, seq, {MICRO.format('p')} AS frame_u FROM (SELECT stream_id, seq, t, unnest([greatest(0.0, t - 6.0) + 3.0 * k for k in range(0, 6)]) AS p FROM tl WHERE event_type = 'kickoff') WHERE p <= t + 6.0""")
def frame_times(spark, sf_dir):
    """Frame times every 3 s around each kickoff, ends included and cut at 0."""
    a = F.greatest(F.lit(0.0), F.col("t") - 6.0)
    k = kind(timeline(spark, sf_dir), "kickoff").withColumn("frame", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: a + 3.0 * i)))
    return k.where(F.col("frame") <= F.col("t") + 6.0).select("stream_id", "seq", micro(F.col("frame")).alias("frame_u"))


@query("priority_cap", f"""WITH {TL} SELECT stream_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY CASE event_type WHEN 'kickoff' THEN 0 WHEN 'catch' THEN 1 ELSE 2 END, t, seq) AS r FROM tl) WHERE r <= 50""")
def priority_cap(spark, sf_dir):
    """The first 50 candidates of a stream by label priority, then time."""
    from pyspark.sql import Window as W

    from tideline.plans.rules import looked_up

    rank = looked_up(F.col("event_type"), {"kickoff": 0, "catch": 1}, 2)
    return timeline(spark, sf_dir).withColumn("r", F.row_number().over(W.partitionBy("stream_id").orderBy(rank, "t", "seq"))).where("r <= 50").select("stream_id", "seq")


@query("probe_windows", f"""WITH {TL}, w AS (SELECT stream_id, seq, CASE WHEN seq % 3 = 0 THEN greatest(0.0, t - 12.0) ELSE greatest(0.0, t - 5.0) END AS a, CASE WHEN seq % 3 = 0 THEN t ELSE t + 15.0 END AS b FROM tl)
SELECT stream_id, seq, {MICRO.format('CASE WHEN b - a > 12 THEN greatest(0.0, (a + b) / 2 - 6) ELSE a END')} AS start_u, {MICRO.format('CASE WHEN b - a > 12 THEN greatest(0.0, (a + b) / 2 - 6) + 12 ELSE b END')} AS end_u FROM w""")
def probe_windows(spark, sf_dir):
    """What a model sees of a candidate: 12 s before a whistle, else its clip, cut to 12 s around the middle."""
    from tideline.plans.signals import probe_window

    w = timeline(spark, sf_dir).withColumn("w", probe_window(F.col("t"), F.when(F.col("seq") % 3 == 0, F.col("t")), F.greatest(F.lit(0.0), F.col("t") - 5.0), F.col("t") + 15.0))
    return w.select("stream_id", "seq", micro(F.col("w.start")).alias("start_u"), micro(F.col("w.end")).alias("end_u"))


SPLIT = f"""WITH RECURSIVE {TL}, f AS (SELECT stream_id, seq, t, floor(t / 10) * 10 AS a, floor(t / 10) * 10 + 10 AS b, CAST(floor(t / 1200) AS BIGINT) AS zone, event_type AS label FROM tl),
g AS (SELECT *, row_number() OVER w AS i, a - lag(b) OVER w AS gap, coalesce(a - lag(b) OVER w > 40 OR zone <> lag(zone) OVER w, true) AS new FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY t, seq)),
r AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY stream_id ORDER BY i) AS run FROM g),
p AS (SELECT stream_id, min(i) AS lo, max(i) AS hi FROM r GROUP BY stream_id, run UNION ALL
 SELECT stream_id, unnest([lo, c]) AS lo, unnest([c - 1, hi]) AS hi FROM (SELECT p.stream_id, lo, hi, arg_max(i, (gap, -i)) AS c FROM p JOIN r ON r.stream_id = p.stream_id AND i > lo AND i <= hi GROUP BY p.stream_id, lo, hi HAVING
  max(CASE WHEN i = hi THEN b END) + 3 - greatest(0, (SELECT any_value(a) FROM r z WHERE z.stream_id = p.stream_id AND z.i = lo) - 3) > 90)),
o AS (SELECT p.stream_id, lo, hi, arg_min(a, i) AS a, arg_max(b, i) AS b, count(*) AS n, list_sort(list_distinct(list(label))) AS labels FROM p JOIN r ON r.stream_id = p.stream_id AND i BETWEEN lo AND hi GROUP BY p.stream_id, lo, hi)
SELECT stream_id, {MICRO.format('greatest(0, a - 3)')} AS start_u, {MICRO.format('(b + 3)')} AS end_u, array_to_string(labels, ',') AS labels, n AS flags FROM o WHERE n = 1 OR b + 3 - greatest(0, a - 3) <= 90"""


@query("flag_windows", SPLIT)
def flag_windows(spark, sf_dir):
    """Flags of ten seconds merged into windows, and these split at their largest gaps until they fit."""
    from tideline.plans.signals import flag_windows as merged

    start = F.floor(F.col("t") / 10) * 10.0
    rows = timeline(spark, sf_dir).select("stream_id", "seq", "t", F.col("event_type").alias("label"), F.floor(F.col("t") / 1200).alias("zone"), start.alias("start"), (start + 10).alias("end"))
    out = merged(rows, 40.0, 3.0, 90.0)
    return out.select("stream_id", micro(F.col("start")).alias("start_u"), micro(F.col("end")).alias("end_u"), F.array_join("labels", ",").alias("labels"), F.col("n_flags").cast("bigint").alias("flags"))
