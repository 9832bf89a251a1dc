"""Evaluation, routing, places and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bind import TL, micro, table, timeline
from tideline.catalog import query
from tideline.operators import folds
from tideline.plans import evaluate, routing, spatial
from tideline.queries.folding import MATCH
from tideline.queries.joins import MICRO, is_, kind

P6 = "CAST(floor({0} * 1e6 + 0.5) AS BIGINT)"
F1_SQL = "CASE WHEN tp > 0 THEN 2 * (tp / nf::DOUBLE) * (tp / nt::DOUBLE) / (tp / nf::DOUBLE + tp / nt::DOUBLE) ELSE 0 END"


MATCHED = MATCH.format(tl=TL, truth=is_("goal_kick"), found=is_("catch"), tol="30.0", key="abs(y.t - g.t)").rsplit("\nSELECT stream_id, p.a", 1)[0]


@query("precision_recall", MATCHED
 + f""", p AS (SELECT stream_id, unnest(arg_max(ps, i)) AS p FROM r GROUP BY stream_id), t AS (SELECT stream_id, count(*) FILTER ({is_('goal_kick')}) AS nt, count(*) FILTER ({is_('catch')}) AS nf FROM tl GROUP BY stream_id), n AS (SELECT stream_id, count(*) AS tp FROM p GROUP BY stream_id)
SELECT stream_id, nt AS n_true, nf AS n_found, coalesce(tp, 0) AS tp, {P6.format(f'CASE WHEN coalesce(tp, 0) = 0 THEN 0 ELSE {F1_SQL} END')} AS f1_u FROM t LEFT JOIN n USING (stream_id) WHERE nt > 0 OR nf > 0""")
def precision_recall(spark, sf_dir):
    """Precision, recall and F1 of greedy matches, for each stream."""
    tl = timeline(spark, sf_dir)
    truths, found = kind(tl, "goal_kick"), kind(tl, "catch")
    out = evaluate.per_type(truths, found, folds.greedy_match(truths, found, 30.0), by="stream_id")
    return out.select("stream_id", "n_true", "n_found", "tp", micro(F.col("f1")).alias("f1_u"))


GROUPS = {"restarts": ["goal_kick", "corner_kick", "kickoff"], "keeper": ["catch", "goal_kick"]}


@query("group_totals", f"WITH {TL}, c AS (SELECT event_type, count(*) AS nt, count(*) FILTER (confidence >= 0.5) AS tp FROM tl GROUP BY event_type), g AS (SELECT * FROM (VALUES ('restarts', 'goal_kick'), ('restarts', 'corner_kick'), ('restarts', 'kickoff'), ('keeper', 'catch'), ('keeper', 'goal_kick')) AS v(grp, event_type)) SELECT grp, CAST(sum(nt) AS BIGINT) AS n_true, CAST(sum(tp) AS BIGINT) AS tp FROM c JOIN g USING (event_type) GROUP BY grp")
def group_totals(spark, sf_dir):
    """Totals over groups of types that overlap."""
    tl = timeline(spark, sf_dir)
    hit = tl.where("confidence >= 0.5")
    return evaluate.in_groups(evaluate.per_type(tl, tl, hit), GROUPS).select("grp", "n_true", "tp")


THRESHOLDS = [0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


@query("threshold_sweep", f"""WITH {TL}, h AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold), n AS (SELECT event_type, count(*) AS nt FROM tl WHERE seq % 3 = 0 GROUP BY event_type),
s AS (SELECT event_type, threshold, count(*) FILTER (confidence >= threshold) AS kept, count(*) FILTER (confidence >= threshold AND seq % 3 = 0) AS tp FROM tl, h GROUP BY ALL)
SELECT event_type, CAST(threshold * 100 AS INTEGER) AS threshold_pct, kept, tp, {P6.format('CASE WHEN tp = 0 THEN 0 ELSE ' + F1_SQL.replace('nf', 'kept') + ' END')} AS f1_u FROM s JOIN n USING (event_type)""")
def threshold_sweep(spark, sf_dir):
    """Kept rows, hits and F1 of each type at twelve thresholds."""
    rows = timeline(spark, sf_dir).withColumn("hit", F.col("seq") % 3 == 0)
    n = rows.where("hit").groupBy("event_type").agg(F.count("*").alias("n_true"))
    s = evaluate.sweep(rows, THRESHOLDS, n)
    return s.select("event_type", (F.col("threshold") * 100).cast("decimal(9,0)").cast("int").alias("threshold_pct"), "kept", "tp", micro(F.col("f1")).alias("f1_u"))


@query("best_thresholds", f"""WITH {TL}, h AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold), n AS (SELECT event_type, count(*) AS nt FROM tl WHERE seq % 3 = 0 GROUP BY event_type),
s AS (SELECT event_type, threshold, count(*) FILTER (confidence >= threshold) AS kept, count(*) FILTER (confidence >= threshold AND seq % 3 = 0) AS tp FROM tl, h GROUP BY ALL),
f AS (SELECT event_type, threshold, CASE WHEN kept + nt > 0 THEN 2.0 * tp / (kept + nt) ELSE 0 END AS f FROM s JOIN n USING (event_type)) SELECT event_type, {P6.format('max(f)')} AS f1_u FROM f GROUP BY event_type""")
def best_thresholds(spark, sf_dir):
    """The best F1 of each type over all thresholds."""
    rows = timeline(spark, sf_dir).withColumn("hit", F.col("seq") % 3 == 0)
    n = rows.where("hit").groupBy("event_type").agg(F.count("*").alias("n_true"))
    return evaluate.best_threshold(evaluate.sweep(rows, THRESHOLDS, n)).select("event_type", micro(F.col("f1")).alias("f1_u"))


@query("confusion_matrix", "SELECT l.quality AS truth, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS said, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    """Truths against a simple prediction."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("said", (F.col("n_chars") > 1000).cast("int"))
    return evaluate.confusion(d.withColumnRenamed("quality", "truth"), "truth", "said")


@query("label_pivot", f"WITH {TL} SELECT coalesce(stream_id, 'all') AS stream_id, count(*) FILTER (event_type = 'catch') AS catch, count(*) FILTER (event_type = 'kickoff') AS kickoff, count(*) AS total FROM tl GROUP BY ROLLUP (stream_id)")
def label_pivot(spark, sf_dir):
    """Labels of each stream side by side, and a row of totals."""
    out = timeline(spark, sf_dir).rollup("stream_id").agg(F.count_if(F.col("event_type") == "catch").alias("catch"), F.count_if(F.col("event_type") == "kickoff").alias("kickoff"), F.count("*").alias("total"))
    return out.withColumn("stream_id", F.coalesce("stream_id", F.lit("all")))


@query("label_anomalies", f"""WITH {TL}, b AS (SELECT stream_id, event_type, count(*) AS n FROM tl GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY stream_id) AS total FROM b)
SELECT stream_id, event_type, n, n / total > 3 * CASE event_type WHEN 'shot_on_target' THEN 0.05 WHEN 'kickoff' THEN 0.2 ELSE 0.03 END AS anomalous FROM c WHERE total >= 10""")
def label_anomalies(spark, sf_dir):
    """Types that a stream has three times as often as expected."""
    return routing.label_anomalies(timeline(spark, sf_dir), {"shot_on_target": 0.05, "kickoff": 0.2}).select("stream_id", "event_type", "n", "anomalous")


@query("nearest_rank", f"WITH {TL}, l AS (SELECT stream_id, list(confidence ORDER BY confidence) AS v, count(*) AS n FROM tl GROUP BY stream_id) SELECT stream_id, {MICRO.format('v[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1]')} AS p95_u, {MICRO.format('v[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1]')} AS p50_u FROM l")
def nearest_rank(spark, sf_dir):
    """Nearest-rank percentiles."""
    tl = timeline(spark, sf_dir)
    high, middle = (routing.ranked_value(tl, "confidence", p, name=name) for p, name in ((0.95, "high"), (0.5, "middle")))
    return high.join(middle, "stream_id").select("stream_id", micro(F.col("high")).alias("p95_u"), micro(F.col("middle")).alias("p50_u"))


@query("linear_percentile", f"WITH {TL} SELECT event_type, CAST(floor(quantile_cont(confidence, 0.99) * 1e5) AS BIGINT) AS p99_5 FROM tl GROUP BY event_type")
def linear_percentile(spark, sf_dir):
    """Exact interpolated percentiles."""
    return timeline(spark, sf_dir).groupBy("event_type").agg(F.floor(F.percentile("confidence", 0.99) * 1e5).cast("bigint").alias("p99_5"))


ROUTED = f"""WITH {TL}, v AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 'rejected' WHEN seq % 4 = 1 AND seq % 3 = 0 THEN 'uncertain' ELSE 'confirmed' END AS result FROM tl), p AS (SELECT stream_id, list(x::DOUBLE ORDER BY x)[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95 FROM tl GROUP BY stream_id),
f AS (SELECT v.*, result = 'uncertain' AS a, result = 'confirmed' AND confidence < 0.3 AS b0, result = 'confirmed' AND confidence < 0.6 AS b, result = 'confirmed' AND event_type = 'kickoff' AS c, result = 'rejected' AND x > p95 AS d FROM v JOIN p USING (stream_id)), g AS (SELECT *, avg((a OR b OR c OR d)::INTEGER) OVER (PARTITION BY stream_id) AS rate FROM f)"""


@query("escalation", ROUTED + " SELECT stream_id, count(*) FILTER (a OR b OR c OR d OR rate > 0.5) AS escalated, count(*) FILTER (a) AS uncertain, count(*) FILTER (b) AS low, count(*) FILTER (c) AS key_events, count(*) FILTER (d) AS mismatch FROM g GROUP BY stream_id")
def escalation(spark, sf_dir):
    """Rows that go to the second tier, and why."""
    s = F.col("seq")
    rows = timeline(spark, sf_dir).withColumn("result", F.when(s % 4 == 0, "rejected").when((s % 4 == 1) & (s % 3 == 0), "uncertain").otherwise("confirmed")).withColumn("motion", F.col("x").cast("double"))
    has = lambda k: F.count_if(F.array_contains("reasons", k))
    return routing.routed(rows, ["kickoff"]).groupBy("stream_id").agg(F.count_if("escalate").alias("escalated"), has("uncertain").alias("uncertain"), has("low_confidence").alias("low"), has("key_event").alias("key_events"), has("motion_mismatch").alias("mismatch"))


@query("canaries", f"""WITH {TL}, w AS (SELECT stream_id, CASE event_type WHEN 'catch' THEN 'GOAL' WHEN 'kickoff' THEN 'DEAD' ELSE 'PLAY' END AS label FROM tl), n AS (SELECT stream_id, label, count(*) AS n FROM w GROUP BY ALL)
SELECT stream_id, CAST(sum(n) AS BIGINT) AS windows, count(*) AS kinds, max(n) > 0.92 * sum(n) AS one_label, coalesce(sum(n) FILTER (label = 'GOAL'), 0) < 0.03 * sum(n) AS inactive FROM n GROUP BY stream_id""")
def canaries(spark, sf_dir):
    """Alarms of a scan: one label for all, nothing active."""
    w = timeline(spark, sf_dir).withColumn("label", F.when(F.col("event_type") == "catch", "GOAL").when(F.col("event_type") == "kickoff", "DEAD").otherwise("PLAY")).withColumn("latency", F.lit(1.0))
    c = routing.canaries(w)
    return c.select("stream_id", F.col("n").alias("windows"), "kinds", F.array_contains("alarms", "one_label").alias("one_label"), F.array_contains("alarms", "inactive").alias("inactive"))


@query("landmark_gate", f"""WITH {TL} SELECT stream_id, seq, CASE event_type WHEN 'corner_kick' THEN (x <= 0.25 OR x >= 0.75) AND (y <= 0.25 OR y >= 0.75) WHEN 'goal_kick' THEN (x <= 0.2 OR x >= 0.8) AND y >= 0.25 AND y <= 0.75 WHEN 'kickoff' THEN y <= 0.28 OR y >= 0.72 ELSE true END AS fits FROM tl""")
def landmark_gate(spark, sf_dir):
    """Whether restarts happen where they can; kickoffs stand in for throw-ins."""
    k = F.when(F.col("event_type") == "kickoff", "throw_in").otherwise(F.col("event_type"))
    return timeline(spark, sf_dir).select("stream_id", "seq", spatial.landmark(k, F.col("x"), F.col("y")).alias("fits"))


@query("similarity_gate", f"WITH {TL} SELECT stream_id, seq, CASE WHEN event_type IN ('corner_kick', 'goal_kick') THEN true WHEN event_type = 'catch' THEN coalesce(CASE WHEN seq % 10 <> 0 THEN confidence END, 0) >= 0.6 ELSE coalesce(CASE WHEN seq % 10 <> 0 THEN confidence END, 0) >= 0.75 END AS passes FROM tl")
def similarity_gate(spark, sf_dir):
    """The gate on a similarity that may be missing."""
    s = F.when(F.col("seq") % 10 != 0, F.col("confidence"))
    return timeline(spark, sf_dir).select("stream_id", "seq", spatial.similarity_gate(F.col("event_type"), s).alias("passes"))


@query("keeper_sides", f"""WITH {TL}, v AS (SELECT stream_id, count(*) FILTER (t < 3600) AS n1, count(*) FILTER (t < 3600 AND x < 0.5) AS l1, count(*) FILTER (t >= 3600) AS n2, count(*) FILTER (t >= 3600 AND x < 0.5) AS l2 FROM tl WHERE event_type = 'catch' GROUP BY stream_id),
s AS (SELECT *, CASE WHEN n1 < 2 THEN NULL WHEN l1 / n1 >= 0.55 THEN 'left' WHEN (n1 - l1) / n1 >= 0.55 THEN 'right' END AS s1, CASE WHEN n2 < 2 THEN NULL WHEN l2 / n2 >= 0.55 THEN 'left' WHEN (n2 - l2) / n2 >= 0.55 THEN 'right' END AS s2 FROM v)
SELECT stream_id, CASE WHEN s1 = s2 AND n2 > n1 THEN CASE s2 WHEN 'left' THEN 'right' ELSE 'left' END ELSE coalesce(s1, CASE s2 WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' END) END AS first_side,
 CASE WHEN s1 = s2 AND n2 <= n1 THEN CASE s1 WHEN 'left' THEN 'right' ELSE 'left' END ELSE coalesce(s2, CASE s1 WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' END) END AS second_side FROM s""")
def keeper_sides(spark, sf_dir):
    """The keeper's side in each half by vote."""
    return spatial.keeper_sides(kind(timeline(spark, sf_dir), "catch"), F.lit(3600.0))


@query("spread_gate", f"""WITH {TL}, s AS (SELECT user_id, count(*) AS points, greatest(stddev_pop(x), stddev_pop(y)) AS s FROM tl GROUP BY user_id) SELECT user_id, points, CASE WHEN points < 2 THEN 'keep' WHEN s >= 0.08 THEN 'reject' WHEN s <= 0.04 THEN 'keep' ELSE 'keep_unsure' END AS verdict FROM s""")
def spread_gate(spark, sf_dir):
    """How far a track's points spread, and what that means for a kickoff."""
    return spatial.spread(timeline(spark, sf_dir), "user_id").select("user_id", "points", "verdict")


@query("track_velocity", f"""WITH {TL}, d AS (SELECT user_id, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM (SELECT user_id, seq, x::DOUBLE AS x, y::DOUBLE AS y, seq::DOUBLE AS t FROM tl) WINDOW w AS (PARTITION BY user_id ORDER BY t, seq))
SELECT user_id, count(*) AS steps, CAST(floor(sqrt(avg(dx / dt) ** 2 + avg(dy / dt) ** 2) * 1e5) AS BIGINT) AS speed_5 FROM d WHERE dt > 1e-6 GROUP BY user_id""")
def track_velocity(spark, sf_dir):
    """Mean velocity of each track."""
    pts = timeline(spark, sf_dir).select("user_id", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("seq").cast("double").alias("t"))
    return spatial.velocities(pts, "user_id").select("user_id", "steps", F.floor(F.col("speed") * 1e5).cast("bigint").alias("speed_5"))


@query("union_boxes", f"WITH {TL} SELECT stream_id, event_type, {MICRO.format('(max(x + 0.05) - min(x)) * (max(y + 0.1) - min(y))')} AS area_u FROM tl GROUP BY ALL")
def union_boxes(spark, sf_dir):
    """The box around all boxes of a stream and type."""
    b = timeline(spark, sf_dir).withColumn("w", F.lit(0.05)).withColumn("h", F.lit(0.1))
    return spatial.union_box(b, "stream_id", "event_type").select("stream_id", "event_type", micro(F.col("area")).alias("area_u"))


@query("zoom_views", f"""WITH {TL}, v AS (SELECT stream_id, seq, 'wide' AS view, 0 AS wx, 0 AS wy FROM tl UNION ALL SELECT stream_id, seq, 'zoom', greatest(0, least(1280, CAST(floor(x::DOUBLE * 1920 - 320.0) AS INTEGER))), greatest(0, least(720, CAST(floor(y::DOUBLE * 1080 - 180.0) AS INTEGER))) FROM tl WHERE confidence >= 0.5) SELECT * FROM v""")
def zoom_views(spark, sf_dir):
    """Every frame wide, and zoomed in where a ball is seen well enough, inside the frame."""
    z = spatial.zoom_window(F.col("x").cast("double"), F.col("y").cast("double"), 1920, 1080)
    wide = F.struct(F.lit("wide").alias("view"), F.lit(0).alias("wx"), F.lit(0).alias("wy"))
    zoom = F.struct(F.lit("zoom").alias("view"), z["x"].alias("wx"), z["y"].alias("wy"))
    return timeline(spark, sf_dir).select("stream_id", "seq", F.explode(F.array_compact(F.array(wide, F.when(F.col("confidence") >= 0.5, zoom)))).alias("v")).select("stream_id", "seq", "v.*")


@query("match_bounds", f"""WITH {TL}, e AS (SELECT stream_id, min(t) AS a, max(t) AS b FROM tl WHERE {is_('shot_on_target')} GROUP BY stream_id), d AS (SELECT DISTINCT stream_id, t FROM tl WHERE {is_('shot_on_target')}), g AS (SELECT stream_id, t AS s, lead(t) OVER (PARTITION BY stream_id ORDER BY t) AS f FROM d),
m AS (SELECT g.*, row_number() OVER (PARTITION BY g.stream_id ORDER BY f - s DESC, s) AS r FROM g JOIN e USING (stream_id) WHERE f IS NOT NULL AND s >= a + 0.25 * (b - a) AND f <= a + 0.75 * (b - a) AND f - s >= 180)
SELECT e.stream_id, {MICRO.format('a')} AS start_u, {MICRO.format('b')} AS end_u, {MICRO.format('s')} AS half_start_u, {MICRO.format('f')} AS half_end_u FROM e LEFT JOIN m ON m.stream_id = e.stream_id AND r = 1""")
def match_bounds(spark, sf_dir):
    """Start, end and half-time of a match from the gaps between its shots."""
    from tideline.plans.rules import match_bounds as bounds

    b = bounds(kind(timeline(spark, sf_dir), "shot_on_target"))
    return b.select("stream_id", micro(F.col("game_start")).alias("start_u"), micro(F.col("match_end")).alias("end_u"), micro(F.col("half_start")).alias("half_start_u"), micro(F.col("half_end")).alias("half_end_u"))


@query("chance_lift", f"WITH {TL}, r AS (SELECT stream_id, count(*) FILTER ({is_('catch')}) / 7200.0::DOUBLE AS rate FROM tl GROUP BY stream_id) SELECT stream_id, CAST(floor((1 - exp(-rate * 2 * 5.0)) * 1e5) AS BIGINT) AS chance_5 FROM r")
def chance_lift(spark, sf_dir):
    """The share of truths that cues meet by chance."""
    r = timeline(spark, sf_dir).groupBy("stream_id").agg((F.count_if(F.col("event_type") == "catch") / 7200.0).alias("rate"))
    return r.select("stream_id", F.floor(evaluate.chance(F.col("rate"), 5.0) * 1e5).cast("bigint").alias("chance_5"))


@query("split_assignment", f"WITH {TL} SELECT stream_id, seq, event_type, r <= 30 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, event_type ORDER BY seq * 7919 % 10007, seq) AS r FROM tl)")
def split_assignment(spark, sf_dir):
    """A cap for each class in a fixed pseudo-random order."""
    from pyspark.sql import Window as W

    w = W.partitionBy("stream_id", "event_type").orderBy(F.col("seq") * 7919 % 10007, "seq")
    return timeline(spark, sf_dir).select("stream_id", "seq", "event_type", (F.row_number().over(w) <= 30).alias("kept"))


@query("negative_quota", f"WITH {TL}, n AS (SELECT count(*) AS total, count(DISTINCT stream_id) AS games FROM tl) SELECT CAST(floor(0.42 * greatest(total, 5000)) AS BIGINT) AS negatives, CAST(floor(0.42 * greatest(total, 5000) / games) AS BIGINT) AS per_game FROM n")
def negative_quota(spark, sf_dir):
    """How many negatives a training set takes, in all and from each game."""
    n = timeline(spark, sf_dir).agg(F.count("*").alias("total"), F.count_distinct("stream_id").alias("games"))
    q = 0.42 * F.greatest("total", F.lit(5000))
    return n.select(F.floor(q).cast("bigint").alias("negatives"), F.floor(q / F.col("games")).cast("bigint").alias("per_game"))


@query("window_targets", f"""WITH {TL}, e AS (SELECT stream_id, max(t) AS d FROM tl GROUP BY stream_id), w AS (SELECT stream_id, k, greatest(0.0, k * 60.0) AS a, least(d, k * 60.0 + 15.0) AS b FROM e, LATERAL (SELECT unnest(range(0, CAST(ceil(d / 60.0) AS BIGINT))) AS k))
SELECT w.stream_id, w.k AS window_no, coalesce(string_agg(tl.event_type, ',' ORDER BY tl.t, tl.seq), 'none') AS target FROM w LEFT JOIN tl ON tl.stream_id = w.stream_id AND tl.event_type IN ('catch', 'kickoff') AND t >= a AND t <= b GROUP BY ALL""")
def window_targets(spark, sf_dir):
    """What a model should say of each window: the labels inside, or none."""
    from tideline.operators import timeline as tm

    tl = timeline(spark, sf_dir)
    w = tm.sliding_windows(tl.groupBy("stream_id").agg(F.max("t").alias("duration")), 60.0, 15.0, centred=False)
    hits = tm.containing(kind(tl, "catch", "kickoff").select("stream_id", "t", "seq", "event_type"), w).groupBy("stream_id", "window_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "seq", "event_type"))), lambda x: x["event_type"]), ",").alias("target"))
    return w.join(hits, ["stream_id", "window_no"], "left").select("stream_id", F.col("window_no").cast("bigint").alias("window_no"), F.coalesce("target", F.lit("none")).alias("target"))
