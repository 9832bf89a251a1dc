"""Order-dependent decisions: clusters, deduplication, merged clips, promotion, greedy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bind import TL, micro, timeline
from tideline.catalog import query
from tideline.operators import folds
from tideline.queries.joins import MICRO, is_, kind

PRIORITY_SQL = "CASE {0} WHEN 'shot_on_target' THEN 4 WHEN 'catch' THEN 5 WHEN 'corner_kick' THEN 2 WHEN 'goal_kick' THEN 2 ELSE 0 END"
RELATED_SQL = "CASE {0} WHEN 'shot_on_target' THEN 'shot' WHEN 'catch' THEN 'shot' WHEN 'corner_kick' THEN 'restart' WHEN 'goal_kick' THEN 'restart' END"


@query("cluster_best", f"""WITH {TL}, s AS (SELECT *, sum(CASE WHEN t - pt > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, event_type ORDER BY t, seq) AS s FROM (SELECT *, lag(t) OVER (PARTITION BY stream_id, event_type ORDER BY t, seq) AS pt FROM tl))
SELECT stream_id, event_type, n AS cluster_size, {MICRO.format('span')} AS span_u, seq FROM (SELECT *, count(*) OVER p AS n, max(t) OVER p - min(t) OVER p AS span, row_number() OVER (PARTITION BY stream_id, event_type, s ORDER BY confidence DESC, t, seq) AS r FROM s WINDOW p AS (PARTITION BY stream_id, event_type, s)) WHERE r = 1""")
def cluster_best(spark, sf_dir):
    """Chains of one type at most 30 s apart, each as its most confident row."""
    c = folds.cluster_best(timeline(spark, sf_dir), 30.0, ["t", "seq", "confidence"])
    return c.select("stream_id", "event_type", "cluster_size", micro(F.col("cluster_span")).alias("span_u"), "seq")


def _dedup_sql(same: str, better: str, source: str = "tl") -> str:
    return f"""SELECT stream_id, unnest(list_reduce(list([{{'t': t, 'seq': seq, 'e': event_type, 'c': confidence}}] ORDER BY t, seq), lambda acc, x:
 CASE WHEN {same} AND x[1].t - acc[-1].t < 15 THEN CASE WHEN {better} THEN acc[1:len(acc) - 1] || x ELSE acc END ELSE acc || x END)) AS k FROM {source} GROUP BY stream_id"""


@query("two_pass_dedup", f"""WITH {TL}, one AS ({_dedup_sql('x[1].e = acc[-1].e', 'x[1].c > acc[-1].c')}), mid AS (SELECT stream_id, k.t AS t, k.seq AS seq, k.e AS event_type, k.c AS confidence FROM one),
two AS ({_dedup_sql(f"coalesce({RELATED_SQL.format('x[1].e')} = {RELATED_SQL.format('acc[-1].e')}, false)", f"{PRIORITY_SQL.format('x[1].e')} > {PRIORITY_SQL.format('acc[-1].e')}", 'mid')})
SELECT stream_id, k.seq AS seq, k.e AS event_type FROM two""")
def two_pass_dedup(spark, sf_dir):
    """Events closer than 15 s to the last kept one: equal types by confidence, then related types by priority."""
    from tideline.plans.rules import deduplicated

    return deduplicated(timeline(spark, sf_dir), ["t", "seq", "event_type", "confidence"]).select("stream_id", "seq", "event_type")


@query("spike_merge", f"""WITH {TL}, k AS (SELECT stream_id, unnest(list_reduce(list([{{'t': t, 'seq': seq, 'c': confidence, 'a': greatest(0.0, t - 5.0), 'b': t + 5.0}}] ORDER BY t, seq), lambda acc, x:
 CASE WHEN x[1].t - acc[-1].t < 8 THEN acc[1:len(acc) - 1] || [CASE WHEN x[1].c > acc[-1].c THEN {{'t': x[1].t, 'seq': x[1].seq, 'c': x[1].c, 'a': least(x[1].a, acc[-1].a), 'b': greatest(x[1].b, acc[-1].b)}}
  ELSE {{'t': acc[-1].t, 'seq': acc[-1].seq, 'c': acc[-1].c, 'a': least(x[1].a, acc[-1].a), 'b': greatest(x[1].b, acc[-1].b)}} END] ELSE acc || x END)) AS k FROM tl GROUP BY stream_id)
SELECT stream_id, k.seq AS seq, {MICRO.format('k.a')} AS start_u, {MICRO.format('k.b')} AS end_u FROM k""")
def spike_merge(spark, sf_dir):
    """Candidates within 8 s of the kept one merge; the more confident time stays and the clip widens."""
    from tideline.plans.signals import merge_spikes

    tl = timeline(spark, sf_dir).withColumn("clip_start", F.greatest(F.lit(0.0), F.col("t") - 5.0)).withColumn("clip_end", F.col("t") + 5.0)
    return merge_spikes(tl).select("stream_id", "seq", micro(F.col("clip_start")).alias("start_u"), micro(F.col("clip_end")).alias("end_u"))


@query("surge_merge", f"""WITH {TL}, k AS (SELECT stream_id, unnest(list_reduce(list([{{'t': t, 'seq': seq, 'd': confidence * 4, 'a': y}}] ORDER BY t, seq), lambda acc, x:
 CASE WHEN x[1].t - acc[-1].t < 3 THEN acc[1:len(acc) - 1] || [{{'t': acc[-1].t, 'seq': acc[-1].seq, 'd': greatest(acc[-1].d, x[1].t + x[1].d - acc[-1].t), 'a': greatest(acc[-1].a, x[1].a)}}] ELSE acc || x END)) AS k FROM tl GROUP BY stream_id)
SELECT stream_id, k.seq AS seq, {MICRO.format('k.d')} AS duration_u, {MICRO.format('k.a')} AS amplitude_u FROM k""")
def surge_merge(spark, sf_dir):
    """Surges within 3 s of the kept one extend it."""
    from tideline.plans.signals import merge_surges

    tl = timeline(spark, sf_dir).withColumn("duration", F.col("confidence") * 4).withColumn("amplitude", F.col("y").cast("double"))
    return merge_surges(tl).select("stream_id", "seq", micro(F.col("duration")).alias("duration_u"), micro(F.col("amplitude")).alias("amplitude_u"))


CLIPS = """c AS (SELECT stream_id, seq, event_type, confidence, greatest(0.0, t - 3.0) AS a, t + 5.0 AS b FROM tl WHERE event_type IN ('shot_on_target', 'corner_kick'))"""


@query("clip_merge", f"""WITH {TL}, {CLIPS}, k AS (SELECT stream_id, unnest(list_reduce(list([{{'a': a, 'b': b, 'n': 1}}] ORDER BY a, seq), lambda acc, x:
 CASE WHEN x[1].a - acc[-1].b <= 2 THEN CASE WHEN greatest(acc[-1].b, x[1].b) - acc[-1].a <= 25 THEN acc[1:len(acc) - 1] || [{{'a': acc[-1].a, 'b': greatest(acc[-1].b, x[1].b), 'n': acc[-1].n + 1}}]
  WHEN x[1].b <= greatest(x[1].a, acc[-1].b) THEN acc ELSE acc || [{{'a': greatest(x[1].a, acc[-1].b), 'b': x[1].b, 'n': 1}}] END ELSE acc || x END)) AS k FROM c GROUP BY stream_id)
SELECT stream_id, {MICRO.format('k.a')} AS start_u, {MICRO.format('k.b')} AS end_u, k.n AS events FROM k""")
def clip_merge(spark, sf_dir):
    """Clips around shots and corners, merged over gaps of 2 s unless the result were longer than 25 s."""
    tl = kind(timeline(spark, sf_dir), "shot_on_target", "corner_kick")
    c = tl.withColumn("start", F.greatest(F.lit(0.0), F.col("t") - 3.0)).withColumn("end", F.col("t") + 5.0)
    m = folds.capped_merge(c, 2.0, F.lit(25.0))
    return m.select("stream_id", micro(F.col("start")).alias("start_u"), micro(F.col("end")).alias("end_u"), F.size("members").alias("events"))


@query("boundary_clips", f"""WITH {TL}, c AS (SELECT stream_id, seq, greatest(0.0, t - 4.0) AS a, t + 4.0 AS b FROM tl WHERE event_type = 'catch' OR event_type = 'goal_kick'), k AS (SELECT stream_id, unnest(list_reduce(list([{{'a': a, 'b': b, 'n': 1}}] ORDER BY a, seq), lambda acc, x:
 CASE WHEN x[1].a - acc[-1].b <= 3 THEN CASE WHEN greatest(acc[-1].b, x[1].b) - acc[-1].a <= 90 THEN acc[1:len(acc) - 1] || [{{'a': acc[-1].a, 'b': greatest(acc[-1].b, x[1].b), 'n': acc[-1].n + 1}}]
  WHEN x[1].b <= greatest(x[1].a, acc[-1].b) THEN acc ELSE acc || [{{'a': greatest(x[1].a, acc[-1].b), 'b': x[1].b, 'n': 1}}] END ELSE acc || x END)) AS k FROM c GROUP BY stream_id)
SELECT stream_id, {MICRO.format('k.a')} AS start_u, {MICRO.format('k.b')} AS end_u, k.n AS events FROM k""")
def boundary_clips(spark, sf_dir):
    """Clips of detected boundaries, merged over gaps of 3 s up to 90 s."""
    tl = kind(timeline(spark, sf_dir), "catch", "goal_kick")
    c = tl.withColumn("start", F.greatest(F.lit(0.0), F.col("t") - 4.0)).withColumn("end", F.col("t") + 4.0)
    m = folds.capped_merge(c, 3.0, F.lit(90.0))
    return m.select("stream_id", micro(F.col("start")).alias("start_u"), micro(F.col("end")).alias("end_u"), F.size("members").alias("events"))


@query("overlap_suppression", f"""WITH {TL}, {CLIPS}, o AS (SELECT *, 1 + seq % 3 AS n FROM c),
k AS (SELECT stream_id, unnest(list_reduce(list([{{'a': a, 'b': b, 'seq': seq}}] ORDER BY n DESC, a, seq), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: CASE WHEN (y.b - y.a) + (x[1].b - x[1].a) - greatest(0.0, least(y.b, x[1].b) - greatest(y.a, x[1].a)) > 0
 THEN greatest(0.0, least(y.b, x[1].b) - greatest(y.a, x[1].a)) / ((y.b - y.a) + (x[1].b - x[1].a) - greatest(0.0, least(y.b, x[1].b) - greatest(y.a, x[1].a))) ELSE 0 END >= 0.3)) > 0 THEN acc ELSE acc || x END)) AS k FROM o GROUP BY stream_id)
SELECT stream_id, k.seq AS seq FROM k""")
def overlap_suppression(spark, sf_dir):
    """Clips in order of their events, each kept unless it overlaps a kept one by 0.3 or more."""
    tl = kind(timeline(spark, sf_dir), "shot_on_target", "corner_kick")
    c = tl.withColumn("start", F.greatest(F.lit(0.0), F.col("t") - 3.0)).withColumn("end", F.col("t") + 5.0).withColumn("n_events", 1 + F.col("seq") % 3)
    return folds.suppress_overlaps(c, 0.3).select("stream_id", "seq")


@query("budget_prune", """WITH c AS (SELECT l_orderkey AS stream_id, l_linenumber AS seq, l_quantity AS len, l_discount AS score, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total,
 coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dropped FROM lineitem)
SELECT stream_id, count(*) AS kept, CAST(sum(len) AS BIGINT) AS length FROM c WHERE total - dropped <= 60 GROUP BY stream_id""")
def budget_prune(spark, sf_dir):
    """Clips dropped from the lowest score up until a reel fits its budget."""
    from tideline.bind import table

    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream_id"), F.col("l_partkey").alias("seq"), F.col("l_linenumber").cast("double").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).alias("end"), F.col("l_discount").alias("score"))
    kept = folds.budget_prune(c, 60.0)
    return kept.groupBy("stream_id").agg(F.count("*").alias("kept"), F.sum(F.col("end") - F.col("start")).cast("bigint").alias("length"))


@query("goal_dedup", f"""WITH RECURSIVE {TL}, g AS (SELECT stream_id, t, seq, confidence AS c, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) AS i FROM tl WHERE event_type = 'kickoff'),
l AS (SELECT g.stream_id, g.i, list(CASE WHEN g.c >= j.c THEN j.seq ELSE g.seq END) FILTER (j.seq IS NOT NULL) AS losers, any_value(g.seq) AS seq FROM g LEFT JOIN g j ON j.stream_id = g.stream_id AND j.i > g.i AND j.t - g.t < 240 GROUP BY g.stream_id, g.i),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS i, []::BIGINT[] AS gone FROM (SELECT DISTINCT stream_id FROM g)
 UNION ALL SELECT r.stream_id, l.i, CASE WHEN list_contains(r.gone, l.seq) THEN r.gone ELSE list_distinct(r.gone || coalesce(l.losers, []::BIGINT[])) END FROM r JOIN l ON l.stream_id = r.stream_id AND l.i = r.i + 1)
SELECT stream_id, unnest(gone) AS seq FROM (SELECT stream_id, arg_max(gone, i) AS gone FROM r GROUP BY stream_id)""")
def goal_dedup(spark, sf_dir):
    """Goals that lose against another within four minutes."""
    return folds.goal_dedup(kind(timeline(spark, sf_dir), "kickoff"), 240.0).distinct()


@query("dead_time_promotion", f"""WITH RECURSIVE {TL},
s AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS i FROM tl s WHERE event_type = 'shot_on_target'
 AND NOT EXISTS (SELECT 1 FROM tl a WHERE a.stream_id = s.stream_id AND a.seq <> s.seq AND a.t - s.t > 1.0 AND a.t - s.t < 45.0)
 AND NOT EXISTS (SELECT 1 FROM tl g WHERE g.stream_id = s.stream_id AND g.event_type = 'kickoff' AND s.t >= g.t - 5 AND s.t <= g.t + 1.0 + 25)),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS i, []::DOUBLE[] AS won, CAST(NULL AS BIGINT) AS seq FROM (SELECT DISTINCT stream_id FROM s) UNION ALL
 SELECT stream_id, i, CASE WHEN hit THEN won ELSE won || [t] END, CASE WHEN hit THEN NULL ELSE seq END FROM
 (SELECT r.stream_id, s.i, s.t, s.seq, r.won, len(list_filter(r.won, lambda y: s.t >= y - 5 AND s.t <= y + 1.0 + 25)) > 0 AS hit FROM r JOIN s ON s.stream_id = r.stream_id AND s.i = r.i + 1))
SELECT stream_id, seq FROM r WHERE seq IS NOT NULL""")
def dead_time_promotion(spark, sf_dir):
    """Shots with dead time after them become goals unless a goal, or one promoted before, covers them."""
    from tideline.operators import timeline as tm

    tl = timeline(spark, sf_dir)
    quiet = tm.within(kind(tl, "shot_on_target"), tl, 1.0, 45.0, "left_anti", True, True, where=F.col("r.seq") != F.col("seq"))
    rows = kind(tl, "kickoff").withColumn("is_goal", F.lit(True)).withColumn("eligible", F.lit(False)).unionByName(quiet.withColumn("is_goal", F.lit(False)).withColumn("eligible", F.lit(True)))
    return folds.promote_uncovered(rows.withColumn("start", F.col("t")).withColumn("end", F.col("t") + 1.0), 5.0, 25.0)


MATCH = """WITH RECURSIVE {tl}, g AS (SELECT stream_id, seq, t, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) AS i FROM tl WHERE {truth}),
d AS (SELECT stream_id, list({{'t': t, 'seq': seq}} ORDER BY t, seq) AS ds FROM tl WHERE {found} GROUP BY stream_id),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS i, []::STRUCT(a BIGINT, b BIGINT)[] AS ps FROM (SELECT DISTINCT stream_id FROM g) UNION ALL
 SELECT stream_id, i, CASE WHEN len(free) = 0 THEN ps ELSE ps || [{{'a': seq, 'b': list_sort(free)[1].seq}}] END FROM
 (SELECT r.stream_id, g.i, g.seq, r.ps, list_transform(list_filter(d.ds, lambda y: abs(y.t - g.t) <= {tol} AND NOT list_contains(list_transform(r.ps, lambda p: p.b), y.seq)), lambda y: {{'k': {key}, 't': y.t, 'seq': y.seq}}) AS free
  FROM r JOIN g ON g.stream_id = r.stream_id AND g.i = r.i + 1 JOIN d ON d.stream_id = r.stream_id))
SELECT stream_id, p.a AS truth_seq, p.b AS found_seq FROM (SELECT stream_id, unnest(arg_max(ps, i)) AS p FROM r GROUP BY stream_id)"""


@query("greedy_match_truths", MATCH.format(tl=TL, truth=is_("goal_kick"), found=is_("catch"), tol="30.0", key="abs(y.t - g.t)"))
def greedy_match_truths(spark, sf_dir):
    """Truths in time order each take the closest free detection within 30 s."""
    tl = timeline(spark, sf_dir)
    return folds.greedy_match(kind(tl, "goal_kick"), kind(tl, "catch"), 30.0)


@query("greedy_match_detections", MATCH.format(tl=TL, truth=is_("catch"), found=is_("goal_kick"), tol="30.0", key="abs(y.t - g.t)"))
def greedy_match_detections(spark, sf_dir):
    """The same with detections choosing."""
    tl = timeline(spark, sf_dir)
    return folds.greedy_match(kind(tl, "catch"), kind(tl, "goal_kick"), 30.0)


@query("cue_pairing", MATCH.format(tl=TL, truth=is_("catch"), found=is_("kickoff"), tol="12.0", key="y.t"))
def cue_pairing(spark, sf_dir):
    """Whistles each take the first free surge within reach, not the closest."""
    tl = timeline(spark, sf_dir)
    return folds.greedy_match(kind(tl, "catch"), kind(tl, "kickoff"), 12.0, first_fit=True)


@query("nearest_chain", f"""WITH RECURSIVE {TL}, p AS (SELECT stream_id, floor(t / 20) * 20 AS f, seq, x::DOUBLE AS x, y::DOUBLE AS y, confidence AS c FROM tl),
f AS (SELECT stream_id, f, list({{'nc': -c, 'seq': seq, 'x': x, 'y': y}} ORDER BY -c, seq) AS cs, row_number() OVER (PARTITION BY stream_id ORDER BY f) AS i FROM p GROUP BY stream_id, f),
r AS (SELECT stream_id, i, f AS t, cs[1].seq AS seq, cs[1].x AS x, cs[1].y AS y FROM f WHERE i = 1 UNION ALL
 SELECT stream_id, i, t, b.seq, b.x, b.y FROM (SELECT f.stream_id, f.i, f.f AS t, CASE WHEN n.d <= 0.01 * greatest(f.f - r.t, 0.1) THEN {{'seq': n.seq, 'x': n.x, 'y': n.y}} ELSE {{'seq': f.cs[1].seq, 'x': f.cs[1].x, 'y': f.cs[1].y}} END AS b
  FROM r JOIN (SELECT * FROM f) f ON f.stream_id = r.stream_id AND f.i = r.i + 1, LATERAL (SELECT list_sort(list_transform(f.cs, lambda c: {{'d': sqrt((c.x - r.x) * (c.x - r.x) + (c.y - r.y) * (c.y - r.y)), 'nc': c.nc, 'seq': c.seq, 'x': c.x, 'y': c.y}}))[1] AS n)))
SELECT stream_id, seq FROM r""")
def nearest_chain(spark, sf_dir):
    """One point a frame: the nearest that could be reached, else the most confident."""
    pts = timeline(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 20) * 20.0).withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double"))
    return folds.nearest_chain(pts, 0.01).select("stream_id", "seq")
