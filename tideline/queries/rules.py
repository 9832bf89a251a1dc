"""The rule chain over verdicts: its probes, its rules, and the whole of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.bind import micro, timeline
from tideline.catalog import query
from tideline.plans import rules
from tideline.queries.joins import MICRO
from tideline.queries.texts import VERDICTS, said

COLUMNS = ("stream_id", "seq", "t", "result", "event_type", "confidence", "reasoning")
#: A fifth of the rows were never scored: candidates only.
SCORED, UNSCORED = "seq % 5 <> 0", "seq % 5 = 0"
#: Times that a stream is stretched, so that its gaps are long and all its rows are looked at.
LONG, LONGER = 20.0, 40.0
# What models say when they are asked again, by the seq of the row at that time.
ANSWERS_SQL = """a AS (SELECT stream_id, t, CASE WHEN seq % 5 <> 0 THEN CASE seq % 3 WHEN 0 THEN 'shot' WHEN 1 THEN 'catch' ELSE 'goal' END WHEN seq % 2 = 0 THEN 'set_piece' ELSE 'kickoff' END AS phase,
 CASE WHEN seq % 5 <> 0 THEN CASE seq % 3 WHEN 0 THEN 'shot_on_target' WHEN 1 THEN 'catch' ELSE 'goal' END WHEN seq % 4 = 0 THEN 'corner_kick' WHEN seq % 2 = 0 THEN 'goal_kick' ELSE 'kickoff' END AS event_type,
 CASE WHEN seq % 11 = 0 THEN 'rejected' ELSE 'confirmed' END AS result, 0.55 + (seq % 40) / 100.0 AS confidence, 'seen again' AS reasoning FROM v)"""
BASE = f"{VERDICTS}, {ANSWERS_SQL}, w AS (SELECT * FROM v WHERE {SCORED}), c AS (SELECT * FROM w WHERE result = 'confirmed')"


def verdicts(spark, sf_dir) -> DataFrame:
    return said(spark, sf_dir).where(SCORED).select(*COLUMNS)


def candidates(spark, sf_dir) -> DataFrame:
    return timeline(spark, sf_dir).select("stream_id", "seq", "t")


def answers(spark, sf_dir) -> DataFrame:
    s = F.col("seq")
    scored, third = s % 5 != 0, s % 3
    own = lambda a, b, c: F.when(third == 0, a).when(third == 1, b).otherwise(c)
    return timeline(spark, sf_dir).select(
        "stream_id", "t",
        F.when(scored, own("shot", "catch", "goal")).when(s % 2 == 0, "set_piece").otherwise("kickoff").alias("phase"),
        F.when(scored, own("shot_on_target", "catch", "goal")).when(s % 4 == 0, "corner_kick").when(s % 2 == 0, "goal_kick").otherwise("kickoff").alias("event_type"),
        F.when(s % 11 == 0, "rejected").otherwise("confirmed").alias("result"), (0.55 + (s % 40) / 100.0).alias("confidence"), F.lit("seen again").alias("reasoning"),
    )


def extent(spark, sf_dir) -> DataFrame:
    return timeline(spark, sf_dir).groupBy("stream_id").agg(F.max("t").alias("duration"))


def rescans_sql(rows: str, lo: float, hi: float, ends: str, offsets: tuple[float, ...]) -> str:
    """Probes after each of ``rows``: the first unscored candidate in the span, else fixed offsets."""
    gap = f"u.t - r.t {ends[0]} {lo} AND u.t - r.t {ends[1]} {hi}"
    values = ", ".join(f"({o})" for o in offsets)
    return f"""rows AS ({rows}), u AS (SELECT v.* FROM v WHERE {UNSCORED} AND NOT EXISTS (SELECT 1 FROM w WHERE w.stream_id = v.stream_id AND w.t = v.t)),
n AS (SELECT r.stream_id, r.seq, r.t, min(u.t) AS nt FROM rows r LEFT JOIN u ON u.stream_id = r.stream_id AND {gap} GROUP BY r.stream_id, r.seq, r.t), m AS (SELECT stream_id, max(t) AS duration FROM v GROUP BY stream_id)
SELECT DISTINCT stream_id, {MICRO.format('t')} AS t_u FROM (SELECT stream_id, nt AS t FROM n WHERE nt IS NOT NULL UNION ALL
 SELECT n.stream_id, n.t + o.x FROM n JOIN m USING (stream_id), (VALUES {values}) o(x) WHERE nt IS NULL AND n.t + o.x <= m.duration)"""


@query("set_piece_probes", f"WITH {BASE}, {rescans_sql('''SELECT * FROM c WHERE event_type IN ('shot_on_target', 'shot_stop_diving', 'shot_off_target')''', 10, 90, ('>=', '<='), (20.0, 35.0, 50.0))}")
def set_piece_probes(spark, sf_dir):
    """Where the chain looks for corners and goal kicks after shots."""
    rows = rules.narrow(verdicts(spark, sf_dir))
    return rules.set_piece_probes(rows, candidates(spark, sf_dir).where(UNSCORED), extent(spark, sf_dir)).select("stream_id", micro(F.col("t")).alias("t_u"))


KICKOFF_ROWS = """SELECT s.* FROM c s LEFT JOIN (SELECT stream_id, min(t) AS ft FROM c WHERE event_type = 'kickoff' GROUP BY stream_id) f USING (stream_id)
 WHERE s.event_type IN ('shot_on_target', 'shot_stop_diving', 'goal') AND (f.ft IS NULL OR s.t >= f.ft)
 AND NOT EXISTS (SELECT 1 FROM c k WHERE k.stream_id = s.stream_id AND k.event_type = 'kickoff' AND k.t <> f.ft AND k.t - s.t > 20 AND k.t - s.t < 90)"""


@query("kickoff_probes", f"WITH {BASE}, {rescans_sql(KICKOFF_ROWS, 20, 90, ('>=', '<='), (30.0, 45.0, 60.0, 75.0, 90.0))}")
def kickoff_probes(spark, sf_dir):
    """Where the chain looks for kickoffs after shots and goals that none follows."""
    rows = rules.narrow(verdicts(spark, sf_dir))
    return rules.kickoff_probes(rows, candidates(spark, sf_dir).where(UNSCORED), extent(spark, sf_dir)).select("stream_id", micro(F.col("t")).alias("t_u"))


@query("corner_probes", f"""WITH {VERDICTS}, w AS (SELECT * REPLACE (t * {LONGER} AS t) FROM v), k AS (SELECT * FROM w WHERE result = 'confirmed' AND event_type = 'corner_kick'), d AS (SELECT DISTINCT stream_id, t FROM w),
g AS (SELECT stream_id, t, lead(t) OVER (PARTITION BY stream_id ORDER BY t) AS nt FROM d),
p AS (SELECT DISTINCT stream_id, t + i * 60.0 AS t FROM g, range(1, 11) r(i) WHERE nt - t >= 150 AND nt - t <= 600 AND t + i * 60.0 < nt - 10),
q AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.stream_id = p.stream_id AND abs(k.t - p.t) < 45))
SELECT stream_id, {MICRO.format('t')} AS t_u FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS r FROM q) WHERE r <= 20""")
def corner_probes(spark, sf_dir):
    """Where the chain looks for corners in long gaps."""
    rows = rules.narrow(said(spark, sf_dir).select(*COLUMNS).withColumn("t", F.col("t") * LONGER))
    return rules.corner_probes(rows).select("stream_id", micro(F.col("t")).alias("t_u"))


@query("shot_probes", f"""WITH {VERDICTS}, w AS (SELECT * REPLACE (t * {LONG} AS t) FROM v), n AS (SELECT * FROM w x WHERE result = 'rejected' AND NOT EXISTS (SELECT 1 FROM w y WHERE y.stream_id = x.stream_id AND y.result = 'confirmed' AND abs(y.t - x.t) < 10)),
b AS (SELECT *, count(*) OVER p AS many, min(t) OVER p AS lo, max(t) OVER p AS hi FROM n WINDOW p AS (PARTITION BY stream_id)),
e AS (SELECT *, CASE WHEN hi > lo THEN least(CAST(floor((t - lo) / ((hi - lo) / 30)) AS INTEGER), 29) ELSE 0 END AS bin FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY stream_id, bin ORDER BY confidence DESC, t, seq) AS r FROM e) SELECT stream_id, seq FROM f WHERE many <= 30 OR r = 1""")
def shot_probes(spark, sf_dir):
    """Rejected rows that the chain asks about again."""
    rows = rules.narrow(said(spark, sf_dir).select(*COLUMNS).withColumn("t", F.col("t") * LONG))
    return rules.shot_probes(rows).select("stream_id", "seq")


CATCH_SQL = f"""WITH {BASE}, s AS (SELECT * FROM c WHERE event_type = 'shot_on_target'),
f AS (SELECT s.stream_id, s.seq, bool_or(e.event_type IN ('shot_stop_diving', 'shot_stop_standing', 'punch', 'catch') AND abs(e.t - s.t) < 15) OR bool_or(e.event_type = 'goal' AND abs(e.t - s.t) < 30)
 OR bool_or(e.event_type = 'corner_kick' AND e.t - s.t > 0 AND e.t - s.t < 90) OR bool_or(e.event_type = 'kickoff' AND e.t - s.t > 0 AND e.t - s.t < 180) AS near, bool_or(e.event_type = 'goal_kick' AND e.t - s.t > 0 AND e.t - s.t < 90) AS kick
 FROM s LEFT JOIN c e ON e.stream_id = s.stream_id AND e.t > s.t - 30 AND e.t < s.t + 180 GROUP BY s.stream_id, s.seq),
o AS (SELECT s.*, kick, CASE WHEN kick THEN row_number() OVER (PARTITION BY s.stream_id, kick ORDER BY s.t, s.seq) END AS r FROM s JOIN f USING (stream_id, seq) WHERE NOT coalesce(near, false)),
y AS (SELECT o.stream_id, o.seq, a.event_type, a.confidence FROM o JOIN a ON a.stream_id = o.stream_id AND a.t = o.t AND a.phase = 'catch' AND a.result = 'confirmed' WHERE o.r <= 25)
SELECT w.stream_id, w.seq, CASE WHEN y.seq IS NOT NULL THEN y.event_type WHEN o.seq IS NULL OR o.r > 25 THEN w.event_type WHEN coalesce(o.kick, false) THEN 'shot_off_target' ELSE 'catch' END AS event_type,
 {MICRO.format('CASE WHEN y.seq IS NOT NULL THEN y.confidence WHEN o.seq IS NOT NULL AND NOT coalesce(o.kick, false) THEN w.confidence * 0.85 ELSE w.confidence END')} AS confidence_u
FROM w LEFT JOIN o USING (stream_id, seq) LEFT JOIN y USING (stream_id, seq)"""


@query("catch_scan", CATCH_SQL)
def catch_scan(spark, sf_dir):
    """Shots that the keeper caught: by what followed, and by answers where a goal kick did."""
    out = rules.catch_rule(rules.narrow(verdicts(spark, sf_dir)), answers(spark, sf_dir))
    return out.select("stream_id", "seq", "event_type", micro(F.col("confidence")).alias("confidence_u"))


@query("goal_checks", f"""WITH {BASE}, k AS (SELECT * FROM c WHERE event_type = 'kickoff'),
s AS (SELECT * FROM c WHERE event_type IN ('shot_stop_diving', 'free_kick_shot', 'shot_on_target') AND EXISTS (SELECT 1 FROM k WHERE k.stream_id = c.stream_id AND k.t - c.t > 20 AND k.t - c.t < 120)),
y AS (SELECT s.stream_id, s.seq, a.confidence FROM s JOIN a ON a.stream_id = s.stream_id AND a.t = s.t AND a.phase = 'goal' AND a.result = 'confirmed' AND a.confidence >= 0.7)
SELECT w.stream_id, w.seq, CASE WHEN y.seq IS NULL THEN w.event_type ELSE 'goal' END AS event_type, {MICRO.format('coalesce(y.confidence, w.confidence)')} AS confidence_u,
 CASE WHEN y.seq IS NULL THEN w.reasoning ELSE 'GOAL CHECK: seen again. Original: ' || w.event_type END AS reasoning FROM w LEFT JOIN y USING (stream_id, seq)""")
def goal_checks(spark, sf_dir):
    """Saves and shots before a kickoff that a second model calls goals."""
    v = verdicts(spark, sf_dir)
    out = rules.explained(rules.goal_check_rule(rules.narrow(v), answers(spark, sf_dir)), v)
    return out.select("stream_id", "seq", "event_type", micro(F.col("confidence")).alias("confidence_u"), "reasoning")


@query("reverse_restart_rule", f"""WITH {BASE}, r AS (SELECT * FROM c WHERE event_type IN ('corner_kick', 'goal_kick') AND NOT EXISTS (SELECT 1 FROM c e WHERE e.stream_id = c.stream_id AND e.event_type IN ('shot_stop_diving', 'shot_stop_standing', 'punch', 'catch', 'shot_on_target', 'shot_off_target') AND e.t > c.t - 30 AND e.t < c.t)),
j AS (SELECT r.stream_id, r.seq AS rs, x.seq, row_number() OVER (PARTITION BY r.stream_id, r.seq ORDER BY r.t - x.t, x.seq) AS k FROM r JOIN w x ON x.stream_id = r.stream_id AND x.result = 'rejected' AND r.t - x.t > 3 AND r.t - x.t < 30),
y AS (SELECT DISTINCT stream_id, seq FROM j WHERE k = 1)
SELECT w.stream_id, w.seq, CASE WHEN y.seq IS NULL THEN w.event_type ELSE 'shot_off_target' END AS event_type, CASE WHEN y.seq IS NULL THEN w.result ELSE 'confirmed' END AS result, {MICRO.format('CASE WHEN y.seq IS NULL THEN w.confidence ELSE 0.6 END')} AS confidence_u FROM w LEFT JOIN y USING (stream_id, seq)""")
def reverse_restart_rule(spark, sf_dir):
    """Rejected rows that a restart without a shot makes misses."""
    out = rules.reverse_restart_rule(rules.narrow(verdicts(spark, sf_dir)))
    return out.select("stream_id", "seq", "event_type", "result", micro(F.col("confidence")).alias("confidence_u"))


GOAL_SQL = f"""WITH RECURSIVE {VERDICTS}, c AS (SELECT *, min(CASE WHEN event_type = 'kickoff' THEN t END) OVER (PARTITION BY stream_id) AS ft FROM v WHERE result = 'confirmed'),
x AS (SELECT *, CASE WHEN event_type = 'catch' THEN 'goal' ELSE event_type END AS e FROM c),
j AS (SELECT s.stream_id, s.seq, min(k.t - s.t) AS gap FROM x s JOIN c k ON k.stream_id = s.stream_id AND k.event_type = 'kickoff' AND k.t <> k.ft AND k.t - s.t > 20 AND k.t - s.t < 90 AND s.t >= s.ft GROUP BY ALL),
o AS (SELECT x.stream_id, x.seq, x.t, CASE WHEN e = 'shot_on_target' AND gap IS NOT NULL THEN 'goal' WHEN e = 'goal' AND gap IS NULL THEN 'shot_on_target' ELSE e END AS e,
 CASE WHEN e = 'shot_on_target' AND gap IS NOT NULL THEN least(confidence + 0.1, 1.0) WHEN e = 'goal' AND gap IS NULL THEN confidence * 0.85 ELSE confidence END AS c FROM x LEFT JOIN j USING (stream_id, seq)),
g AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) AS i FROM o WHERE e = 'goal'),
l AS (SELECT g.stream_id, g.i, list(CASE WHEN g.c >= h.c THEN h.seq ELSE g.seq END) FILTER (h.seq IS NOT NULL) AS losers, any_value(g.seq) AS seq FROM g LEFT JOIN g h ON h.stream_id = g.stream_id AND h.i > g.i AND h.t - g.t < 240 GROUP BY g.stream_id, g.i),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS i, []::BIGINT[] AS gone FROM (SELECT DISTINCT stream_id FROM g)
 UNION ALL SELECT r.stream_id, l.i, CASE WHEN list_contains(r.gone, l.seq) THEN r.gone ELSE list_distinct(r.gone || coalesce(l.losers, []::BIGINT[])) END FROM r JOIN l ON l.stream_id = r.stream_id AND l.i = r.i + 1),
z AS (SELECT DISTINCT stream_id, unnest(gone) AS seq FROM (SELECT stream_id, arg_max(gone, i) AS gone FROM r GROUP BY stream_id))
SELECT o.stream_id, o.seq, CASE WHEN z.seq IS NULL THEN o.e ELSE 'shot_on_target' END AS event_type, {MICRO.format('CASE WHEN z.seq IS NULL THEN o.c ELSE o.c * 0.8 END')} AS confidence_u FROM o LEFT JOIN z USING (stream_id, seq)"""


@query("goal_inference", GOAL_SQL)
def goal_inference(spark, sf_dir):
    """Confirmed rows after goal inference: risen, fallen and deduplicated; catches stand in for goals."""
    v = said(spark, sf_dir).select(*COLUMNS).where("result = 'confirmed'")
    v = v.withColumn("event_type", F.when(F.col("event_type") == "catch", "goal").otherwise(F.col("event_type")))
    return rules.goal_inference(v).select("stream_id", "seq", "event_type", micro(F.col("confidence")).alias("confidence_u"))


def judged(spark, sf_dir) -> DataFrame:
    return rules.run_rules(verdicts(spark, sf_dir), candidates(spark, sf_dir), answers(spark, sf_dir))


@query("rule_pipeline")
def rule_pipeline(spark, sf_dir):
    """All inference rules in order over verdicts, with answers to what is asked again; tests hold it against a plain version."""
    return judged(spark, sf_dir).select("stream_id", "seq", "result", "event_type", micro(F.col("confidence")).alias("confidence_u"), "reasoning")


@query("final_events")
def final_events(spark, sf_dir):
    """The events of a whole run: rules, conversion, two passes of deduplication."""
    return rules.final_events(judged(spark, sf_dir)).select("stream_id", "seq", "event_type", micro(F.col("t")).alias("t_u"), micro(F.col("confidence")).alias("confidence_u"))
