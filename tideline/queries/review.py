"""The event log, review, reels and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline import schema
from tideline.bind import TL, micro, table, timeline
from tideline.catalog import query
from tideline.plans import reels, verdicts
from tideline.queries.joins import MICRO, is_, kind
from tideline.sources import events as src

DIM = schema.values_sql(schema.EVENT_TYPES, "event_type, label, category, pre_pad, post_pad, max_clip, min_confidence, is_gk, threshold, reels")
INCLUDE = "coalesce(review_override, confidence >= coalesce(threshold, 0.65))"


@query("review_summary", f"""WITH {TL}, d AS (SELECT * FROM {DIM}), e AS (SELECT tl.*, threshold FROM tl LEFT JOIN d USING (event_type))
SELECT stream_id, count(*) AS total, count(*) FILTER (review_override IS NULL AND {INCLUDE}) AS auto_include, count(*) FILTER (review_override) AS manual_in, count(*) FILTER (NOT review_override) AS manual_out,
 count(*) FILTER (event_type = 'shot_on_target') AS shots, count(*) FILTER (event_type = 'catch') AS catches FROM e GROUP BY stream_id""")
def review_summary(spark, sf_dir):
    """Per stream: events, those admitted by confidence, by hand and refused by hand, and counts of two types."""
    e = verdicts.with_types(timeline(spark, sf_dir))
    free = F.col("review_override").isNull()
    return e.groupBy("stream_id").agg(
        F.count("*").alias("total"), F.count_if(free & verdicts.should_include(F.col("threshold"))).alias("auto_include"), F.count_if(F.col("review_override")).alias("manual_in"),
        F.count_if(~F.col("review_override")).alias("manual_out"), F.count_if(F.col("event_type") == "shot_on_target").alias("shots"), F.count_if(F.col("event_type") == "catch").alias("catches"),
    )


LOG_SQL = f"""{TL}, log AS (SELECT seq AS event_id, 2 * seq AS s, stream_id, t, confidence FROM tl UNION ALL SELECT seq, 2 * seq + 1, stream_id, t, confidence * 0.5 FROM tl WHERE seq % 7 = 0)"""


def _log(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    one = tl.select(F.col("seq").alias("event_id"), (F.col("seq") * 2).alias("_seq"), "stream_id", "t", "confidence")
    return one, tl.where("seq % 7 = 0").select(F.col("seq").alias("event_id"), (F.col("seq") * 2 + 1).alias("_seq"), "stream_id", "t", (F.col("confidence") * 0.5).alias("confidence"))


@query("log_compaction", f"WITH {LOG_SQL} SELECT event_id, stream_id, {MICRO.format('arg_max(confidence, s)')} AS confidence_u FROM log GROUP BY event_id, stream_id")
def log_compaction(spark, sf_dir):
    """The last row of each event of an append-only log."""
    one, two = _log(spark, sf_dir)
    return src.compacted(one.unionByName(two)).select("event_id", "stream_id", micro(F.col("confidence")).alias("confidence_u"))


@query("log_merge", f"WITH {LOG_SQL} SELECT event_id, {MICRO.format('arg_max(confidence, s)')} AS confidence_u FROM log GROUP BY event_id")
def log_merge(spark, sf_dir):
    """Two logs as one; the later log wins."""
    return src.merged([*_log(spark, sf_dir)]).select("event_id", micro(F.col("confidence")).alias("confidence_u"))


@query("tolerant_scan", f"WITH {TL} SELECT stream_id, event_type, count(*) AS n FROM tl WHERE seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0 GROUP BY stream_id, event_type")
def tolerant_scan(spark, sf_dir):
    """JSON lines, of which some are blank, broken or of an unknown type: only events remain."""
    tl = timeline(spark, sf_dir)
    s = F.col("seq")
    row = F.to_json(F.struct(s.cast("string").alias("event_id"), F.when(s % 17 == 0, "no_such_type").otherwise(F.col("event_type")).alias("event_type"), F.col("t").alias("timestamp_start")))
    line = F.when(s % 11 == 0, "  ").when(s % 13 == 0, F.expr("left(to_json(struct(seq)), 4)")).otherwise(row)
    return src.parsed_lines(tl.select("stream_id", line.alias("value"))).groupBy("stream_id", "event_type").agg(F.count("*").alias("n"))


@query("included_events", f"WITH {TL}, d AS (SELECT * FROM {DIM}) SELECT stream_id, seq FROM tl LEFT JOIN d USING (event_type) WHERE {INCLUDE}")
def included_events(spark, sf_dir):
    """Events that the review or their type's threshold admits."""
    return verdicts.with_types(timeline(spark, sf_dir)).where(verdicts.should_include(F.col("threshold"))).select("stream_id", "seq")


@query("reel_membership", f"""WITH {TL}, d AS (SELECT * FROM {DIM}), e AS (SELECT stream_id, seq, confidence, threshold, review_override, CASE WHEN seq % 4 = 0 THEN ['keeper_a'] WHEN seq % 4 = 1 THEN ['keeper'] ELSE reels END AS targets FROM tl JOIN d USING (event_type))
SELECT stream_id, count(*) FILTER (len(list_filter(targets, lambda x: x = 'keeper' OR starts_with(x, 'keeper_'))) > 0) AS keeper, count(*) FILTER (list_contains(targets, 'keeper')) AS keeper_exact, count(*) FILTER (list_contains(targets, 'highlights') AND {INCLUDE}) AS highlights_kept FROM e GROUP BY stream_id""")
def reel_membership(spark, sf_dir):
    """Events of a reel or one of its parts, of the exact reel, and those of a reel that are admitted."""
    e = verdicts.with_types(timeline(spark, sf_dir)).withColumn("targets", F.when(F.col("seq") % 4 == 0, F.array(F.lit("keeper_a"))).when(F.col("seq") % 4 == 1, F.array(F.lit("keeper"))).otherwise(F.col("reels")))
    return e.groupBy("stream_id").agg(
        F.count_if(verdicts.in_reel("keeper", F.col("targets"))).alias("keeper"), F.count_if(F.array_contains("targets", "keeper")).alias("keeper_exact"),
        F.count_if(F.array_contains("targets", "highlights") & verdicts.should_include(F.col("threshold"))).alias("highlights_kept"),
    )


SPECS = [("keeper", t) for t in schema.KEEPER_TYPES] + [("goal_kicks", "goal_kick")]


@query("reel_selection", f"WITH {TL}, d AS (SELECT * FROM {DIM}), s AS (SELECT * FROM {schema.values_sql(SPECS, 'reel, event_type')}) SELECT reel, stream_id, count(*) AS events FROM tl JOIN d USING (event_type) JOIN s USING (event_type) WHERE {INCLUDE} GROUP BY reel, stream_id")
def reel_selection(spark, sf_dir):
    """Admitted events of each requested reel; an unknown reel has none."""
    return reels.selected(timeline(spark, sf_dir), reels.specs_of(["keeper", "goal_kicks", "no_such_reel"])).groupBy("reel", "stream_id").agg(F.count("*").alias("events"))


@query("event_listing", f"WITH {TL} SELECT stream_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) AS r FROM tl WHERE confidence >= 0.4 AND event_type = 'catch') WHERE r <= 20")
def event_listing(spark, sf_dir):
    """The first 20 events of a stream with a type and a confidence."""
    from tideline.operators.timeline import in_order

    e = kind(timeline(spark, sf_dir).where("confidence >= 0.4"), "catch")
    return e.withColumn("r", F.row_number().over(in_order())).where("r <= 20").select("stream_id", "seq")


def _events(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    ends = tl.groupBy("stream_id").agg(F.max("t").alias("duration"))
    return tl.join(ends, "stream_id").withColumn("t0", F.col("t")).withColumn("t1", F.col("t") + 1.0).withColumn("signature", F.when(F.col("seq") % 9 == 0, "parry"))


@query("event_construction", f"""WITH {TL}, d AS (SELECT * FROM {DIM}), m AS (SELECT stream_id, max(t) AS duration FROM tl GROUP BY stream_id), e AS (SELECT stream_id, seq, is_gk, greatest(0.0, t - pre_pad) AS a, least(duration, t + post_pad) AS b FROM tl JOIN d USING (event_type) JOIN m USING (stream_id))
SELECT stream_id, seq, {MICRO.format('a')} AS start_u, {MICRO.format('b')} AS end_u, CAST(trunc(a * 30.0) AS BIGINT) AS frame_start, is_gk AS keeper FROM e""")
def event_construction(spark, sf_dir):
    """Padded and clamped events with frames, reels and the keeper's flag."""
    e = verdicts.made_events(_events(spark, sf_dir))
    return e.select("stream_id", "seq", micro(F.col("timestamp_start")).alias("start_u"), micro(F.col("timestamp_end")).alias("end_u"), "frame_start", F.col("is_goalkeeper_event").alias("keeper"))


REEL_CLIPS = f"""WITH {TL}, d AS (SELECT * FROM {DIM}), m AS (SELECT stream_id, max(t) AS duration FROM tl GROUP BY stream_id), c AS (SELECT stream_id, seq, confidence, greatest(0.0, t - pre_pad) AS a, least(duration, t + 1.0 + post_pad + CASE WHEN seq % 9 = 0 THEN 3.0 ELSE 0.0 END) AS b, least(max_clip, 90.0) AS cap
 FROM tl JOIN d USING (event_type) JOIN m USING (stream_id) WHERE event_type IN ('shot_on_target', 'goal_kick', 'catch', 'corner_kick') AND {INCLUDE}),
k AS (SELECT stream_id, unnest(list_reduce(list([{{'a': a, 'b': b, 'cap': cap, 'n': 1, 'c': confidence, 'seq': seq}}] ORDER BY a, seq), lambda acc, x:
 CASE WHEN x[1].a - acc[-1].b <= 2 THEN CASE WHEN greatest(acc[-1].b, x[1].b) - acc[-1].a <= least(acc[-1].cap, x[1].cap) THEN acc[1:len(acc) - 1] || [{{'a': acc[-1].a, 'b': greatest(acc[-1].b, x[1].b), 'cap': least(acc[-1].cap, x[1].cap), 'n': acc[-1].n + 1, 'c': greatest(acc[-1].c, x[1].c), 'seq': acc[-1].seq}}]
  WHEN x[1].b <= greatest(x[1].a, acc[-1].b) THEN acc ELSE acc || [{{'a': greatest(x[1].a, acc[-1].b), 'b': x[1].b, 'cap': x[1].cap, 'n': 1, 'c': x[1].c, 'seq': x[1].seq}}] END ELSE acc || x END)) AS k FROM c GROUP BY stream_id),"""


@query("reel_clips", REEL_CLIPS + f" z AS (SELECT 1) SELECT stream_id, {MICRO.format('k.a')} AS start_u, {MICRO.format('k.b')} AS end_u, k.n AS events FROM k")
def reel_clips(spark, sf_dir):
    """The keeper reel's clips: padding and caps by type, merged under the running cap."""
    c = reels.reel_clips(reels.selected(_events(spark, sf_dir), reels.specs_of(["keeper"])))
    return c.select("stream_id", micro(F.col("start")).alias("start_u"), micro(F.col("end")).alias("end_u"), F.size("members").alias("events"))


FINISHED = (
    REEL_CLIPS.replace("SELECT stream_id, seq, confidence,", "SELECT stream_id, seq, confidence, event_type AS e,").replace("'c': confidence,", "'c': confidence, 'e': e,")
    .replace("'c': greatest(acc[-1].c, x[1].c),", "'c': greatest(acc[-1].c, x[1].c), 'e': CASE WHEN x[1].c > acc[-1].c THEN x[1].e ELSE acc[-1].e END,").replace("'c': x[1].c,", "'c': x[1].c, 'e': x[1].e,")
    + f""" g AS (SELECT stream_id, k.a AS a, k.b AS b, k.n AS n, k.c AS c, k.e AS e, k.seq AS seq, k.b - k.a AS l FROM k WHERE k.b - k.a >= 2.0),
p AS (SELECT *, sum(l) OVER (PARTITION BY stream_id) - coalesce(sum(l) OVER (PARTITION BY stream_id ORDER BY c, a, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM g)
SELECT stream_id, 'keeper' AS reel, {MICRO.format('a')} AS start_u, {MICRO.format('b')} AS end_u, e AS event_type, n AS events FROM p WHERE rest <= 600""")


@query("finished_reel", FINISHED)
def finished_reel(spark, sf_dir):
    """The keeper reel of each stream as it would be cut: overlaps suppressed, short clips dropped, pruned to ten minutes."""
    c = reels.finished(reels.reel_clips(reels.selected(_events(spark, sf_dir), reels.specs_of(["keeper"]))), cap=600.0)
    return c.select("stream_id", "reel", micro(F.col("start")).alias("start_u"), micro(F.col("end")).alias("end_u"), "event_type", F.size("members").alias("events"))


@query("clip_stats", REEL_CLIPS + f" z AS (SELECT 1) SELECT stream_id, count(*) AS clips, {MICRO.format('sum(k.b - k.a)')} AS seconds_u FROM k GROUP BY stream_id")
def clip_stats(spark, sf_dir):
    """Clips and seconds of the keeper reel."""
    c = reels.reel_clips(reels.selected(_events(spark, sf_dir), reels.specs_of(["keeper"])))
    return reels.clip_stats(c, "stream_id").select("stream_id", "clips", micro(F.col("seconds")).alias("seconds_u"))


STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'detecting' END"


def _jobs(spark, sf_dir):
    from tideline.bind import typed

    return table(spark, sf_dir, "orders").withColumn("status", typed(F.col("o_orderstatus"), {"F": "complete", "O": "pending", "P": "detecting"}))


@query("jobs_by_status", f"SELECT v.status, count(o_orderkey) AS jobs FROM {schema.values_sql([(s,) for s in schema.JOB_STATUS], 'status')} LEFT JOIN orders ON {STATUS_SQL} = v.status GROUP BY v.status")
def jobs_by_status(spark, sf_dir):
    """Jobs of every status, zero where there are none."""
    from tideline.plans.jobs import by_status

    return by_status(_jobs(spark, sf_dir))


@query("job_actions", f"SELECT action, count(*) AS jobs FROM (SELECT {STATUS_SQL} AS status FROM orders) JOIN (VALUES ('pause', 'pending'), ('pause', 'ingesting'), ('pause', 'detecting'), ('pause', 'segmenting'), ('pause', 'assembling'), ('cancel', 'pending'), ('cancel', 'ingesting'), ('cancel', 'detecting'), ('cancel', 'segmenting'), ('cancel', 'assembling'), ('cancel', 'paused'), ('resume', 'paused'), ('retry', 'failed'), ('retry', 'cancelled'), ('delete', 'complete'), ('delete', 'failed'), ('delete', 'cancelled')) AS v(action, s) ON status = s GROUP BY action")
def job_actions(spark, sf_dir):
    """How many jobs each action is allowed for."""
    from tideline.plans.jobs import allowed_actions

    return _jobs(spark, sf_dir).select(F.explode(allowed_actions(F.col("status"))).alias("action")).groupBy("action").agg(F.count("*").alias("jobs"))


@query("newest_jobs", "SELECT o_orderkey AS job_id, o_orderpriority AS priority FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_jobs(spark, sf_dir):
    """The 50 newest jobs: the listing is a limit by nature."""
    return _jobs(spark, sf_dir).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"))


@query("tag_lines", f"WITH {TL} SELECT stream_id, seq, event_type || ' — ' || printf('%02d:%02d.%02d', h // 6000, h % 6000 // 100, h % 100) AS line FROM (SELECT *, CAST(floor(t * 100 + 0.5) AS BIGINT) AS h FROM tl)")
def tag_lines(spark, sf_dir):
    """A line of text for each event, with its clock time."""
    from tideline.functions.text import clock

    return timeline(spark, sf_dir).select("stream_id", "seq", F.concat(F.col("event_type"), F.lit(" — "), clock(F.col("t"))).alias("line"))


@query("manifest", f"WITH {TL} SELECT stream_id, CAST(count(*) AS BIGINT) AS events, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS ids FROM tl WHERE event_type = 'kickoff' GROUP BY stream_id")
def manifest(spark, sf_dir):
    """What a reel's manifest lists of each stream."""
    e = kind(timeline(spark, sf_dir), "kickoff")
    return e.groupBy("stream_id").agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_list("seq")), ",").alias("ids"))


@query("ground_truth_scan", f"""WITH {TL} SELECT stream_id AS game, seq, CASE WHEN event_type = 'goal_kick' AND seq % 2 = 0 THEN 'goal_kick' WHEN event_type = 'shot_on_target' THEN 'shot_on_target' END AS event_type,
 CAST(CASE WHEN t >= 2700 THEN floor(t * 1000) - 2700000 + 3916000 ELSE floor(t * 1000) END AS BIGINT) AS t_ms FROM tl WHERE (event_type = 'goal_kick' AND seq % 2 = 0) OR event_type = 'shot_on_target'""")
def ground_truth_scan(spark, sf_dir):
    """Exported annotations: nested rows, kinds by name and type, clocks per half."""
    tl = timeline(spark, sf_dir)
    prop = F.struct(F.when(F.col("event_type") == "goal_kick", F.when(F.col("seq") % 2 == 0, "Goal Kick").otherwise("Other")).alias("Type"), F.lit(None).cast("string").alias("Outcome"))
    one = F.struct(F.when(F.col("event_type") == "shot_on_target", "Shots").when(F.col("event_type") == "goal_kick", "Restarts").otherwise("Misc").alias("event_name"), prop.alias("property"))
    row = F.struct(F.floor(F.col("t") * 1000).alias("event_time"), F.when(F.col("t") >= 2700, "2nd Half").otherwise("1st Half").alias("period_name"), F.col("seq").cast("string").alias("team_name"), F.col("x"), F.col("y"), F.array(one).alias("events"))
    docs = tl.groupBy(F.col("stream_id").alias("game")).agg(F.collect_list(row).alias("data"))
    mapping = spark.createDataFrame([("Shots", None, "shot_on_target"), ("Restarts", "Goal Kick", "goal_kick")], "name string, type string, event_type string")
    g = src.ground_truth(docs, mapping)
    return g.select("game", F.col("team_name").cast("bigint").alias("seq"), "event_type", F.floor(F.col("t") * 1000 + 0.5).cast("bigint").alias("t_ms"))


@query("marked_lines", f"""WITH {TL}, m AS (SELECT *, last_value(CASE WHEN event_type = 'kickoff' THEN 1 WHEN event_type = 'catch' THEN 0 END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS i FROM tl)
SELECT stream_id, seq FROM m WHERE i = 1 AND event_type <> 'kickoff'""")
def marked_lines(spark, sf_dir):
    """Log lines between start and stop markers."""
    return src.between_markers(timeline(spark, sf_dir), F.col("event_type") == "kickoff", F.col("event_type") == "catch").select("stream_id", "seq")
