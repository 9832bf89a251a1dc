"""Job log, reviews, truths, clocks, focused answers, records and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.bind import TL, micro, table, timeline
from tideline.catalog import query
from tideline.functions import answers
from tideline.plans import clock, evaluate, jobs, records, summaries, verdicts
from tideline.queries.joins import MICRO, is_, kind
from tideline.sources import truths

# Jobs are orders; each line of an order up to the third changes the job: by line number pause, cancel or a new state.
STATE_SQL = "CASE l_linenumber WHEN 1 THEN 'pause' WHEN 2 THEN CASE WHEN l_orderkey % 7 = 0 THEN 'delete' ELSE 'cancel' END ELSE 'status' END"


def job_log(spark, sf_dir) -> DataFrame:
    """The log after three rounds of updates."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit(0).cast("bigint").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    log = jobs.created(o)
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"), F.max("l_shipdate").alias("l_shipdate"))
    fails = F.col("l_quantity") < 10
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    for n in (1, 2, 3):
        change = lines.where(line == n).select(
            key.cast("string").alias("job_id"), line.cast("bigint").alias("seq"), F.col("l_shipdate").cast("timestamp").alias("at"),
            F.when(line == 1, "pause").when(line == 2, F.when(key % 7 == 0, "delete").otherwise("cancel")).otherwise("status").alias("action"),
            F.when(fails, "failed").when(key % 2 == 0, "pending").otherwise("complete").alias("new_status"), F.when(key % 3 == 0, 50.0).alias("new_progress"),
            F.when(fails, "out of disk").alias("new_error"), F.create_map(F.lit("keeper"), F.col("l_returnflag")).alias("new_paths"),
        )
        log = log.unionByName(jobs.with_updates(log, change))
    return log


@query("job_log", """WITH u AS (SELECT l_orderkey AS k, bool_or(l_linenumber = 1) AS paused, bool_or(l_linenumber = 2 AND l_orderkey % 7 = 0) AS gone, bool_or(l_linenumber = 2 AND l_orderkey % 7 <> 0) AS cancelled,
 bool_or(l_linenumber = 3) AS moved, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS q, max(CASE WHEN l_linenumber = 3 THEN l_returnflag END) AS m FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey),
j AS (SELECT o_orderkey AS k, coalesce(paused, false) AS p, coalesce(gone, false) AS gone, coalesce(cancelled, false) AS c, coalesce(moved, false) AS moved, q, m FROM orders LEFT JOIN u ON u.k = o_orderkey),
s AS (SELECT *, CASE WHEN NOT moved THEN 'pending' WHEN q < 10 THEN 'failed' WHEN k % 2 = 0 THEN 'pending' ELSE 'complete' END AS status FROM j WHERE NOT gone)
SELECT CAST(k AS VARCHAR) AS job_id, status, CASE WHEN moved AND k % 3 = 0 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS progress, CASE WHEN status = 'failed' THEN 'out of disk' END AS error, p AND NOT (moved AND status = 'pending') AS pause_requested, c AND NOT (moved AND status = 'pending') AS cancel_requested, CASE WHEN moved THEN m END AS keeper FROM s""")
def job_log_state(spark, sf_dir):
    """What every job is after pauses, cancellations, deletions and changes of state."""
    now = jobs.current(job_log(spark, sf_dir))
    return now.select("job_id", "status", "progress", "error", "pause_requested", "cancel_requested", F.col("output_paths")["keeper"].alias("keeper"))


@query("event_reviews", f"""WITH {TL} SELECT stream_id, seq, CASE WHEN seq % 6 = 0 THEN seq % 4 = 0 ELSE review_override END AS review_override, seq % 6 = 0 AS reviewed,
 {MICRO.format('CASE WHEN seq % 3 = 0 AND seq % 10 > 0 THEN least(1.0, greatest(0.0, (seq % 10) / 4.0 - 0.5)) ELSE confidence END')} AS confidence_u FROM tl WHERE seq % 6 = 0 OR seq % 9 = 0""")
def event_reviews(spark, sf_dir):
    """Rows that reviews append: a word on inclusion, a confidence cut to 0..1, or both."""
    s = F.col("seq")
    e = timeline(spark, sf_dir).select(s.cast("string").alias("event_id"), "stream_id", "seq", "confidence", "review_override", F.lit(False).alias("reviewed"))
    u = e.where("seq % 6 = 0 OR seq % 9 = 0").select("event_id", F.when(s % 6 == 0, s % 4 == 0).alias("include"), F.when((s % 3 == 0) & (s % 10 > 0), (s % 10) / 4.0 - 0.5).alias("confidence"))
    return verdicts.reviewed(e, u).select("stream_id", "seq", "review_override", "reviewed", micro(F.col("confidence")).alias("confidence_u"))


NAMES = {"shot_on_target": "Shots & Goals", "goal_kick": "Set Pieces", "catch": "Saves", "kickoff": "Set Pieces", "corner_kick": "Other"}


def exported(spark, sf_dir) -> DataFrame:
    """The timelines as exported annotations: one document a stream."""
    tl, s = timeline(spark, sf_dir), F.col("seq")
    name = F.lit(None).cast("string")
    for k, v in NAMES.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    shot, save, piece = (F.col("event_type") == k for k in ("shot_on_target", "catch", "goal_kick"))
    outcome = F.when(shot & (s % 3 == 0), "Goals").when(shot & (s % 3 == 1), "Blocked Shots")
    type_ = F.when(save, F.when(s % 2 == 0, "Catches").otherwise("Parries")).when(piece, F.when(s % 4 == 0, "Goal Kicks").when(s % 4 == 1, "Direct Freekicks").when(s % 4 == 2, "Throw-Ins").otherwise("Odd")).when(shot & (s % 3 == 2), "Shots Off Target").when(F.col("event_type") == "corner_kick", F.when(s % 2 == 0, "Short Corners"))
    one = F.struct(name.alias("event_name"), F.struct(type_.alias("Type"), outcome.alias("Outcome")).alias("property"))
    row = F.struct(F.floor(F.col("t") * 1000).alias("event_time"), F.when(F.col("t") >= 2700, "2nd Half").otherwise("1st Half").alias("period_name"), s.cast("string").alias("team_name"), F.lit("p").alias("player_name"), F.col("x"), F.col("y"), F.array(one).alias("events"))
    return tl.groupBy(F.col("stream_id").alias("game")).agg(F.array_sort(F.collect_list(row)).alias("data"))


KINDS_SQL = f"""{TL}, n AS (SELECT *, floor(t * 1000) AS ms, CASE event_type WHEN 'shot_on_target' THEN 'Shots & Goals' WHEN 'goal_kick' THEN 'Set Pieces' WHEN 'catch' THEN 'Saves' WHEN 'kickoff' THEN 'Set Pieces' WHEN 'corner_kick' THEN 'Other' END AS name,
 CASE WHEN event_type = 'shot_on_target' THEN CASE seq % 3 WHEN 0 THEN 'Goals' WHEN 1 THEN 'Blocked Shots' END END AS outcome,
 CASE WHEN event_type = 'catch' THEN CASE seq % 2 WHEN 0 THEN 'Catches' ELSE 'Parries' END WHEN event_type = 'goal_kick' THEN CASE seq % 4 WHEN 0 THEN 'Goal Kicks' WHEN 1 THEN 'Direct Freekicks' WHEN 2 THEN 'Throw-Ins' ELSE 'Odd' END WHEN event_type = 'shot_on_target' AND seq % 3 = 2 THEN 'Shots Off Target' WHEN event_type = 'corner_kick' AND seq % 2 = 0 THEN 'Short Corners' END AS kind FROM tl)"""


@query("outcome_truths", f"""WITH {KINDS_SQL}, l AS (SELECT *, CASE WHEN name = 'Shots & Goals' AND outcome = 'Goals' THEN 'goal' WHEN name = 'Shots & Goals' AND outcome = 'Blocked Shots' THEN 'blocked_shot' WHEN name = 'Saves' AND kind = 'Catches' THEN 'catch' WHEN name = 'Saves' AND kind = 'Parries' THEN 'parry'
 WHEN name = 'Set Pieces' AND kind = 'Goal Kicks' THEN 'goal_kick' WHEN kind LIKE '%Corners%' THEN 'corner_kick' WHEN name = 'Set Pieces' AND kind = 'Throw-Ins' THEN 'throw_in' WHEN name = 'Set Pieces' AND kind LIKE '%Freekick%' THEN 'free_kick' END AS label FROM n)
SELECT stream_id AS game, seq, label, CAST(ms AS BIGINT) AS t_ms FROM l WHERE label IS NOT NULL""")
def outcome_truths(spark, sf_dir):
    """Annotations by outcome first, then by what the type holds."""
    return truths.outcome_truths(exported(spark, sf_dir)).select("game", F.col("team").cast("bigint").alias("seq"), "label", F.round(F.col("t") * 1000).cast("bigint").alias("t_ms"))


LABEL_SQL = "CASE WHEN name = 'Shots & Goals' AND coalesce(outcome, kind) = 'Goals' THEN 'goal' WHEN name = 'Shots & Goals' AND coalesce(outcome, kind) = 'Blocked Shots' THEN 'shot_blocked' WHEN name = 'Shots & Goals' AND coalesce(outcome, kind) = 'Shots Off Target' THEN 'shot_off_target' WHEN name = 'Saves' AND kind = 'Catches' THEN 'save_catch' WHEN name = 'Saves' AND kind = 'Parries' THEN 'save_parry' WHEN name = 'Set Pieces' AND kind = 'Goal Kicks' THEN 'goal_kick' WHEN name = 'Set Pieces' AND kind = 'Throw-Ins' THEN 'throw_in' END"
LABELLED = f"{KINDS_SQL}, l AS (SELECT * FROM (SELECT *, {LABEL_SQL} AS label, CASE WHEN t >= 2700 THEN 2 ELSE 1 END AS half FROM n) WHERE label IS NOT NULL)"


@query("labelled_truths", f"WITH {LABELLED} SELECT stream_id AS game, seq, label, half, CAST(floor((ms / 1000.0 + CASE half WHEN 1 THEN 12.5 ELSE 640.0 END) * 1000 + 0.5) AS BIGINT) AS t_ms FROM l")
def labelled_truths(spark, sf_dir):
    """Annotations with one of twelve labels, on the clock of the video by each game's offsets."""
    docs = exported(spark, sf_dir)
    offsets = docs.select("game", F.lit(12.5).alias("h1_offset"), F.lit(640.0).alias("h2_offset"))
    out = truths.on_video(truths.labelled_truths(docs), offsets)
    return out.select("game", F.col("team").cast("bigint").alias("seq"), "label", "half", F.floor(F.col("t") * 1000 + 0.5).cast("bigint").alias("t_ms"))


def first_sql(kinds: str) -> str:
    return f"""f AS (SELECT stream_id, half, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, arg_min(ms, ms) FILTER (label IN ({kinds})) AS ms, arg_min(label, (ms, seq)) FILTER (label IN ({kinds})) AS label FROM l GROUP BY stream_id, half),
a AS (SELECT stream_id FROM l GROUP BY stream_id), b AS (SELECT a.stream_id, x.ms AS ms1, x.label AS label1, y.ms AS ms2, y.label AS label2, coalesce(x.n, 0) AS n1, coalesce(y.n, 0) AS n2, x.first_ms AS first1, x.last_ms AS last1, y.first_ms AS first2 FROM a LEFT JOIN f x ON x.stream_id = a.stream_id AND x.half = 1 LEFT JOIN f y ON y.stream_id = a.stream_id AND y.half = 2)"""


@query("calibration_template", f"""WITH {LABELLED}, {first_sql("'throw_in', 'corner_kick', 'goal_kick', 'free_kick'")}
SELECT stream_id AS game, CAST(ms1 AS BIGINT) AS ms1, label1, CAST(ms2 AS BIGINT) AS ms2, label2, 'Total events: H1=' || n1 || ', H2=' || n2 AS notes FROM b""")
def calibration_template(spark, sf_dir):
    """The first set piece of each half, to be looked up in the video."""
    t = truths.calibration_template(truths.labelled_truths(exported(spark, sf_dir)))
    return t.select("game", F.col("h1_anchor_event_ms").alias("ms1"), F.col("h1_anchor_event_label").alias("label1"), F.col("h2_anchor_event_ms").alias("ms2"), F.col("h2_anchor_event_label").alias("label2"), "notes")


@query("game_clocks", f"""WITH {LABELLED}, {first_sql("'throw_in', 'corner_kick', 'goal_kick'")}
SELECT stream_id AS game, 700 AS h1_s, CAST(floor((4200.0 - first2 / 1000.0) * 10 + 0.5) AS BIGINT) AS h2_tenths, CAST(floor((700.0 + 610.0 - (first2 - last1) / 1000.0) * 10 + 0.5) AS BIGINT) AS expected_tenths, CAST(coalesce(ms1, first1) AS BIGINT) AS ms1, CAST(coalesce(ms2, first2) AS BIGINT) AS ms2, 'H1=' || n1 || ', H2=' || n2 || ' events' AS notes FROM b WHERE n1 > 0 AND n2 > 0""")
def game_clocks(spark, sf_dir):
    """Clock rows of games: offsets from kickoffs, the second checked against half-time, and anchors."""
    docs = exported(spark, sf_dir)
    moves = docs.select("game", F.lit(700.0).alias("h1_kickoff"), F.lit(3500.0).alias("ht_start"), F.lit(4110.0).alias("ht_end"), F.lit(4200.0).alias("h2_kickoff"))
    rows = truths.game_rows(truths.labelled_truths(docs), moves)
    tenths = lambda c: F.round(F.col(c) * 10).cast("bigint")
    return rows.select("game", F.col("h1_offset_sec").cast("int").alias("h1_s"), tenths("h2_offset_sec").alias("h2_tenths"), tenths("expected_h2_offset_sec").alias("expected_tenths"), F.col("h1_anchor_event_ms").alias("ms1"), F.col("h2_anchor_event_ms").alias("ms2"), "notes")


@query("category_truths", f"""WITH {TL} SELECT stream_id AS game, CASE event_type WHEN 'catch' THEN 'saves' ELSE event_type END AS event_type, CAST(floor(t * 1000) AS BIGINT) + 800000 AS t_ms FROM tl WHERE event_type IN ('goal_kick', 'shot_on_target', 'catch')""")
def category_truths(spark, sf_dir):
    """Truths kept as one array a category, two keepers' arrays joined."""
    tl = timeline(spark, sf_dir)
    moment = F.struct(F.floor(F.col("t") * 1000).alias("time_ms"), F.lit(1).alias("half"))
    lists = lambda c: F.struct(F.collect_list(F.when(c, moment)).alias("events"))
    own = lambda k: F.col("event_type") == k
    even = F.col("seq") % 2 == 0
    none = F.lit(None).cast("struct<events:array<struct<time_ms:bigint,half:int>>>")
    docs = tl.groupBy(F.col("stream_id").alias("game")).agg(
        none.alias("goals"), lists(own("shot_on_target")).alias("shots_on_target"), none.alias("corners"), none.alias("throw_ins"), none.alias("free_kicks"),
        F.struct(lists(own("goal_kick") & even).alias("elena_goal_kicks"), lists(own("goal_kick") & ~even).alias("opponent_goal_kicks")).alias("goal_kicks"),
        F.struct(lists(own("catch") & even).alias("elena_saves"), lists(own("catch") & ~even).alias("opponent_gk_saves")).alias("saves"))
    return truths.category_truths(docs).select("game", "event_type", F.round(F.col("t") * 1000).cast("bigint").alias("t_ms"))


CLOCK_SQL = f"""WITH {TL}, s AS (SELECT stream_id, seq, t, confidence, CASE event_type WHEN 'signup' THEN NULL WHEN 'kickoff' THEN 'goal' WHEN 'catch' THEN 'shot' END AS signal FROM tl WHERE event_type IN ('kickoff', 'catch') AND seq % 4 = 0),
g AS (SELECT *, CASE WHEN t < 2700 THEN 0 ELSE 1 END AS half FROM s), d AS (SELECT stream_id, signal, t + CASE WHEN half = 0 THEN 40 ELSE 640 END AS t FROM g WHERE seq % 3 > 0),
h AS (SELECT * FROM g WHERE stream_id IN (SELECT stream_id FROM d)),
p AS (SELECT a * 20.0 AS vo, a * 20.0 + 2700 + b * 100.0 AS h2 FROM range(0, 6) x(a), range(3, 9) y(b)),
m AS (SELECT h.stream_id, h.signal, h.seq, p.vo, p.h2, min(abs(d.t - CASE half WHEN 0 THEN h.t + p.vo ELSE h.t - 2700 + p.h2 END)) AS e FROM h, p, d WHERE d.stream_id = h.stream_id AND d.signal = h.signal AND abs(d.t - CASE half WHEN 0 THEN h.t + p.vo ELSE h.t - 2700 + p.h2 END) <= 5 GROUP BY ALL),
c AS (SELECT stream_id, vo, h2, sum(CASE signal WHEN 'goal' THEN 10.0 ELSE 1.0 END) AS score, floor(sum(e * e) * 1000) AS ssr, count(*) AS n FROM m GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, ssr, vo, h2) AS r FROM c) SELECT stream_id, CAST(vo AS INTEGER) AS video_offset, CAST(h2 AS INTEGER) AS half2_start, CAST(score AS INTEGER) AS score, n AS matches FROM b WHERE r = 1"""


def clock_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = timeline(spark, sf_dir).where("event_type IN ('kickoff', 'catch') AND seq % 4 = 0")
    s = s.withColumn("signal", F.when(F.col("event_type") == "kickoff", "goal").otherwise("shot")).withColumn("half", (F.col("t") >= 2700).cast("int"))
    shifted = s.where("seq % 3 > 0").withColumn("t", F.col("t") + F.when(F.col("half") == 0, 40).otherwise(640))
    return s.select("stream_id", "seq", "signal", "half", "t"), shifted.select("stream_id", "seq", "signal", "t")


@query("clock_grid", CLOCK_SQL)
def clock_grid(spark, sf_dir):
    """The offset and the start of the second half at which weighted matches are most, over one grid."""
    want, found = clock_sides(spark, sf_dir)
    signals = F.explode(F.array(F.struct(F.lit("goal").alias("signal"), F.lit(10.0).alias("weight")), F.struct(F.lit("shot").alias("signal"), F.lit(1.0).alias("weight"))))
    points = want.select("stream_id").distinct().withColumn("video_offset", F.explode(F.array(*(F.lit(x) for x in clock.grid(0.0, 100.0, 20.0))))).withColumn("rest", F.explode(F.array(*(F.lit(x) for x in clock.grid(300.0, 800.0, 100.0)))))
    points = points.withColumn("half2_start", F.col("video_offset") + 2700 + F.col("rest")).withColumn("s", signals).select("stream_id", "video_offset", "half2_start", "s.*")
    out = clock.best(clock.scored(want, found, points, 2700.0, 5.0).where("matches > 0"))
    return out.select("stream_id", *(F.col(c).cast("int").alias(c) for c in ("video_offset", "half2_start", "score")), "matches")


@query("clock_search")
def clock_search(spark, sf_dir):
    """The same from coarse to fine; tests hold it against a plain search."""
    want, found = clock_sides(spark, sf_dir)
    return clock.search(want, found, {"goal": 10.0, "shot": 1.0}, tolerance=5.0, coarse=((0.0, 100.0, 20.0), (300.0, 800.0, 100.0)), fine=((20.0, 5.0), (40.0, 10.0)))


@query("anchor_search", f"""WITH {TL}, a AS (SELECT * FROM tl WHERE {is_('kickoff')}), p AS (SELECT a.stream_id, a.seq, a.t, greatest(0.0, a.t - 180) + k * 10.0 AS q FROM a, range(0, 37) r(k) WHERE greatest(0.0, a.t - 180) + k * 10.0 <= a.t + 180),
f AS (SELECT stream_id, seq, min(q) AS q FROM p WHERE CAST(floor(q * 1e6 + 0.5) AS BIGINT) % 13 = 5 GROUP BY ALL) SELECT a.stream_id, a.seq, {MICRO.format('f.q')} AS found_u FROM a LEFT JOIN f USING (stream_id, seq)""")
def anchor_search(spark, sf_dir):
    """The first of the times around an anchor at which a model saw the event."""
    a = kind(timeline(spark, sf_dir), "kickoff").select("stream_id", "seq", "t", "event_type")
    probes = a.select("stream_id", "event_type", (F.greatest(F.lit(0.0), F.col("t") - 180.0)).alias("from")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(36)))).withColumn("t", F.col("from") + F.col("k") * 10.0)
    said = probes.withColumn("is_match", micro(F.col("t")) % 13 == 5)
    return clock.first_match(a, said).select("stream_id", "seq", micro(F.col("found")).alias("found_u"))


@query("focused_answers", f"""WITH {TL}, q AS (SELECT *, floor(confidence * 1000) / 1000 AS c, seq % 8 AS k FROM tl),
r AS (SELECT stream_id, seq, k, c, CASE WHEN k = 7 THEN 'uncertain' WHEN k = 6 OR c < 0.5 THEN 'rejected' ELSE 'confirmed' END AS result FROM q)
SELECT stream_id, seq, result, CASE WHEN result = 'confirmed' THEN CASE k WHEN 0 THEN 'goal_kick' WHEN 1 THEN 'corner_kick' WHEN 2 THEN 'shot_off_target' WHEN 3 THEN 'catch' WHEN 4 THEN 'goal' WHEN 5 THEN 'kickoff' END END AS event_type,
 CASE WHEN k = 7 THEN '' WHEN result = 'confirmed' AND k = 2 THEN 'SHOT_SCAN: seen' WHEN result = 'confirmed' AND k = 3 THEN 'CATCH_SCAN: seen' WHEN result = 'confirmed' AND k = 4 THEN 'GOAL_CELEBRATION: seen' ELSE 'seen' END AS reasoning, {MICRO.format('CASE WHEN k = 7 THEN 0.5 ELSE c END')} AS confidence_u FROM r""")
def focused_answers(spark, sf_dir):
    """Answers to single questions, each with its own fields: fenced, in prose, saying no, and broken."""
    k, c = F.col("seq") % 8, F.floor(F.col("confidence") * 1000) / 1000
    tail = F.concat(F.lit(', "confidence": '), c.cast("string"), F.lit(', "reasoning": "seen"}'))
    text = [
        ("set_piece", F.concat(F.lit('```json\n{"restart": "goal_kick"'), tail, F.lit("\n```"))), ("corner", F.concat(F.lit('{"is_corner": true'), tail)), ("shot", F.concat(F.lit('Sure: {"is_shot": true, "shot_type": "blocked"'), tail)),
        ("catch", F.concat(F.lit('<think>hm</think>{"is_catch": true'), tail)), ("celebration", F.concat(F.lit('{"is_goal": true'), tail)), ("kickoff", F.concat(F.lit('json {"is_kickoff": true'), tail)), ("kickoff", F.concat(F.lit('{"is_kickoff": false'), tail)), ("shot", F.lit("no idea")),
    ]
    v = F.lit(None)
    for i, (question, answer) in enumerate(text):
        v = F.when(k == i, answers.focused_verdict(answer, question)).otherwise(v)
    out = timeline(spark, sf_dir).withColumn("v", v)
    return out.select("stream_id", "seq", "v.result", "v.event_type", "v.reasoning", micro(F.col("v.confidence")).alias("confidence_u"))


@query("scene_states", f"""WITH {TL}, b AS (SELECT *, seq % 4 AS k FROM tl) SELECT stream_id, seq, 0 AS i, {MICRO.format('t')} AS t_u, CASE WHEN k = 0 THEN 'stoppage' ELSE 'active_play' END AS state FROM b
UNION ALL SELECT stream_id, seq, 1, {MICRO.format('CASE WHEN k = 2 THEN 7.5 ELSE t + 1 END')}, CASE WHEN k IN (0, 2) THEN 'replay' ELSE 'active_play' END FROM b""")
def scene_states(spark, sf_dir):
    """States of frames: known and unknown ones, an index out of range, and an answer that is no list."""
    k = F.col("seq") % 4
    answer = F.when(k == 0, '[{"frame_index": 0, "state": "stoppage"}, {"frame_index": 1, "state": "replay"}]').when(k == 1, '[{"frame_index": 0, "state": "party"}, {"frame_index": 1}]').when(k == 2, '```json\n[{"frame_index": 0}, {"frame_index": 9, "timestamp": 7.5, "state": "replay"}]\n```').otherwise("nothing to see")
    out = timeline(spark, sf_dir).select("stream_id", "seq", F.posexplode(answers.scene_labels(answer, F.array("t", F.col("t") + 1))).alias("i", "s"))
    return out.select("stream_id", "seq", "i", micro(F.col("s.t")).alias("t_u"), F.col("s.state").alias("state"))


@query("boundary_events", f"""WITH {TL}, m AS (SELECT stream_id, max(t) AS duration FROM tl GROUP BY stream_id), b AS (SELECT tl.*, duration, seq % 4 AS k FROM tl JOIN m USING (stream_id)),
e AS (SELECT *, greatest(0.0, CASE k WHEN 0 THEN t - 3 ELSE t - 10 END) AS a, least(duration, CASE k WHEN 0 THEN t + 4 WHEN 2 THEN t - 20 ELSE t + 10 END) AS z FROM b WHERE k < 3)
SELECT stream_id, seq, event_type, {MICRO.format('a')} AS start_u, {MICRO.format('z')} AS end_u, CAST(trunc(a * 30) AS BIGINT) AS frame_start FROM e WHERE z > a""")
def boundary_events(spark, sf_dir):
    """Events of refined boundaries: given, by default, empty, and refused."""
    tl, k = timeline(spark, sf_dir), F.col("seq") % 4
    extent = tl.groupBy("stream_id").agg(F.max("t").alias("duration"))
    said = F.when(k == 0, F.concat(F.lit('{"confirmed": true, "clip_start_sec": '), (F.col("t") - 3).cast("string"), F.lit(', "clip_end_sec": '), (F.col("t") + 4).cast("string"), F.lit("}"))).when(k == 1, '{"confirmed": true}').when(
        k == 2, F.concat(F.lit('{"confirmed": true, "clip_end_sec": '), (F.col("t") - 20).cast("string"), F.lit("}"))).otherwise("I cannot confirm this")
    b = tl.withColumn("b", answers.boundary(said, F.col("t"))).join(extent, "stream_id").select("stream_id", "seq", "event_type", "duration", "b.*")
    return verdicts.boundary_events(b).select("stream_id", "seq", "event_type", micro(F.col("timestamp_start")).alias("start_u"), micro(F.col("timestamp_end")).alias("end_u"), "frame_start")


PREDICTED = f"{TL}, p AS (SELECT *, CASE seq % 5 WHEN 0 THEN 'catch' WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 3 THEN 'none' ELSE 'parse_error' END AS said FROM tl)"


def predicted(spark, sf_dir) -> DataFrame:
    k = F.col("seq") % 5
    answer = F.when(k == 0, '{"event": "catch", "confidence": 0.9}').when(k == 1, F.concat(F.lit('```json\n{"event": "'), "event_type", F.lit('"}\n```'))).when(k == 2, F.concat(F.lit('I think {"event": "'), "event_type", F.lit('", "confidence": 0.7} fits'))).when(k == 3, "{}").otherwise("none of these")
    return timeline(spark, sf_dir).withColumn("p", answers.prediction(answer)).select("stream_id", "seq", "event_type", F.col("p.event").alias("said"), F.col("p.confidence").alias("sure"))


@query("predictions", f"WITH {PREDICTED} SELECT stream_id, seq, said, CASE seq % 5 WHEN 0 THEN 90 WHEN 1 THEN 50 WHEN 2 THEN 70 WHEN 3 THEN 50 ELSE 0 END AS sure_pct FROM p")
def predictions(spark, sf_dir):
    """Predicted labels as evaluation reads them from answers."""
    return predicted(spark, sf_dir).select("stream_id", "seq", "said", F.round(F.col("sure") * 100).cast("int").alias("sure_pct"))


REPORT = f"""{PREDICTED}, n AS (SELECT event_type AS a, said AS b, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (
 SELECT a AS label, CASE WHEN a = b THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN a <> b THEN n ELSE 0 END AS fn FROM n UNION ALL SELECT b, 0, n, 0 FROM n WHERE a <> b) GROUP BY label),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS q FROM s), f AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1 FROM r)"""
P4 = "CAST(floor({0} * 1e4 + 0.5) AS BIGINT)"


@query("class_report", f"WITH {REPORT} SELECT label, tp, fp, fn, tp + fn AS support, {P4.format('p')} AS p4, {P4.format('q')} AS r4, {P4.format('f1')} AS f4 FROM f")
def class_report(spark, sf_dir):
    """Counts and rates of each class."""
    four = lambda c: F.round(F.col(c) * 1e4).cast("bigint")
    return evaluate.class_report(predicted(spark, sf_dir), "event_type", "said").select("label", "tp", "fp", "fn", "support", four("precision").alias("p4"), four("recall").alias("r4"), four("f1").alias("f4"))


@query("macro_averages", f"WITH {REPORT} SELECT CAST(sum(tp + fn) AS BIGINT) AS samples, CAST(sum(tp) AS BIGINT) AS correct, CAST(floor(sum(tp) / sum(tp + fn)::DOUBLE * 1e4 + 0.5) AS BIGINT) AS accuracy4, count(*) AS classes FROM f")
def macro_averages(spark, sf_dir):
    """Accuracy over all samples and the number of classes that averages are over."""
    rep = evaluate.class_report(predicted(spark, sf_dir), "event_type", "said")
    return evaluate.overall(rep).select("samples", "correct", F.round(F.col("accuracy") * 1e4).cast("bigint").alias("accuracy4"), F.lit(rep.count()).cast("bigint").alias("classes"))


@query("refiner_counts", f"WITH {TL} SELECT event_type, count(*) AS total, count(*) FILTER (seq % 5 IN (1, 2)) AS confirmed, count(*) FILTER (seq % 5 IN (3, 4)) AS rejected, count(*) FILTER (seq % 5 = 0) AS errors, count(*) FILTER (event_type NOT IN ('catch', 'kickoff')) AS no_evidence FROM tl GROUP BY event_type")
def refiner_counts(spark, sf_dir):
    """What refinement confirmed, refused and failed on, by type."""
    s = F.col("seq") % 5
    rows = timeline(spark, sf_dir).withColumn("confirmed", F.when(s.isin(1, 2), True).when(s.isin(3, 4), False))
    return summaries.refinements(rows, ["catch", "kickoff"])


@query("grounding_summary", f"WITH {TL} SELECT event_type, CASE seq % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'far' ELSE 'no ball' END AS reason, count(*) FILTER (seq % 3 <> 1) AS kept, count(*) FILTER (seq % 3 = 1) AS dropped, count(*) FILTER (seq % 3 < 2) AS with_ball FROM tl GROUP BY ALL")
def grounding_summary(spark, sf_dir):
    """Kept and dropped events by type and reason."""
    s = F.col("seq") % 3
    rows = timeline(spark, sf_dir).withColumn("keep", s != 1).withColumn("reason", F.when(s == 0, "near").when(s == 1, "far").otherwise("no ball")).withColumn("ball_detected", s < 2)
    return summaries.grounding(rows)


@query("frame_bests", f"""WITH {TL}, b AS (SELECT stream_id, floor(t / 30) AS f, seq, confidence, CASE WHEN seq % 3 = 0 THEN 'ball' ELSE 'person' END AS cls FROM tl), m AS (SELECT stream_id, max(n) AS n FROM (SELECT stream_id, f, count(*) FILTER (cls = 'person') AS n FROM b GROUP BY ALL) GROUP BY stream_id),
t AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY confidence DESC, f, seq) AS r, count(*) OVER (PARTITION BY stream_id) AS boxes FROM b WHERE cls = 'ball')
SELECT stream_id, m.n AS persons_max, coalesce(boxes, 0) AS boxes, seq AS best_seq FROM m LEFT JOIN t USING (stream_id) WHERE coalesce(r, 1) = 1""")
def frame_bests(spark, sf_dir):
    """The most confident ball of a stream and the most persons in one of its frames."""
    rows = timeline(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 30).cast("double")).withColumn("cls", F.when(F.col("seq") % 3 == 0, "ball").otherwise("person"))
    return summaries.frame_bests(rows, "ball", "person").select("stream_id", "persons_max", "boxes", "best_seq")


@query("hit_miss", f"""WITH {TL}, g AS (SELECT * FROM tl WHERE seq % 2 = 0), h AS (SELECT g.event_type, count(*) AS hit FROM g WHERE EXISTS (SELECT 1 FROM tl d WHERE d.stream_id = g.stream_id AND d.event_type = g.event_type AND d.seq % 2 = 1 AND abs(d.t - g.t) <= 20) GROUP BY g.event_type)
SELECT event_type, count(*) AS truths, coalesce(any_value(hit), 0) AS hit, count(*) - coalesce(any_value(hit), 0) AS missed FROM g LEFT JOIN h USING (event_type) GROUP BY event_type""")
def hit_miss(spark, sf_dir):
    """Truths with any detection of their type near, by type."""
    tl = timeline(spark, sf_dir)
    return summaries.hits(tl.where("seq % 2 = 0"), tl.where("seq % 2 = 1"), 20.0)


@query("lift_matrix", f"""WITH {TL}, d AS (SELECT sum(x) AS s FROM (SELECT max(t) AS x FROM tl GROUP BY stream_id)), c AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'whistle' ELSE 'surge' END AS cue FROM tl WHERE seq % 5 < 2), k AS (SELECT cue, count(*) AS n FROM c GROUP BY cue), g AS (SELECT * FROM tl WHERE seq % 5 > 2),
m AS (SELECT event_type, cue, count(*) AS near FROM (SELECT DISTINCT g.event_type, c.cue, g.stream_id, g.seq FROM g JOIN c ON c.stream_id = g.stream_id AND abs(c.t - g.t) <= 4) GROUP BY ALL), n AS (SELECT event_type, count(*) AS truths FROM g GROUP BY event_type)
SELECT event_type, cue, truths, near, {MICRO.format('(near / truths::DOUBLE - (1 - exp(-(k.n / greatest(1.0, d.s)) * 2 * 4)))')} AS lift_u FROM m JOIN n USING (event_type) JOIN k USING (cue), d""")
def lift_matrix(spark, sf_dir):
    """How much more often than by chance a cue is near a truth, by types of both."""
    tl = timeline(spark, sf_dir)
    cues = tl.where("seq % 5 < 2").withColumn("cue", F.when(F.col("seq") % 5 == 0, "whistle").otherwise("surge"))
    out = summaries.lift(tl.where("seq % 5 > 2"), cues, tl.groupBy("stream_id").agg(F.max("t").alias("duration")), 4.0)
    return out.select("event_type", "cue", "truths", "near", micro(F.col("lift")).alias("lift_u"))


@query("call_throughput", f"WITH {TL} SELECT event_type, count(*) AS calls, count(*) FILTER (seq % 4 = 0) AS flagged, CAST(sum(seq % 7) AS BIGINT) AS seconds, {MICRO.format('count(*) / greatest(sum(seq % 7), 0.01)')} AS per_second_u FROM tl GROUP BY event_type")
def call_throughput(spark, sf_dir):
    """Calls a second and flagged ones, by type."""
    rows = timeline(spark, sf_dir).withColumn("flag", F.col("seq") % 4 == 0).withColumn("seconds", F.col("seq") % 7)
    return summaries.throughput(rows, "event_type").select("event_type", "calls", "flagged", "seconds", micro(F.col("per_second")).alias("per_second_u"))


@query("run_deltas", f"WITH {TL} SELECT event_type, count(*) FILTER (seq % 2 = 0) AS events_now, count(*) FILTER (seq % 3 = 0) AS events_before, count(*) FILTER (seq % 2 = 0) - count(*) FILTER (seq % 3 = 0) AS events_delta FROM tl WHERE seq % 2 = 0 OR seq % 3 = 0 GROUP BY event_type")
def run_deltas(spark, sf_dir):
    """Counts of two runs and their differences."""
    tl = timeline(spark, sf_dir)
    count = lambda d: d.groupBy("event_type").agg(F.count("*").alias("events"))
    return summaries.deltas(count(tl.where("seq % 2 = 0")), count(tl.where("seq % 3 = 0")), "event_type", "events")


@query("training_records", f"""WITH {LABELLED}, x AS (SELECT *, 0 AS mirror FROM l UNION ALL SELECT *, 1 FROM l WHERE label IN ('goal', 'save_catch', 'save_parry', 'shot_off_target', 'shot_blocked', 'goal_kick')), k AS (SELECT * FROM x WHERE seq % 10 < 8)
SELECT stream_id AS game, seq, mirror, 'What happens in 20.0 seconds?' AS query, '{{"event":"' || label || '","confidence":0.95,"reasoning":"' || CASE label WHEN 'goal' THEN 'They celebrate.' ELSE 'Cannot determine the event type.' END || '"}}' AS response, 8 AS images FROM k""")
def training_records(spark, sf_dir):
    """Records of samples and of their mirror images; samples with too few frames go."""
    t = truths.labelled_truths(exported(spark, sf_dir)).withColumn("t", F.col("ms") / 1000.0)
    s = F.col("team").cast("bigint")
    rows = t.withColumn("augmentation", F.lit("none")).withColumn("window_start", F.col("t") - 10).withColumn("window_end", F.col("t") + 10).withColumn("frames", F.transform(F.sequence(F.lit(1), F.when(s % 10 < 8, 9).otherwise(5)), lambda i: F.concat(F.col("team"), F.lit("/"), i.cast("string"))))
    out = records.records(records.mirrored(rows), records.window_query("What happens in %.1f seconds?"), records.class_response({"goal": "They celebrate."}))
    return out.select("_meta.game", F.split(F.get("images", F.lit(0)), "/")[0].cast("bigint").alias("seq"), (F.col("_meta.augmentation") == "mirror").cast("int").alias("mirror"), "query", "response", F.size("images").alias("images"))


@query("record_split", f"WITH {LABELLED}, h AS (SELECT max(stream_id) AS m FROM l) SELECT label, CASE WHEN stream_id = h.m THEN 'holdout' ELSE 'rest' END AS part, count(*) AS records FROM l, h GROUP BY ALL")
def record_split(spark, sf_dir):
    """Records by label, in the held-out game and outside it."""
    t = truths.labelled_truths(exported(spark, sf_dir))
    last = t.agg(F.max("game")).first()[0]
    return records.split(t, F.col("team"), [last], 10).groupBy("label", F.when(F.col("split") == "holdout", "holdout").otherwise("rest").alias("part")).agg(F.count("*").alias("records"))


@query("jersey_colours", f"""WITH {TL}, j AS (SELECT stream_id, seq, CASE seq % 4 WHEN 0 THEN 'Sky Blue' WHEN 1 THEN 'neon-green' WHEN 2 THEN 'burgundy' ELSE 'plaid' END AS jersey FROM tl)
SELECT stream_id, seq, jersey, CASE jersey WHEN 'Sky Blue' THEN 103 WHEN 'neon-green' THEN 55 WHEN 'burgundy' THEN 170 END AS hue FROM j""")
def jersey_colours(spark, sf_dir):
    """The hue of a jersey's colour by name; unknown names have none."""
    s = F.col("seq") % 4
    rows = timeline(spark, sf_dir).withColumn("jersey", F.when(s == 0, "Sky Blue").when(s == 1, "neon-green").when(s == 2, "burgundy").otherwise("plaid"))
    return summaries.with_jersey(rows, "jersey").select("stream_id", "seq", "jersey", F.col("hue").cast("int").alias("hue"))


CONTACT_SQL = f"""WITH {TL}, s AS (SELECT stream_id, seq, event_type, x, y, CAST(floor(t / 600) AS BIGINT) AS track, floor(t / 25) * 25 AS t FROM tl),
b AS (SELECT *, row_number() OVER w - 1 AS i, lag(t) OVER w AS t0, lag(x) OVER w AS x0, lag(y) OVER w AS y0, count(*) OVER (PARTITION BY stream_id, track) AS n FROM s WHERE {is_('shot_on_target')} WINDOW w AS (PARTITION BY stream_id, track ORDER BY t, seq)),
k AS (SELECT * FROM s WHERE {is_('corner_kick')}),
p AS (SELECT b.stream_id, b.track, b.i, sqrt((b.x - k.x) * (b.x - k.x) + (b.y - k.y) * (b.y - k.y)) AS d FROM b JOIN k ON b.stream_id = k.stream_id AND b.track = k.track AND b.t = k.t),
m AS (SELECT stream_id, track, arg_min(i, (d, i)) AS c, min(d) AS d FROM p GROUP BY ALL),
f AS (SELECT b.*, m.d, CASE WHEN coalesce(m.c, n // 2) < 1 THEN 1 WHEN coalesce(m.c, n // 2) > n - 2 AND n > 2 THEN n - 2 ELSE coalesce(m.c, n // 2) END AS c FROM b LEFT JOIN m USING (stream_id, track)),
v AS (SELECT stream_id, track, max(n) AS n, max(d) AS d, coalesce(avg((x - x0) / (t - t0)) FILTER (i <= c AND t > t0), 0) AS px, coalesce(avg((y - y0) / (t - t0)) FILTER (i <= c AND t > t0), 0) AS py,
 coalesce(avg((x - x0) / (t - t0)) FILTER (i > c AND t > t0), 0) AS qx, coalesce(avg((y - y0) / (t - t0)) FILTER (i > c AND t > t0), 0) AS qy FROM f GROUP BY ALL),
g AS (SELECT *, sqrt(px * px + py * py) AS u, sqrt(qx * qx + qy * qy) AS w FROM v),
h AS (SELECT *, CASE WHEN u > 0.000001 THEN w / u ELSE 1 END AS ratio, CASE WHEN u < 0.000001 OR w < 0.000001 THEN 0 ELSE degrees(acos(greatest(-1, least(1, (px * qx + py * qy) / (u * w))))) END AS angle FROM g)
SELECT stream_id, track, CAST(n AS BIGINT) AS points, {MICRO.format('d')} AS distance_u, CASE WHEN n < 3 OR greatest(u, w) < 0.01 THEN 'insufficient_data' WHEN angle >= 90 THEN 'parry' WHEN ratio <= 0.3 THEN 'catch' WHEN angle >= 30 THEN 'deflection' WHEN ratio >= 0.8 THEN 'missed' ELSE 'deflection' END AS signature FROM h"""


@query("contact_signatures", CONTACT_SQL)
def contact_signatures(spark, sf_dir):
    """What the ball did at its contact with a keeper, of each track of ten minutes."""
    from tideline.plans import spatial

    rows = timeline(spark, sf_dir).withColumn("track", F.floor(F.col("t") / 600).cast("bigint")).withColumn("t", F.floor(F.col("t") / 25) * 25.0)
    out = spatial.contact_signatures(kind(rows, "shot_on_target"), kind(rows, "corner_kick"), "stream_id", "track")
    return out.select("stream_id", "track", "points", micro(F.col("distance")).alias("distance_u"), "signature")


@query("flat_confidences", f"WITH {TL}, r AS (SELECT CASE WHEN stream_id < '2024-01-10' THEN stream_id ELSE 'rest' END AS stream_id, CASE WHEN stream_id < '2024-01-10' THEN 0.5 + (seq % 2) / 10.0 ELSE confidence END AS confidence FROM tl) SELECT stream_id, count(*) AS n, count(DISTINCT floor(confidence * 100 + 0.5)) AS values FROM r GROUP BY stream_id HAVING count(*) > 20 AND count(DISTINCT floor(confidence * 100 + 0.5)) <= 2")
def flat_confidences(spark, sf_dir):
    """Streams whose model always says the same confidence."""
    from tideline.plans import routing

    early = F.col("stream_id") < "2024-01-10"
    rows = timeline(spark, sf_dir).withColumn("confidence", F.when(early, 0.5 + (F.col("seq") % 2) / 10.0).otherwise(F.col("confidence"))).withColumn("stream_id", F.when(early, F.col("stream_id")).otherwise("rest"))
    return routing.flat_confidences(rows)


@query("recorded_answers", f"""WITH {TL}, r AS (SELECT stream_id, t, arg_max('answer ' || seq, seq) AS response FROM tl WHERE seq % 3 = 0 GROUP BY stream_id, t) SELECT tl.stream_id, tl.seq, r.response FROM tl LEFT JOIN r ON r.stream_id = tl.stream_id AND r.t = tl.t""")
def recorded_answers(spark, sf_dir):
    """Rows with what a model answered to one prompt, and nothing where it did not."""
    from tideline.plans import routing

    tl = timeline(spark, sf_dir)
    said = tl.withColumn("prompt", F.when(F.col("seq") % 3 == 0, "triage").otherwise("other")).withColumn("response", F.concat(F.lit("answer "), F.col("seq").cast("string")))
    return routing.scored(tl.select("stream_id", "seq", "t"), said, "triage").select("stream_id", "seq", "response")


@query("prometheus_lines", "SELECT 'jobs_total{status=\"' || s || '\"} ' || count(o_orderkey) AS value FROM (VALUES ('pending'), ('ingesting'), ('detecting'), ('segmenting'), ('assembling'), ('complete'), ('failed'), ('paused'), ('cancelled')) v(s) LEFT JOIN orders ON CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'detecting' END = s GROUP BY s")
def prometheus_lines(spark, sf_dir):
    """Counts of jobs by status as text exposition, zeros included."""
    from tideline.queries.review import _jobs

    return jobs.prometheus(jobs.by_status(_jobs(spark, sf_dir)))


@query("clip_signatures", f"""WITH {TL}, s AS (SELECT stream_id, CAST(floor(t / 60) AS BIGINT) AS clip, list(CASE seq % 6 WHEN 0 THEN 'insufficient_data' WHEN 1 THEN 'missed' WHEN 2 THEN 'deflection' WHEN 3 THEN 'catch' WHEN 4 THEN 'parry' ELSE 'odd' END) AS a FROM tl GROUP BY ALL)
SELECT stream_id, clip, CASE WHEN list_contains(a, 'parry') THEN 'parry' WHEN list_contains(a, 'catch') THEN 'catch' WHEN list_contains(a, 'deflection') THEN 'deflection' WHEN list_contains(a, 'missed') THEN 'missed' WHEN list_contains(a, 'insufficient_data') THEN 'insufficient_data' END AS signature FROM s""")
def clip_signatures(spark, sf_dir):
    """The signature that a clip of several events gets."""
    from tideline.plans import reels

    s = F.col("seq") % 6
    own = F.when(s == 0, "insufficient_data").when(s == 1, "missed").when(s == 2, "deflection").when(s == 3, "catch").when(s == 4, "parry").otherwise("odd")
    c = timeline(spark, sf_dir).withColumn("own", own).groupBy("stream_id", F.floor(F.col("t") / 60).cast("bigint").alias("clip")).agg(F.collect_set("own").alias("all"))
    return c.select("stream_id", "clip", reels.signature_of(F.col("all")).alias("signature"))


RUNS_SQL = f"""{TL}, s AS (SELECT *, confidence >= 0.3 AS active, lead(t) OVER w AS nt, row_number() OVER w - row_number() OVER (PARTITION BY stream_id, confidence >= 0.3 ORDER BY t, seq) AS g FROM tl WINDOW w AS (PARTITION BY stream_id ORDER BY t, seq)),
r AS (SELECT stream_id, min(t) AS a, arg_max(coalesce(nt, -1), (t, seq)) AS n, max(t) AS l, max(confidence) AS peak, arg_min(seq, (t, seq)) AS first_seq FROM s WHERE active GROUP BY stream_id, g),
u AS (SELECT *, CASE WHEN n < 0 THEN l ELSE n END AS b FROM r)"""


def audio(spark, sf_dir) -> DataFrame:
    return timeline(spark, sf_dir).withColumn("active", F.col("confidence") >= 0.3).withColumn("amplitude", F.col("confidence"))


@query("whistle_runs", f"""WITH {RUNS_SQL}, q AS (SELECT * FROM u WHERE b - a >= 20), e AS (SELECT q.stream_id, first_seq, CAST(count(*) FILTER (seq % 3 = 0) AS BIGINT) AS e0, CAST(count(*) FILTER (seq % 3 = 1) AS BIGINT) AS e1, CAST(count(*) FILTER (seq % 3 = 2) AS BIGINT) AS e2
 FROM q JOIN tl ON tl.stream_id = q.stream_id AND tl.t >= q.a AND tl.t <= q.b AND tl.confidence >= 0.3 GROUP BY q.stream_id, first_seq)
SELECT q.stream_id, q.first_seq, {MICRO.format('(a + b) / 2')} AS centre_u, {MICRO.format('peak')} AS peak_u, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS band FROM q JOIN e USING (stream_id, first_seq)""")
def whistle_runs(spark, sf_dir):
    """Whistles: runs of active samples with their strongest band, open ones too."""
    from tideline.plans import signals

    bands = F.array(*((F.col("seq") % 3 == k).cast("double") for k in range(3)))
    out = signals.whistles(audio(spark, sf_dir).withColumn("bands", bands), 20.0)
    return out.select("stream_id", "first_seq", micro(F.col("centre")).alias("centre_u"), micro(F.col("peak")).alias("peak_u"), "band")


@query("surge_runs", f"WITH {RUNS_SQL}, m AS (SELECT stream_id, max(confidence) AS most FROM tl GROUP BY stream_id) SELECT stream_id, first_seq, {MICRO.format('a')} AS start_u, {MICRO.format('b')} AS end_u, {MICRO.format('peak / most')} AS peak_u FROM u JOIN m USING (stream_id) WHERE n >= 0 AND b - a >= 30")
def surge_runs(spark, sf_dir):
    """Surges: closed runs, their peaks as a share of the loudest sample."""
    from tideline.plans import signals

    return signals.surges(audio(spark, sf_dir), 30.0).select("stream_id", "first_seq", micro(F.col("start")).alias("start_u"), micro(F.col("end")).alias("end_u"), micro(F.col("peak")).alias("peak_u"))


@query("window_lines", f"WITH {TL} SELECT stream_id, seq, CAST(seq % 50 AS INTEGER) AS idx, CAST(seq % 4 AS INTEGER) AS events, 'it''s a shot' AS text FROM tl WHERE seq % 3 > 0")
def window_lines(spark, sf_dir):
    """The fields of log lines that tell of windows; other lines go."""
    from tideline.sources import events as src

    s = F.col("seq")
    line = F.when(s % 3 > 0, F.format_string("12:00 single_pass.window  elapsed=1.5s end=%d events=%d idx=%d start=0.5 text='it's a shot' ", s, s % 4, s % 50)).otherwise("single_pass.start job_id=1")
    return src.window_lines(timeline(spark, sf_dir).select("stream_id", "seq", line.alias("value"))).select("stream_id", "seq", "idx", "events", "text")


@query("gated_events", f"""WITH {TL} SELECT stream_id, seq FROM tl WHERE CASE WHEN event_type = 'corner_kick' THEN CASE WHEN seq % 3 = 0 THEN true ELSE (x <= 0.25 OR x >= 0.75) AND (y <= 0.25 OR y >= 0.75) END WHEN event_type = 'goal_kick' THEN CASE WHEN seq % 3 = 0 THEN true ELSE (x <= 0.2 OR x >= 0.8) AND y >= 0.25 AND y <= 0.75 END ELSE true END""")
def gated_events(spark, sf_dir):
    """Events that their type's gate lets pass; without features they pass as well."""
    from tideline.plans import spatial

    tl = timeline(spark, sf_dir)
    features = tl.where("seq % 3 > 0").select("stream_id", "seq", F.col("x").alias("px"), F.col("y").alias("py"))
    gates = {"corner_kick": spatial.corner_place(F.col("px"), F.col("py")), "goal_kick": spatial.goal_kick_place(F.col("px"), F.col("py"))}
    return spatial.gated(tl.select("stream_id", "seq", "event_type"), features, gates).select("stream_id", "seq")


@query("crop_boxes", f"""WITH {TL}, b AS (SELECT stream_id, CAST(floor(t / 60) AS BIGINT) AS f, min(x) AS x0, min(y) AS y0, max(x + 0.05) AS x1, max(y + 0.1) AS y1 FROM tl GROUP BY ALL),
p AS (SELECT stream_id, f, greatest(0.0, x0 - 0.1 * (x1 - x0)) AS a, greatest(0.0, y0 - 0.1 * (y1 - y0)) AS b, least(1.0, x1 + 0.1 * (x1 - x0)) AS c, least(1.0, y1 + 0.1 * (y1 - y0)) AS d FROM b)
SELECT stream_id, f AS frame, CASE WHEN (c - a) * (d - b) < 0.05 THEN 'too_small' WHEN (c - a) * (d - b) > 0.9 THEN 'too_big' ELSE 'cropped' END AS gate FROM p""")
def crop_boxes(spark, sf_dir):
    """Whether to crop a frame to the box around what is in it."""
    from tideline.plans import spatial

    rows = timeline(spark, sf_dir).withColumn("frame", F.floor(F.col("t") / 60).cast("bigint")).withColumn("w", F.lit(0.05)).withColumn("h", F.lit(0.1))
    return spatial.crop_box(rows, "stream_id", "frame").select("stream_id", "frame", "gate")


@query("shifted_samples", f"""WITH {TL}, m AS (SELECT stream_id, max(t) AS duration FROM tl GROUP BY stream_id), s AS (SELECT tl.*, duration, k FROM tl JOIN m USING (stream_id), (VALUES (-4.0), (-2.0), (0.0), (3.0), (5.0)) v(k) WHERE t + k >= 3 AND t + k <= duration - 3)
SELECT CASE WHEN abs(k) <= 3 THEN event_type ELSE 'none' END AS label, CAST(k AS INTEGER) AS shift, count(*) AS samples FROM s GROUP BY ALL""")
def shifted_samples(spark, sf_dir):
    """Samples at shifts of an event, with its label where it is still in the window."""
    tl = timeline(spark, sf_dir)
    rows = tl.join(tl.groupBy("stream_id").agg(F.max("t").alias("duration")), "stream_id").withColumn("label", F.col("event_type"))
    return records.shifted(rows, [-4.0, -2.0, 0.0, 3.0, 5.0]).groupBy("label", F.col("shift").cast("int").alias("shift")).agg(F.count("*").alias("samples"))


@query("reel_thresholds", f"""WITH {TL}, h AS (SELECT *, seq % 3 = 0 AS hit, CASE event_type WHEN 'catch' THEN 0.6 WHEN 'goal_kick' THEN 0.3 ELSE 0.0 END AS th FROM tl), k AS (SELECT event_type, count(*) FILTER (confidence >= th) AS nf, count(*) FILTER (confidence >= th AND hit) AS tp, count(*) FILTER (hit) AS nt FROM h GROUP BY event_type),
g AS (SELECT * FROM (VALUES ('restarts', 'goal_kick'), ('restarts', 'corner_kick'), ('restarts', 'kickoff'), ('keeper', 'catch'), ('keeper', 'goal_kick')) AS v(grp, event_type)) SELECT grp, CAST(sum(nt) AS BIGINT) AS n_true, CAST(sum(nf) AS BIGINT) AS n_found, CAST(sum(tp) AS BIGINT) AS tp FROM k JOIN g USING (event_type) GROUP BY grp""")
def reel_thresholds(spark, sf_dir):
    """Reels' counts with a threshold for each type."""
    rows = timeline(spark, sf_dir).withColumn("hit", F.col("seq") % 3 == 0)
    n = rows.where("hit").groupBy("event_type").agg(F.count("*").alias("n_true"))
    limits = spark.createDataFrame([("catch", 0.6), ("goal_kick", 0.3)], "event_type string, threshold double")
    return evaluate.reel_totals(rows, n, {"restarts": ["goal_kick", "corner_kick", "kickoff"], "keeper": ["catch", "goal_kick"]}, limits).select("grp", "n_true", "n_found", "tp")
