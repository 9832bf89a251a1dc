"""Predicates on explanations, parsers of answers, and the contextual filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bind import TL, micro, table, timeline
from tideline.catalog import query
from tideline.functions import text
from tideline.queries.joins import MICRO


# Fixed values of the SQL side, written out on their own so that a gap in the library's lists shows.
SQL_SAVE = "save|saved|stopped|blocked by the keeper|blocked by the goalkeeper|parr|catch|punched away|tipped over|tipped away|pushed away|kept out|denied|goalkeeper.*block|keeper.*block"
SQL_OFF_TARGET = "wide|over the bar|off.{0,5}target|missed|blocked|deflect"
SQL_KICKOFF = (
    r"center\s+spot|(?:both\s+teams|each\s+team|teams\s+are)\s+.{0,30}?(?:own\s+hal(?:f|ves)|their\s+hal(?:f|ves)|respective\s+hal)|kickoff\s+(?:setup|formation|restart|position)"
    r"|(?:setup|formation|position)\s+for\s+(?:the\s+)?kickoff|(?:walking|walk|return|returning|headed|heading|moving)\s+(?:back\s+)?(?:to|toward)\s+(?:the\s+)?center\s+circle"
    r"|center\s+circle.*(?:kickoff|kick-off|kick off|restart)"
)
SQL_GOAL = (
    r"(?:players?|team(?:mates)?|(?:he|she|they))\s+(?:are |is |were |was |begin |start )?(?:celebrat|hugging|embracing|sliding)|(?:with |raising |raises? |raised )(?:his |her |their )?arms?\s*(?:raised|up|in the air|aloft)"
    r"|(?:walking|walk|return|returning|headed|heading|moving)\s+(?:back\s+)?(?:to|toward)\s+(?:the\s+)?center\s+circle|center\s+circle.*(?:kickoff|kick-off|kick off|restart)"
)
SQL_GOAL_PHRASES = "fist pump|group hug|sliding on knees|running to teammates|jumping in celebration"
SQL_SAVE_LANGUAGE = (
    r"(?:goalkeeper|gk|keeper)\s+(?:dives?|saves?|parr(?:ies|y|ied)|stops?|deflects?|catches|punches|tips|blocks?)|(?:ball|it)\s+(?:deflects?|rebounds?|goes?\s+wide|bounces?)\s+away"
    r"|does not enter the net|ball is deflected away from the goal|saved|cleared off the line"
)
SQL_SHOT = (
    r"(?:a |the )?player.{0,20}(shot|shoots|struck|fired|kicked).{0,15}(toward|towards|at|on).{0,10}goal|(?:a |the )?shot (?:is |was )?taken|(?:a |the )?shot (?:is |was )?fired|took a shot|takes a shot"
    r"|hit the (cross)?bar|(?:ball |shot )(?:went |goes |travel\w+ )(?:wide|over)|over the bar|wide of (the )?goal|off.{0,5}target|blocked.{0,10}(?:by a |by the )?(?:defender|field player)|deflect\w* (?:off|by|away)"
    r"|struck.{0,10}(?:toward|at) goal"
)


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_match(column: str, pattern: str, flags: str = "i") -> str:
    opts = f", '{flags}'" if flags else ""
    return f"regexp_matches({column}, {sql_text(pattern)}{opts})"


# Explanations that models give; the seq of a row picks one.
SAID = [
    "The goalkeeper dives and the ball deflects away", "Both teams are lined up in their own halves around the center spot", "A player took a shot wide of the goal",
    "Players are celebrating with arms raised", "Nothing happens near the box", "The ball was tipped over the bar by the keeper", "kickoff formation after the break",
    "A shot is taken and blocked by a defender", "teammates running to teammates after a fist pump", "The keeper catches the cross",
    "the shot is denied by a goalkeeper who makes a fine block", "players walk back to the center circle for the kickoff", "all stand at the center circle before the restart",
]
SAID_SQL = "list_extract([" + ", ".join(map(sql_text, SAID)) + "], CAST(seq % 13 AS INTEGER) + 1)"
RESULT_SQL = "CASE WHEN seq % 4 = 0 THEN 'rejected' WHEN seq % 4 = 1 THEN 'uncertain' ELSE 'confirmed' END"


def said(spark, sf_dir):
    """Verdicts with one of the fixed explanations each."""
    s = F.col("seq")
    result = F.when(s % 4 == 0, "rejected").when(s % 4 == 1, "uncertain").otherwise("confirmed")
    return timeline(spark, sf_dir).withColumn("reasoning", F.element_at(F.array(*map(F.lit, SAID)), (s % len(SAID) + 1).cast("int"))).withColumn("result", result)


VERDICTS = f"{TL}, v AS (SELECT *, {SAID_SQL} AS reasoning, {RESULT_SQL} AS result FROM tl)"


@query("explanation_predicates", f"""WITH {VERDICTS} SELECT stream_id, seq, {sql_match('reasoning', SQL_KICKOFF)} AS kickoff, {sql_match('reasoning', SQL_GOAL)} OR {sql_match('reasoning', SQL_GOAL_PHRASES, '')} AS goal, {sql_match('reasoning', SQL_SAVE_LANGUAGE)} AS save FROM v""")
def explanation_predicates(spark, sf_dir):
    """What each explanation tells of: a real kickoff, a goal, a save."""
    r = F.col("reasoning")
    return said(spark, sf_dir).select("stream_id", "seq", text.kickoff_evidence(r).alias("kickoff"), text.goal_evidence(r).alias("goal"), text.save_language(r).alias("save"))


@query("document_predicates", f"SELECT doc_id, {sql_match('lower(text)', SQL_SAVE, '')} AS save_words, {sql_match('lower(text)', SQL_OFF_TARGET, '')} AS off_target FROM documents")
def document_predicates(spark, sf_dir):
    """The same kind of predicate over whole documents."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.save_words(F.col("text")).alias("save_words"), text.matches(low, text.OFF_TARGET_PATTERNS, "").alias("off_target"))


@query("save_reclassification", f"WITH {VERDICTS} SELECT stream_id, seq, CASE WHEN result = 'confirmed' AND event_type = 'goal_kick' AND {sql_match('lower(reasoning)', SQL_SAVE, '')} THEN 'shot_stop_diving' ELSE event_type END AS event_type FROM v")
def save_reclassification(spark, sf_dir):
    """Goal kicks that were saves by what was said."""
    return text.save_reclassified(said(spark, sf_dir)).select("stream_id", "seq", "event_type")


HIT = f"(result = 'rejected' AND {sql_match('lower(reasoning)', SQL_SHOT, '')})"


@query("shot_reclassification", f"""WITH {VERDICTS} SELECT stream_id, seq, CASE WHEN {HIT} THEN 'confirmed' ELSE result END AS result, CASE WHEN {HIT} THEN CASE WHEN {sql_match('lower(reasoning)', SQL_OFF_TARGET, '')} THEN 'shot_off_target' ELSE 'shot_on_target' END ELSE event_type END AS event_type,
 {MICRO.format(f'CASE WHEN {HIT} THEN confidence * 0.7 ELSE confidence END')} AS confidence_u, CASE WHEN {HIT} THEN 'SHOT_RECLASS: ' || reasoning ELSE reasoning END AS reasoning FROM v""")
def shot_reclassification(spark, sf_dir):
    """Rejected rows that were shots by what was said."""
    return text.shot_reclassified(said(spark, sf_dir)).select("stream_id", "seq", "result", "event_type", micro(F.col("confidence")).alias("confidence_u"), "reasoning")


@query("verdict_events", f"""WITH {VERDICTS}, k AS (SELECT stream_id, seq, event_type AS e, confidence AS c FROM v WHERE result <> 'rejected' AND confidence >= 0.5)
SELECT stream_id, seq, 0 AS part, e AS event_type, {MICRO.format('c')} AS confidence_u FROM k UNION ALL SELECT stream_id, seq, 1, 'shot_on_target', {MICRO.format('c * 0.95')} FROM k WHERE e IN ('catch', 'punch')""")
def verdict_events(spark, sf_dir):
    """One or two events a verdict: saves give the shot as well."""
    from tideline.plans import verdicts

    return verdicts.verdict_events(said(spark, sf_dir)).select("stream_id", "seq", "part", "event_type", micro(F.col("confidence")).alias("confidence_u"))


@query("candidate_events", f"WITH {TL} SELECT stream_id, seq, CASE WHEN seq % 3 = 0 THEN 'free_kick_shot' ELSE 'shot_on_target' END AS event_type, {MICRO.format('confidence * 0.7')} AS confidence_u FROM tl")
def candidate_events(spark, sf_dir):
    """Events of candidates without a model."""
    from tideline.plans import verdicts

    c = timeline(spark, sf_dir).withColumn("cue", F.when(F.col("seq") % 3 == 0, "whistle_long").when(F.col("seq") % 3 == 1, "surge"))
    return verdicts.candidate_events(c).select("stream_id", "seq", "event_type", micro(F.col("confidence")).alias("confidence_u"))


@query("answer_verdicts", f"""WITH {TL} SELECT stream_id, seq, CASE seq % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN CASE WHEN floor(confidence * 1000) / 1000 >= 0.6 THEN 'confirmed' ELSE 'uncertain' END WHEN 2 THEN CASE WHEN floor(confidence * 1000) / 1000 >= 0.6 THEN 'confirmed' ELSE 'uncertain' END
 WHEN 3 THEN 'uncertain' WHEN 4 THEN 'uncertain' WHEN 5 THEN CASE WHEN floor(confidence * 1000) / 1000 >= 0.6 THEN 'confirmed' ELSE 'rejected' END ELSE 'uncertain' END AS result,
 CASE seq % 7 WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 5 THEN 'catch' END AS event_type FROM tl""")
def answer_verdicts(spark, sf_dir):
    """Answers in every shape: plain, fenced, with thinking, in prose, broken, unknown, old form."""
    s, c = F.col("seq") % 7, F.floor(F.col("confidence") * 1000) / 1000
    obj = F.format_string('{"event": "%s", "confidence": %s, "reasoning": "seen"}', F.col("event_type"), c.cast("string"))
    answer = (
        F.when(s == 0, '{"event": "none", "confidence": 0.9}').when(s == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(s == 2, F.concat(F.lit("<think>a {\n</think>I say "), obj, F.lit(" so.")))
        .when(s == 3, "no answer").when(s == 4, '{"event": "fireworks", "confidence": 0.9}').when(s == 5, F.format_string('{"is_correct": true, "actual_event": "catch", "confidence": %s}', c.cast("string"))).otherwise('{"confidence": 0.4}')
    )
    v = timeline(spark, sf_dir).withColumn("v", text.verdict_of(answer))
    return v.select("stream_id", "seq", "v.result", "v.event_type")


@query("answer_refinements", f"WITH {TL} SELECT stream_id, seq, seq % 5 <> 1 AND seq % 5 <> 3 AS confirmed, CASE seq % 5 WHEN 0 THEN 90 WHEN 1 THEN 80 WHEN 2 THEN 70 WHEN 3 THEN 70 ELSE 50 END AS confidence_pct FROM tl")
def answer_refinements(spark, sf_dir):
    """Confirmations: an object, one in prose, bare words, and nothing at all, which confirms."""
    s = F.col("seq") % 5
    answer = F.when(s == 0, '{"confirmed": true, "confidence": 0.9}').when(s == 1, 'Well: {"confirmed": false, "confidence": 0.8} I think').when(s == 2, 'it has "confirmed": true but').when(s == 3, '"Confirmed":false, broken {').otherwise("hm")
    v = timeline(spark, sf_dir).withColumn("v", text.refinement_of(answer))
    return v.select("stream_id", "seq", "v.confirmed", F.floor(F.col("v.confidence") * 100 + 0.5).cast("int").alias("confidence_pct"))


@query("answer_triage", f"WITH {TL} SELECT stream_id, seq, CASE seq % 5 WHEN 0 THEN 'ATTACK' WHEN 1 THEN 'PLAY' WHEN 2 THEN 'SHOT_SAVE' WHEN 3 THEN 'PLAY' ELSE 'DEAD' END AS label, CASE seq % 5 WHEN 0 THEN 'left_third' ELSE 'middle' END AS zone FROM tl")
def answer_triage(spark, sf_dir):
    """Triage labels: known, unknown, in free text, none."""
    s = F.col("seq") % 5
    answer = F.when(s == 0, '{"label": "attack", "ball_zone": "left_third"}').when(s == 1, '{"label": "DANCE", "ball_zone": "moon"}').when(s == 2, "I see a shot_save in play").when(s == 3, "?").otherwise('```\n{"label": "DEAD"}\n```')
    v = timeline(spark, sf_dir).withColumn("v", text.triage_of(answer))
    return v.select("stream_id", "seq", "v.label", "v.zone")


@query("answer_events", f"""WITH {TL}, m AS (SELECT stream_id, max(t) AS d FROM tl GROUP BY stream_id), e AS (SELECT stream_id, seq, t AS a, least(d, t + 4.0) AS b, d, seq % 3 = 0 AS goal FROM tl JOIN m USING (stream_id) WHERE seq % 5 <> 0 AND seq % 4 <> 1)
SELECT stream_id, seq, 0 AS part, 'shot_on_target' AS event_type, {MICRO.format('b')} AS end_u FROM e WHERE b > a UNION ALL SELECT stream_id, seq, 1, 'goal', {MICRO.format('greatest(b, a + 15.0)')} FROM e WHERE b > a AND goal""")
def answer_events(spark, sf_dir):
    """Events of answers about windows, with the goals that shots ended in; unknown types and low confidences go."""
    tl = timeline(spark, sf_dir)
    ends = tl.groupBy("stream_id").agg(F.max("t").alias("duration"))
    s = F.col("seq")
    item = F.to_json(F.struct(
        F.when(s % 5 == 0, "banquet").otherwise("shot_on_target").alias("event_type"), F.col("t").alias("start_sec"), (F.col("t") + 4.0).alias("end_sec"),
        F.when(s % 4 == 1, 0.3).otherwise(0.8).alias("confidence"), F.lit("seen").alias("reasoning"), F.when(s % 3 == 0, "goal").otherwise("soup").alias("outcome"),
    ))
    rows = tl.join(ends, "stream_id").select("stream_id", "seq", F.col("t").alias("window_start"), "duration", F.when(s % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(item).alias("response"))
    return text.window_events(rows).select("stream_id", "seq", "part", "event_type", micro(F.col("end")).alias("end_u"))


@query("contextual_filter", f"""WITH {TL}, v AS (SELECT * EXCLUDE (event_type), {SAID_SQL} AS reasoning, CASE WHEN seq % 6 = 0 THEN 'shot_stop_standing' WHEN seq % 6 = 1 THEN 'goal' ELSE event_type END AS event_type FROM tl),
k AS (SELECT * FROM v WHERE event_type = 'kickoff' AND {sql_match('reasoning', SQL_KICKOFF)} AND 1 + seq % 3 >= 2), s AS (SELECT * FROM v WHERE event_type IN ('shot_on_target', 'shot_stop_standing', 'goal', 'corner_kick')),
f AS (SELECT v.*, EXISTS (SELECT 1 FROM k WHERE k.stream_id = v.stream_id AND k.t - v.t >= 10 AND k.t - v.t <= 90) AS ko, EXISTS (SELECT 1 FROM s WHERE s.stream_id = v.stream_id AND v.t - s.t > 0 AND v.t - s.t <= 10) AS shot FROM v WHERE event_type <> 'kickoff'),
g AS (SELECT *, event_type IN ('shot_on_target', 'shot_stop_standing') AND ko AS inferred FROM f), h AS (SELECT *, CASE WHEN inferred THEN 'goal' WHEN event_type = 'shot_stop_standing' THEN 'catch' ELSE event_type END AS e FROM g)
SELECT stream_id, seq, CASE WHEN e = 'goal' AND NOT inferred AND {sql_match('reasoning', SQL_SAVE_LANGUAGE)} THEN 'shot_on_target' ELSE e END AS event_type, {MICRO.format('CASE WHEN inferred THEN least(confidence + 0.1, 1.0) ELSE confidence END')} AS confidence_u FROM h WHERE e <> 'catch' OR shot""")
def contextual_filter(spark, sf_dir):
    """All contextual rules over single events, in order."""
    from tideline.plans.postfilter import post_filter

    s = F.col("seq")
    v = said(spark, sf_dir).withColumn("event_type", F.when(s % 6 == 0, "shot_stop_standing").when(s % 6 == 1, "goal").otherwise(F.col("event_type"))).withColumn("cluster_size", 1 + s % 3)
    return post_filter(v).select("stream_id", "seq", "event_type", micro(F.col("confidence")).alias("confidence_u"))


@query("slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugs(spark, sf_dir):
    """Names as lower-case words joined by underscores."""
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    """Free-form properties read as variants."""
    e = table(spark, sf_dir, "events").withColumn("k", text.field(text.as_variant(F.col("props")), "k", "bigint"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
