"""Predicates on the models' explanations, and parsers of their answers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import schema

# Patterns that tell saves, shots, kickoffs and goals in an explanation.
SAVE_WORDS = [
    "save", "saved", "stopped", "blocked by the keeper", "blocked by the goalkeeper", "parr", "catch", "punched away",
    "tipped over", "tipped away", "pushed away", "kept out", "denied", "goalkeeper.*block", "keeper.*block",
]
SHOT_PATTERNS = [
    r"(?:a |the )?player.{0,20}(shot|shoots|struck|fired|kicked).{0,15}(toward|towards|at|on).{0,10}goal",
    r"(?:a |the )?shot (?:is |was )?taken", r"(?:a |the )?shot (?:is |was )?fired", r"took a shot", r"takes a shot",
    r"hit the (cross)?bar", r"(?:ball |shot )(?:went |goes |travel\w+ )(?:wide|over)", r"over the bar", r"wide of (the )?goal",
    r"off.{0,5}target", r"blocked.{0,10}(?:by a |by the )?(?:defender|field player)", r"deflect\w* (?:off|by|away)",
    r"struck.{0,10}(?:toward|at) goal",
]
OFF_TARGET_PATTERNS = [r"wide", r"over the bar", r"off.{0,5}target", r"missed", r"blocked", r"deflect"]
KICKOFF_PATTERNS = [
    r"center\s+spot",
    r"(?:both\s+teams|each\s+team|teams\s+are)\s+.{0,30}?(?:own\s+hal(?:f|ves)|their\s+hal(?:f|ves)|respective\s+hal)",
    r"kickoff\s+(?:setup|formation|restart|position)|(?:setup|formation|position)\s+for\s+(?:the\s+)?kickoff",
    r"(?:walking|walk|return|returning|headed|heading|moving)\s+(?:back\s+)?(?:to|toward)\s+(?:the\s+)?center\s+circle",
    r"center\s+circle.*(?:kickoff|kick-off|kick off|restart)",
]
GOAL_PATTERNS = [
    r"(?:players?|team(?:mates)?|(?:he|she|they))\s+(?:are |is |were |was |begin |start )?(?:celebrat|hugging|embracing|sliding)",
    r"(?:with |raising |raises? |raised )(?:his |her |their )?arms?\s*(?:raised|up|in the air|aloft)",
    r"(?:walking|walk|return|returning|headed|heading|moving)\s+(?:back\s+)?(?:to|toward)\s+(?:the\s+)?center\s+circle",
    r"center\s+circle.*(?:kickoff|kick-off|kick off|restart)",
]
GOAL_PHRASES = ["fist pump", "group hug", "sliding on knees", "running to teammates", "jumping in celebration"]
SAVE_LANGUAGE_PATTERNS = [
    r"(?:goalkeeper|gk|keeper)\s+(?:dives?|saves?|parr(?:ies|y|ied)|stops?|deflects?|catches|punches|tips|blocks?)",
    r"(?:ball|it)\s+(?:deflects?|rebounds?|goes?\s+wide|bounces?)\s+away",
    r"does not enter the net|ball is deflected away from the goal|saved|cleared off the line",
]
TRIAGE_LABELS = ["SET_PIECE", "SHOT_SAVE", "GOAL", "ATTACK", "PLAY", "DEAD"]
BALL_ZONES = ["left_third", "middle", "right_third"]
OUTCOMES = ["save", "corner_kick", "goal_kick", "goal"]


def any_of(patterns: list[str], flags: str = "i") -> str:
    """One pattern that matches where any does."""
    return (f"(?{flags})" if flags else "") + "|".join(f"(?:{p})" for p in patterns)


def matches(text: Column, patterns: list[str], flags: str = "i") -> Column:
    return F.coalesce(text, F.lit("")).rlike(any_of(patterns, flags))


def save_words(text: Column) -> Column:
    return matches(F.lower(text), SAVE_WORDS, "")


def kickoff_evidence(text: Column) -> Column:
    return matches(text, KICKOFF_PATTERNS)


def goal_evidence(text: Column) -> Column:
    """Patterns in any case, phrases as they stand."""
    return matches(text, GOAL_PATTERNS) | matches(text, [re.escape(p).replace(r"\ ", " ") for p in GOAL_PHRASES], "")


def save_language(text: Column) -> Column:
    return matches(text, SAVE_LANGUAGE_PATTERNS)


def save_reclassified(verdicts: DataFrame) -> DataFrame:
    """Confirmed goal kicks whose explanation tells of a save are diving saves."""
    hit = (F.col("result") == "confirmed") & (F.col("event_type") == "goal_kick") & save_words(F.col("reasoning"))
    return verdicts.withColumn("event_type", F.when(hit, "shot_stop_diving").otherwise(F.col("event_type")))


def shot_reclassified(verdicts: DataFrame) -> DataFrame:
    """Rejected rows whose explanation tells of a shot are confirmed shots at 0.7 of the confidence, on or off target."""
    low = F.lower(F.coalesce("reasoning", F.lit("")))
    hit = (F.col("result") == "rejected") & matches(low, SHOT_PATTERNS, "")
    kind = F.when(matches(low, OFF_TARGET_PATTERNS, ""), "shot_off_target").otherwise("shot_on_target")
    return verdicts.select(
        *(c for c in verdicts.columns if c not in ("result", "event_type", "confidence", "reasoning")),
        F.when(hit, "confirmed").otherwise(F.col("result")).alias("result"), F.when(hit, kind).otherwise(F.col("event_type")).alias("event_type"),
        F.when(hit, F.col("confidence") * 0.7).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.concat(F.lit("SHOT_RECLASS: "), F.col("reasoning"))).otherwise(F.col("reasoning")).alias("reasoning"),
    )


def stripped(text: Column) -> Column:
    """Without white space around it; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def unfenced(text: Column) -> Column:
    """An answer without code fences, a leading "json" and thinking aloud."""
    t = F.regexp_replace(stripped(text), r"(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?m)^\s*```[^\n]*$", "")
    return stripped(F.regexp_replace(stripped(t), r"^json", ""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is read.

    A column that is named twice in a condition is worked out twice, and what is built of it four times; answers read
    field by field would be parsed hundreds of times, in code too long to be compiled.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_object(text: Column) -> Column:
    """From the first brace to the last, where an answer has prose around its object; else the text."""
    pick = lambda t, found: F.when(t.startswith("{"), t).when(found != "", found).otherwise(t)
    return once(text, lambda t: once(F.regexp_extract(t, r"(?s)(\{.*\})", 1), lambda found: pick(t, found)))


def as_variant(text: Column) -> Column:
    return F.try_parse_json(text)


def parsed(answer: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the object of an answer, parsed once; null where there is none."""
    return once(as_variant(json_object(unfenced(answer))), use)


def field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def verdict_of(text: Column, least: float = 0.6) -> Column:
    """(result, event_type, confidence, reasoning) of an answer.

    Without an object, or with an unknown event, the row passes through as uncertain with no type; "none" and
    "neither" reject it; a known event is confirmed from ``least`` on.  The older form says is_correct.
    """
    known = [t[0] for t in schema.EVENT_TYPES]

    def read(v: Column) -> Column:
        return F.struct(
            field(v, "event", "string").alias("event"), field(v, "is_correct", "boolean").alias("correct"), F.coalesce(field(v, "confidence", "double"), F.lit(0.5)).alias("conf"),
            field(v, "actual_event", "string").alias("actual"), F.coalesce(field(v, "reasoning", "string"), F.lit("")).alias("why"),
        )

    def judge(r: Column) -> Column:
        event, correct, conf, actual = r["event"], r["correct"], r["conf"], r["actual"]
        result = (
            F.when(event.isin("none", "neither"), "rejected").when(event.isin(known) & (conf >= least), "confirmed").when(event.isNotNull(), "uncertain")
            .when(correct & (conf >= least), "confirmed").when(correct.isNotNull(), "rejected").otherwise("uncertain")
        )
        kind = F.when(event.isin(known), event).when(event.isNull() & correct.isNotNull() & actual.isin(known), actual)
        said = (event.isNotNull() & (event.isin("none", "neither") | event.isin(known))) | (event.isNull() & correct.isNotNull())
        return F.struct(result.alias("result"), kind.alias("event_type"), F.when(said, conf).otherwise(0.5).alias("confidence"), r["why"].alias("reasoning"))

    return parsed(text, lambda v: once(read(v), judge))


def refinement_of(text: Column) -> Column:
    """(confirmed, confidence): the object, else the words "confirmed": true or false, else confirmed at 0.5."""
    def read(t: Column) -> Column:
        inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
        return once(F.coalesce(F.when(t.startswith("{"), as_variant(t)), F.when(inner != "", as_variant(inner))), lambda v: judge(v, F.lower(t)))

    def judge(v: Column, low: Column) -> Column:
        yes, no = low.rlike(r'"confirmed": ?true'), low.rlike(r'"confirmed": ?false')
        ok = F.when(v.isNotNull(), F.coalesce(field(v, "confirmed", "boolean"), F.lit(False))).when(yes, True).when(no, False).otherwise(True)
        conf = F.when(v.isNotNull(), F.coalesce(field(v, "confidence", "double"), F.lit(0.0))).when(yes | no, 0.7).otherwise(0.5)
        return F.struct(ok.alias("confirmed"), conf.alias("confidence"))

    return once(F.trim(F.coalesce(text, F.lit(""))), read)


def triage_of(text: Column) -> Column:
    """(label, zone): known values of the object; else the first label named in the text; else PLAY, middle."""
    def judge(t: Column, v: Column) -> Column:
        label, zone = F.upper(field(v, "label", "string")), field(v, "ball_zone", "string")
        named = F.lit("PLAY")
        for k in reversed(TRIAGE_LABELS):
            named = F.when(F.upper(t).contains(k), k).otherwise(named)
        return F.struct(
            F.when(v.isNull(), named).when(label.isin(TRIAGE_LABELS), label).otherwise("PLAY").alias("label"),
            F.when(v.isNotNull() & zone.isin(BALL_ZONES), zone).otherwise("middle").alias("zone"),
        )

    return once(unfenced(text), lambda t: once(as_variant(t), lambda v: judge(t, v)))


ITEM = "event_type string, start_sec double, end_sec double, confidence double, reasoning string, outcome string"


def window_events(df: DataFrame, text: str = "response", least: float = 0.65) -> DataFrame:
    """Events of answers about windows; ``df`` has window_start and duration.

    An answer is a list or one object.  Unknown types, confidences under ``least`` and empty spans go; spans are
    cut to the video.  A shot whose outcome is a goal gives a goal as well, of 15 s at least.
    """
    listed = once(unfenced(F.col(text)), lambda t: F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))))
    items = F.from_json(listed, f"array<struct<{ITEM.replace(' string', ':string').replace(' double', ':double')}>>")
    e = df.withColumn("i", F.explode(items)).where(F.col("i").isNotNull())
    start0 = F.coalesce("i.start_sec", "window_start")
    e = e.withColumn("start", F.greatest(F.lit(0.0), start0)).withColumn("end", F.least("duration", F.coalesce("i.end_sec", start0 + 5))).withColumn("confidence", F.coalesce("i.confidence", F.lit(0.7)))
    e = e.where(F.col("i.event_type").isin([x[0] for x in schema.EVENT_TYPES]) & (F.col("confidence") >= least) & (F.col("end") > F.col("start")))
    outcome = F.when(F.col("i.event_type").isin(schema.SHOT_TYPES) & F.col("i.outcome").isin(OUTCOMES), F.col("i.outcome"))
    own = F.struct(F.col("i.event_type").alias("event_type"), F.col("end").alias("end"), outcome.alias("outcome"), F.lit(0).alias("part"))
    goal = F.struct(F.lit("goal").alias("event_type"), F.greatest(F.col("end"), F.col("start") + 15.0).alias("end"), F.lit(None).cast("string").alias("outcome"), F.lit(1).alias("part"))
    parts = F.when(outcome == "goal", F.array(own, goal)).otherwise(F.array(own))
    rest = [c for c in df.columns if c != text]
    return e.select(*rest, "start", "confidence", F.coalesce("i.reasoning", F.lit("")).alias("reasoning"), F.explode(parts).alias("p")).select(*rest, "start", "confidence", "reasoning", "p.*")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clock(t: Column) -> Column:
    """mm:ss.ss"""
    c = F.floor(t * 100 + 0.5).cast("bigint")
    return F.format_string("%02d:%02d.%02d", (c / 6000).cast("int"), ((c % 6000) / 100).cast("int"), (c % 100).cast("int"))


def frames_per_second(text: Column) -> Column:
    """30/1 or 29.97 as a number; null where the divisor is 0 or there is no number."""
    parts = F.split(text, "/")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 1, a).when(b != 0, a / b)
