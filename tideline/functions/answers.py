"""Parsers of focused answers: one question a prompt, each with its own fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import as_variant, field, once, parsed, unfenced

# The field that says yes, the type that a yes means, and what goes before the reason.
YES = {
    "corner": ("is_corner", "corner_kick", ""), "catch": ("is_catch", "catch", "CATCH_SCAN: "), "celebration": ("is_goal", "goal", "GOAL_CELEBRATION: "),
    "kickoff": ("is_kickoff", "kickoff", ""), "shot": ("is_shot", "shot_on_target", "SHOT_SCAN: "),
}
SHOTS = {"off_target": "shot_off_target", "blocked": "shot_off_target"}
RESTARTS = ["corner_kick", "goal_kick", "throw_in"]
STATES = ["active_play", "corner_kick", "goal_kick", "stoppage", "replay", "other"]


def focused_verdict(answer: Column, question: str, least: float = 0.5) -> Column:
    """(result, event_type, confidence, reasoning) of the answer to one of the questions.

    "set_piece" reads ``restart``, "shot" also ``shot_type``; the others read one yes.  A yes from ``least`` on
    is confirmed, all else rejected.  Without an object the row passes through: uncertain, no type, 0.5.
    """
    def read(v: Column) -> Column:
        if question == "set_piece":
            restart = field(v, "restart", "string")
            yes, kind = restart.isin(RESTARTS), restart
        else:
            name, meant, _ = YES[question]
            yes, kind = field(v, name, "boolean"), F.lit(meant)
            if question == "shot":
                how = field(v, "shot_type", "string")
                kind = F.when(how.isin(*SHOTS), F.lit("shot_off_target")).otherwise(meant)
        conf, why = F.coalesce(field(v, "confidence", "double"), F.lit(0.5)), F.coalesce(field(v, "reasoning", "string"), F.lit(""))
        return F.struct(v.isNull().alias("bare"), (F.coalesce(yes, F.lit(False)) & (conf >= least)).alias("sure"), kind.alias("kind"), conf.alias("conf"), why.alias("why"))

    def judge(r: Column) -> Column:
        sure, before = r["sure"], "" if question == "set_piece" else YES[question][2]
        return F.when(r["bare"], F.struct(F.lit("uncertain").alias("result"), F.lit(None).cast("string").alias("event_type"), F.lit(0.5).alias("confidence"), F.lit("").alias("reasoning"))).otherwise(
            F.struct(F.when(sure, "confirmed").otherwise("rejected").alias("result"), F.when(sure, r["kind"]).alias("event_type"), r["conf"].alias("confidence"), F.when(sure, F.concat(F.lit(before), r["why"])).otherwise(r["why"]).alias("reasoning"))
        )

    return parsed(answer, lambda v: once(read(v), judge))


def goal_check(answer: Column) -> Column:
    """(is_goal, confidence, reasoning); no goal at 0 where there is no object or no answer."""
    said = lambda v: F.struct(F.coalesce(field(v, "is_goal", "boolean"), F.lit(False)).alias("is_goal"), F.coalesce(field(v, "confidence", "double"), F.lit(0.5)).alias("confidence"), F.coalesce(field(v, "reasoning", "string"), F.lit("")).alias("reasoning"))
    none = F.struct(F.lit(False).alias("is_goal"), F.lit(0.0).alias("confidence"), F.when(answer.isNull(), "no answer").otherwise("parse error").alias("reasoning"))
    return parsed(answer, lambda v: F.when(v.isNull(), none).otherwise(said(v)))


def scene_labels(answer: Column, times: Column) -> Column:
    """An array of (t, state) for frames whose times are ``times``.

    Items say frame_index and state; unknown states are active play, indices out of range fall back to the
    item's own timestamp, else 0.  An answer that is no list makes every frame active play.
    """
    kind = "array<struct<frame_index:int,state:string,timestamp:double>>"
    index = lambda i: F.coalesce(i["frame_index"], F.lit(-1))
    at = lambda i: F.when((index(i) >= 0) & (index(i) < F.size(times)), F.get(times, index(i))).otherwise(F.coalesce(i["timestamp"], F.lit(0.0)))
    label = lambda t, s: F.struct(t.alias("t"), s.alias("state"))
    read = lambda items: F.transform(F.filter(items, lambda i: i.isNotNull()), lambda i: label(at(i), F.when(i["state"].isin(STATES), i["state"]).otherwise("active_play")))
    other = F.transform(times, lambda t: label(t, F.lit("active_play")))
    return once(unfenced(answer), lambda a: once(F.from_json(a, kind), lambda items: F.when(items.isNull() | ~a.startswith("["), other).otherwise(read(items))))


def boundary(answer: Column, centre: Column) -> Column:
    """(start, end, confirmed, reasoning) of a refinement: 10 s around the centre by default; no object means not confirmed."""
    def read(object_: Column, v: Column) -> Column:
        pick = lambda name, kind, other: F.when(object_, F.coalesce(field(v, name, kind), other)).otherwise(other)
        return F.struct(
            pick("clip_start_sec", "double", centre - 10).alias("start"), pick("clip_end_sec", "double", centre + 10).alias("end"),
            pick("confirmed", "boolean", F.lit(False)).alias("confirmed"), F.when(object_, F.coalesce(field(v, "reasoning", "string"), F.lit(""))).otherwise("parse_error").alias("reasoning"),
        )

    return once(unfenced(answer), lambda a: once(as_variant(a), lambda v: read(a.startswith("{") & v.isNotNull(), v)))


def prediction(answer: Column) -> Column:
    """(event, confidence) for evaluation: "none" at 0.5 by default, "parse_error" at 0 without an object."""
    return parsed(answer, lambda v: F.struct(
        F.when(v.isNull(), "parse_error").otherwise(F.coalesce(field(v, "event", "string"), F.lit("none"))).alias("event"),
        F.when(v.isNull(), 0.0).otherwise(F.coalesce(field(v, "confidence", "double"), F.lit(0.5))).alias("confidence"),
    ))


def flag(answer: Column) -> Column:
    """(flag, reason): the object, else whether the text says "flag": true."""
    def read(a: Column, v: Column) -> Column:
        said = F.lower(a).rlike('"flag": ?true')
        return F.when(v.isNotNull(), F.struct(F.coalesce(field(v, "flag", "boolean"), F.lit(False)).alias("flag"), F.coalesce(field(v, "reason", "string"), F.lit("")).alias("reason"))).otherwise(
            F.struct(said.alias("flag"), F.when(said, a).otherwise(F.concat(F.lit("PARSE_ERROR: "), F.substring(a, 1, 100))).alias("reason"))
        )

    return once(unfenced(answer), lambda a: once(as_variant(a), lambda v: read(a, v)))
