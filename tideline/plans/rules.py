"""The inference rules over verdicts: what a row was, judged by what came before and after it.

Each rule is a function of DataFrames and reads the rows as they were before it; ``run_rules`` applies all
of them in order.  Rules that ask a model again make probes (stream_id, t) and join recorded answers:
(stream_id, phase, t, result, event_type, confidence, reasoning); a probe without an answer changes nothing.

Explanations are wide and no rule between the first two and the end reads them.  So rows carry ``whys``
instead: the texts that rules put in front, each with how much of what was said before it keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import folds
from tideline.operators import timeline as tm
from tideline.plans import verdicts as vd
from tideline.sources.staging import staged, unstaged

SHOTS = ("shot_on_target", "shot_stop_diving")
SAVES = ("shot_stop_diving", "shot_stop_standing", "punch", "catch")

# The gaps in seconds that the rules look at.
KICKOFF_GAP = (20.0, 90.0)
KICKOFF_PROBES = (30.0, 45.0, 60.0, 75.0, 90.0)
CORNER_PROBES = (20.0, 35.0, 50.0)
GOAL_DEDUP = 240.0
SAVE_NEAR = 15.0
RESTART_REACH = 90.0
GOAL_KICK_SOON = 25.0
MISS_REACH = (3.0, 30.0)
SET_PIECE_GAP = (10.0, 90.0)
CORNER_NEAR = 45.0
CORNER_GAPS = (150.0, 600.0, 60.0, 10.0)
CORNER_MOST = 20
SHOT_NEAR = 10.0
SHOT_MOST = 30
CATCH_MOST = 25
GOAL_CHECK_GAP = (20.0, 120.0)
GOAL_CHECK_LEAST = 0.7
GOAL_CHECKED = ("shot_stop_diving", "free_kick_shot", "shot_on_target")
MIN_CONFIDENCE = 0.5
# What rules put in front of an explanation.
PARRY = "PARRY_INFERRED: corner_kick follows shot — GK deflected ball out. Original: "
MISS = "RESTART_RECLASS: goal_kick follows in %.0fs (short gap = miss). Original: "
NO_KICKOFF = "DOWNGRADED: no kickoff confirmation. Original: "
GOAL_NEAR = "DEDUP: nearby goal takes precedence. Original: "
CAUGHT = "CATCH_INFERRED: no restart follows shot within 60s — GK caught and distributed in open play. Original: "
NOT_CAUGHT = "CATCH_REJECTED: VLM probe found no GK holding ball — goal_kick follows, likely miss. Original: "
DEDUP_NEAR = 15.0
CATCH_SKIP = {"save": 15.0, "goal": 30.0, "corner": 90.0, "kickoff": 180.0, "goal_kick": 90.0}


def confirmed(verdicts: DataFrame, *types: str) -> DataFrame:
    rows = verdicts.where(F.col("result") == "confirmed")
    return rows.where(F.col("event_type").isin(*types)) if types else rows


def match_bounds(events: DataFrame, least_gap: float = 180.0) -> DataFrame:
    """(stream_id, game_start, half_start, half_end, match_end): first and last event, and the longest gap in the
    middle part of a match if it reaches ``least_gap``; the first of equal gaps."""
    ends = events.groupBy("stream_id").agg(F.min("t").alias("game_start"), F.max("t").alias("match_end"))
    g = tm.gaps(events).join(ends, "stream_id")
    span = F.col("match_end") - F.col("game_start")
    middle = g.where((F.col("gap_start") >= F.col("game_start") + 0.25 * span) & (F.col("gap_end") <= F.col("game_start") + 0.75 * span) & (F.col("gap_end") - F.col("gap_start") >= least_gap))
    half = middle.groupBy("stream_id").agg(F.max_by(F.struct("gap_start", "gap_end"), F.struct((F.col("gap_end") - F.col("gap_start")).alias("g"), (-F.col("gap_start")).alias("n"))).alias("h"))
    return ends.join(half, "stream_id", "left").select("stream_id", "game_start", F.col("h.gap_start").alias("half_start"), F.col("h.gap_end").alias("half_end"), "match_end")


def in_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows inside the match and outside half-time; half-time bounds of 0 count as unknown."""
    rest = (F.coalesce("half_start", F.lit(0.0)) != 0) & (F.coalesce("half_end", F.lit(0.0)) != 0) & (F.col("t") > F.col("half_start")) & (F.col("t") < F.col("half_end"))
    return df.join(bounds, "stream_id").where((F.col("t") >= F.col("game_start")) & (F.col("t") <= F.col("match_end")) & ~F.coalesce(rest, F.lit(False))).select(*df.columns)


def flagged(df: DataFrame, other: DataFrame, lo: float, hi: float, name: str, lo_open: bool = True, hi_open: bool = True) -> DataFrame:
    """``df`` with a boolean: whether any other row lies in the interval."""
    return tm.asof(df, other.select("stream_id", "seq", "t"), lo, hi, "next", "left", lo_open, hi_open).withColumn(name, F.col("r").isNotNull()).drop("r")


def nearest_gap(df: DataFrame, other: DataFrame, lo: float, hi: float, name: str) -> DataFrame:
    """``df`` with the smallest t' - t of other rows strictly inside (lo, hi), null if there is none."""
    return tm.asof(df, other.select("stream_id", "seq", "t"), lo, hi, "next", "left", True, True).withColumn(name, F.col("r.t") - F.col("t")).drop("r")


def restart_reclassified(shots: DataFrame, saves: DataFrame, corners: DataFrame, goal_kicks: DataFrame, keep_gap: bool = False) -> DataFrame:
    """Shots by what restarts play: a save nearby leaves them; a corner makes a parry; a goal kick soon a miss."""
    out = flagged(shots, saves, -SAVE_NEAR, SAVE_NEAR, "has_save")
    out = flagged(out, corners, 0.0, RESTART_REACH, "has_corner")
    out = nearest_gap(out, goal_kicks, 0.0, RESTART_REACH, "goal_kick_gap")
    kind = F.when(F.col("has_save"), F.col("event_type")).when(F.col("has_corner"), "shot_stop_diving").when(F.col("goal_kick_gap") < GOAL_KICK_SOON, "shot_off_target").otherwise(F.col("event_type"))
    return out.withColumn("event_type", kind).drop("has_save", "has_corner", *["goal_kick_gap"] * (not keep_gap))


WHYS = "array<struct<say:string,keep:int>>"
#: How much of an explanation stays behind a new text.
ALL, SOME, NONE = -1, 100, 0


def narrow(verdicts: DataFrame) -> DataFrame:
    """Verdicts without their explanations, and with no new texts yet."""
    return verdicts.select("stream_id", "seq", "t", "result", "event_type", "confidence", F.array().cast(WHYS).alias("whys"))


def explained(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows with the explanations of ``verdicts``, under the texts that rules put in front."""
    said = verdicts.select("stream_id", "seq", "reasoning")
    put = lambda acc, w: F.concat(w["say"], F.when(w["keep"] < 0, acc).otherwise(F.substring(acc, F.lit(1), w["keep"])))
    told = F.aggregate("whys", F.coalesce("reasoning", F.lit("")), put)
    return rows.join(said, ["stream_id", "seq"], "left").withColumn("reasoning", F.when(F.size("whys") == 0, F.col("reasoning")).otherwise(told)).drop("whys")


def edit(kind: Column | str, confidence: Column, say: Column, keep: int = SOME) -> list[Column]:
    """Columns of an edit: new type and confidence, and the text that goes in front of ``keep`` characters."""
    return [kind.alias("new_type") if isinstance(kind, Column) else F.lit(kind).alias("new_type"), confidence.alias("new_confidence"), say.alias("say"), F.lit(keep).alias("keep")]


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with new type and confidence, confirmed, where ``edits`` has them (stream_id, seq and the columns of ``edit``)."""
    hit = F.col("new_type").isNotNull()
    why = F.array(F.struct(F.col("say"), F.col("keep").cast("int").alias("keep"))).cast(WHYS)
    return rows.join(edits, ["stream_id", "seq"], "left").select(
        "stream_id", "seq", "t", F.when(hit, "confirmed").otherwise(F.col("result")).alias("result"), F.coalesce("new_type", "event_type").alias("event_type"),
        F.coalesce("new_confidence", "confidence").alias("confidence"), F.when(hit, F.concat("whys", why)).otherwise(F.col("whys")).alias("whys"),
    )


def at_clock(df: DataFrame, name: str = "t") -> DataFrame:
    """With the time in whole microseconds, as ``at``, to join equal times on."""
    return df.withColumn("at", F.round(F.col(name) * 1e6).cast("bigint"))


def answered(probes: DataFrame, answers: DataFrame, phase: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Probes (stream_id, t, ...) with the confirmed answer of their phase, if there is one: said_type, said_confidence, said.

    Of several answers at one time the most confident holds, so a probe is never more than one row.
    """
    own = answers.where((F.col("phase") == phase) & (F.col("result") == "confirmed") & F.col("event_type").isNotNull())
    if kinds:
        own = own.where(F.col("event_type").isin(*kinds))
    best = F.max(F.struct(F.col("confidence").alias("said_confidence"), F.col("event_type").alias("said_type"), F.coalesce("reasoning", F.lit("")).alias("said")))
    own = at_clock(own).groupBy("stream_id", "at").agg(best.alias("a")).select("stream_id", "at", "a.said_type", "a.said_confidence", "a.said")
    return at_clock(probes).join(own, ["stream_id", "at"]).drop("at")


def rescans(rows: DataFrame, verdicts: DataFrame, candidates: DataFrame, extent: DataFrame, lo: float, hi: float, offsets: tuple[float, ...]) -> DataFrame:
    """(stream_id, t) to look at again after each row: the first candidate in the span that no verdict has, else fixed offsets.

    ``candidates`` has stream_id, seq, t, ``extent`` stream_id and duration.  Probes in one microsecond, by which
    answers are joined, are one probe: the first.
    """
    seen = verdicts.select("stream_id", "t").distinct()
    fresh = candidates.select("stream_id", "seq", "t").join(seen, ["stream_id", "t"], "left_anti")
    found = tm.asof(rows.select("stream_id", "seq", "t"), fresh, lo, hi, "next")
    direct = tm.offset_probes(found.where(F.col("r").isNull()).join(extent, "stream_id"), offsets, F.col("duration"))
    probes = found.where(F.col("r").isNotNull()).select("stream_id", F.col("r.t").alias("t")).unionByName(direct.select("stream_id", F.col("probe").alias("t")))
    return probes.groupBy("stream_id", F.floor(F.col("t") * 1e6 + 0.5).alias("at")).agg(F.min("t").alias("t")).select("stream_id", "t")


def appended(rows: DataFrame, found: DataFrame, phase: int) -> DataFrame:
    """Rows and, as confirmed verdicts of their own, answered probes; their seq is below 0 and tells phase and time."""
    seq = -(F.lit(phase).cast("bigint") * 10**15 + F.round(F.col("t") * 1e6).cast("bigint"))
    new = found.select(
        "stream_id", seq.alias("seq"), "t", F.lit("confirmed").alias("result"), F.col("said_type").alias("event_type"), F.col("said_confidence").alias("confidence"),
        F.array(F.struct(F.col("said").alias("say"), F.lit(NONE).alias("keep"))).cast(WHYS).alias("whys"),
    )
    return rows.unionByName(new)


def kickoff_probes(rows: DataFrame, candidates: DataFrame, extent: DataFrame) -> DataFrame:
    """Where to look for kickoffs: after shots and goals that none follows; not before the first one."""
    kickoffs = confirmed(rows, "kickoff").select("stream_id", "seq", "t")
    first = kickoffs.groupBy("stream_id").agg(F.min("t").alias("first_t"))
    restarts = kickoffs.join(first, "stream_id").where(F.col("t") != F.col("first_t")).drop("first_t")
    asked = confirmed(rows, *SHOTS, "goal").join(first, "stream_id", "left").where(F.col("first_t").isNull() | (F.col("t") >= F.col("first_t"))).drop("first_t")
    return rescans(tm.within(asked, restarts, *KICKOFF_GAP, "left_anti", True, True), rows, candidates, extent, *KICKOFF_GAP, KICKOFF_PROBES)


def goal_inference(verdicts: DataFrame, rescored: DataFrame | None = None) -> DataFrame:
    """Shots that a kickoff follows become goals; goals without one become shots; goals too close are deduplicated.

    ``rescored`` has further kickoffs (stream_id, seq, t) that focused re-scoring confirmed.  The opening kickoff
    confirms nothing, and nothing before it counts.  Verdicts may have explanations or be ``narrow``.
    """
    rows = verdicts if "whys" in verdicts.columns else narrow(verdicts)
    kickoffs = confirmed(rows, "kickoff").select("stream_id", "seq", "t")
    if rescored is not None:
        kickoffs = kickoffs.unionByName(rescored.select("stream_id", "seq", "t"))
    first = kickoffs.groupBy("stream_id").agg(F.min("t").alias("first_t"))
    restarts = kickoffs.join(first, "stream_id").where(F.col("t") != F.col("first_t")).drop("first_t")
    judged = nearest_gap(confirmed(rows, *SHOTS, "goal"), restarts, *KICKOFF_GAP, "kickoff_gap").join(first, "stream_id", "left")
    ok = F.col("kickoff_gap").isNotNull() & (F.col("first_t").isNull() | (F.col("t") >= F.col("first_t")))
    goal = F.col("event_type") == "goal"
    judged = judged.withColumn("__ok", ok)
    rise = judged.where(F.col("__ok") & ~goal).select("stream_id", "seq", *edit(
        "goal", F.least(F.col("confidence") + 0.1, F.lit(1.0)),
        F.format_string("INFERRED GOAL: %s followed by kickoff %.0fs later. Original: ", F.col("event_type"), F.bround("kickoff_gap", 0)), ALL))
    fall = judged.where(~F.col("__ok") & goal).select("stream_id", "seq", *edit("shot_on_target", F.col("confidence") * 0.85, F.lit(NO_KICKOFF), ALL))
    out = staged(edited(rows, rise.unionByName(fall)), "goals")
    gone = folds.goal_dedup(confirmed(out, "goal"), GOAL_DEDUP)
    lost = confirmed(out, "goal").join(gone, ["stream_id", "seq"], "left_semi").select("stream_id", "seq", *edit("shot_on_target", F.col("confidence") * 0.8, F.lit(GOAL_NEAR), ALL))
    done = edited(out, lost)
    return done if "whys" in verdicts.columns else explained(done, verdicts)


def set_piece_probes(rows: DataFrame, candidates: DataFrame, extent: DataFrame) -> DataFrame:
    """Where to look for corners and goal kicks: after every shot."""
    return rescans(confirmed(rows, *SHOTS, "shot_off_target"), rows, candidates, extent, *SET_PIECE_GAP, CORNER_PROBES)


def shot_restart_rule(rows: DataFrame) -> DataFrame:
    """``restart_reclassified`` over a verdict list."""
    shots = confirmed(rows, "shot_on_target")
    new = restart_reclassified(shots, confirmed(rows, *SAVES), confirmed(rows, "corner_kick"), confirmed(rows, "goal_kick"), keep_gap=True)
    say = F.when(F.col("event_type") == "shot_stop_diving", PARRY).otherwise(F.format_string(MISS, F.bround("goal_kick_gap", 0)))
    return edited(rows, new.where(F.col("event_type") != "shot_on_target").select("stream_id", "seq", *edit(F.col("event_type"), F.col("confidence"), say)))


def corner_probes(rows: DataFrame) -> DataFrame:
    """Where to look for corners: inside long gaps between verdicts, and at throw-ins; not near a known one, the first of a stream."""
    least, most, step, margin = CORNER_GAPS
    inside = tm.gap_probes(rows, least, most, step, margin, 1 << 30).select("stream_id", "t", F.lit(0).cast("bigint").alias("seq"))
    asked = inside.unionByName(confirmed(rows, "throw_in").select("stream_id", "t", "seq"))
    near = tm.within(asked, confirmed(rows, "corner_kick"), -CORNER_NEAR, CORNER_NEAR, "left_anti", True, True)
    return tm.first_rows(near.select("stream_id", "t").distinct(), CORNER_MOST, ("stream_id",), (F.col("t"),), tm.stretch_of("t"), "rank").drop("rank")


def reverse_restart_rule(rows: DataFrame) -> DataFrame:
    """A restart without a save or shot in the 30 s before it: the closest rejected row 3 to 30 s earlier was a miss at 0.6."""
    restarts = confirmed(rows, "corner_kick", "goal_kick")
    open_ = tm.within(restarts, confirmed(rows, *SAVES, "shot_on_target", "shot_off_target"), -30.0, 0.0, "left_anti", True, True)
    lo, hi = MISS_REACH
    found = tm.asof(open_.select("stream_id", "seq", "t", "event_type"), rows.where(F.col("result") == "rejected").select("stream_id", "seq", "t"), -hi, -lo, "last", "inner", True, True)
    # of several restarts after one row the last one is told
    last = found.groupBy("stream_id", F.col("r.seq").alias("seq")).agg(F.max_by(F.struct("event_type", "t"), F.struct("t", F.col("seq").alias("s"))).alias("x"))
    label = F.when(F.col("x.event_type") == "corner_kick", "blocked/deflected → corner").otherwise("missed → goal kick")
    say = F.concat(F.lit("REVERSE_RESTART: "), label, F.lit(" at "), text.clock(F.col("x.t")), F.lit(". Original: "))
    return edited(rows, last.select("stream_id", "seq", *edit("shot_off_target", F.lit(0.6), say)))


def shot_probes(rows: DataFrame) -> DataFrame:
    """Rejected rows that no confirmed one is near, spread over the time of a stream where they are too many."""
    near = tm.within(rows.where(F.col("result") == "rejected"), confirmed(rows), -SHOT_NEAR, SHOT_NEAR, "left_anti", True, True)
    many = near.groupBy("stream_id").agg(F.count("*").alias("n")).where(F.col("n") > SHOT_MOST).select("stream_id")
    spread = tm.time_bins(near.join(many, "stream_id", "left_semi"), SHOT_MOST, F.desc("confidence")).drop("bin")
    return near.join(many, "stream_id", "left_anti").unionByName(spread)


def catch_rule(rows: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Shots on target after which play simply goes on were caught.

    Those with a save, a goal, a corner or a kickoff near stay.  Without a goal kick within 90 s the keeper
    caught; with one, the answer to a probe decides (the first probes of a stream): a catch, or a miss.
    """
    out, near = confirmed(rows, "shot_on_target"), CATCH_SKIP
    out = tm.within(out, confirmed(rows, *SAVES), -near["save"], near["save"], "left_anti", True, True)
    out = tm.within(out, confirmed(rows, "goal"), -near["goal"], near["goal"], "left_anti", True, True)
    out = tm.within(out, confirmed(rows, "corner_kick"), 0.0, near["corner"], "left_anti", True, True)
    out = tm.within(out, confirmed(rows, "kickoff"), 0.0, near["kickoff"], "left_anti", True, True)
    kicks = confirmed(rows, "goal_kick")
    caught = tm.within(out, kicks, 0.0, near["goal_kick"], "left_anti", True, True).select("stream_id", "seq", *edit("catch", F.col("confidence") * 0.85, F.lit(CAUGHT)))
    if answers is None:
        return edited(rows, caught)
    asked = tm.within(out, kicks, 0.0, near["goal_kick"], "left_semi", True, True)
    asked = tm.first_rows(asked, CATCH_MOST, ("stream_id",), tuple(F.col(c) for c in tm.ORDER), tm.stretch_of("t"), "rank").drop("rank")
    yes = answered(asked, answers, "catch").select("stream_id", "seq", *edit(F.col("said_type"), F.col("said_confidence"), F.col("said"), NONE))
    no = asked.join(yes, ["stream_id", "seq"], "left_anti").select("stream_id", "seq", *edit("shot_off_target", F.col("confidence"), F.lit(NOT_CAUGHT)))
    return edited(rows, caught.unionByName(yes).unionByName(no))


def goal_checks(rows: DataFrame) -> DataFrame:
    """Saves and shots that a kickoff follows: they may have been goals."""
    return tm.within(confirmed(rows, *GOAL_CHECKED), confirmed(rows, "kickoff"), *GOAL_CHECK_GAP, "left_semi", True, True)


def goal_check_rule(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Goals by a second model's word, from 0.7 on."""
    sure = answered(goal_checks(rows), answers, "goal", ("goal",)).where(F.col("said_confidence") >= GOAL_CHECK_LEAST)
    say = F.concat(F.lit("GOAL CHECK: "), F.col("said"), F.lit(". Original: "), F.col("event_type"))
    return edited(rows, sure.select("stream_id", "seq", *edit("goal", F.col("said_confidence"), say, NONE)))


# Ranks of types where two related events are too close, and the groups that are related.
PRIORITY = {
    "goal": 10, "penalty": 9, "shot_stop_diving": 8, "shot_stop_standing": 7, "punch": 6, "catch": 5,
    "shot_on_target": 4, "near_miss": 3, "shot_off_target": 2, "corner_kick": 2, "goal_kick": 2, "free_kick_shot": 1,
}
RELATED = {
    **dict.fromkeys(("goal", "penalty", "shot_stop_diving", "shot_stop_standing", "punch", "catch", "shot_on_target", "near_miss", "shot_off_target", "free_kick_shot"), "shot"),
    **dict.fromkeys(("corner_kick", "goal_kick"), "restart"),
}


def looked_up(column: Column, mapping: dict[str, object], default: object = None) -> Column:
    """A fixed map as a CASE expression."""
    out = F.when(F.lit(False), F.lit(next(iter(mapping.values()))))
    for k, v in mapping.items():
        out = out.when(column == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def deduplicated(events: DataFrame, fields: list[str]) -> DataFrame:
    """Two passes against the last kept row, each within 15 s: equal types by confidence, related types by priority."""
    kind = F.col("event_type")
    return folds.dedup_passes(events, DEDUP_NEAR, ((kind, F.col("confidence")), (looked_up(kind, RELATED), looked_up(kind, PRIORITY, 0))), fields)


def run_rules(verdicts: DataFrame, candidates: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """All rules in order over verdicts (stream_id, seq, t, result, event_type, confidence, reasoning).

    ``candidates`` (stream_id, seq, t) are all that might have been scored, by default none but the verdicts;
    ``answers`` are what models said when asked again, by default nothing.  Streams last until their last
    candidate or verdict.
    """
    spark = verdicts.sparkSession
    if answers is None:
        answers = spark.createDataFrame([], "stream_id string, phase string, t double, result string, event_type string, confidence double, reasoning string")
    candidates = (verdicts if candidates is None else candidates).select("stream_id", "seq", "t")
    extent = candidates.unionByName(verdicts.select("stream_id", "seq", "t")).groupBy("stream_id").agg(F.max("t").alias("duration"))
    told = staged(text.shot_reclassified(text.save_reclassified(verdicts)), "told")

    def pieces(rows: DataFrame) -> DataFrame:
        return appended(rows, answered(set_piece_probes(rows, candidates, extent), answers, "set_piece"), 1)

    def corners(rows: DataFrame) -> DataFrame:
        return appended(rows, answered(corner_probes(rows), answers, "corner", ("corner_kick",)), 2)

    def shots(rows: DataFrame) -> DataFrame:
        found = answered(shot_probes(rows), answers, "shot")
        return edited(rows, found.select("stream_id", "seq", *edit(F.col("said_type"), F.col("said_confidence"), F.col("said"), NONE)))

    def goals(rows: DataFrame) -> DataFrame:
        found = answered(kickoff_probes(rows, candidates, extent), answers, "kickoff", ("kickoff",))
        return goal_inference(rows, found.withColumn("seq", F.lit(0).cast("bigint")))

    phases: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [
        ("goals", goals), ("set_pieces", pieces), ("shot_restart", shot_restart_rule), ("corners", corners), ("reverse_restart", reverse_restart_rule),
        ("shots", shots), ("catches", lambda rows: catch_rule(rows, answers)), ("goal_checks", lambda rows: goal_check_rule(rows, answers)),
    ]
    rows = staged(narrow(told), "verdicts")
    for name, phase in phases:
        before, rows = rows, staged(phase(rows), name)
        unstaged(before)
    return explained(rows, told)


def final_events(verdicts: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Events of judged verdicts, deduplicated, in the order of their times."""
    events = vd.verdict_events(verdicts, min_confidence)
    # a save comes before the shot that it met
    events = events.withColumn("seq", F.col("seq") * 2 + F.col("part"))
    return deduplicated(events, ["t", "seq", "event_type", "confidence", "reasoning", "part"]).orderBy("stream_id", "t", "seq")
