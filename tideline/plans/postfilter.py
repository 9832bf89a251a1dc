"""The contextual filter of single events: demotions, promotions and their provenance, in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import timeline as tm

# Types that may precede a catch, and those that a kickoff turns into goals.
BEFORE_CATCH = ["shot_on_target", "shot_stop_diving", "shot_stop_standing", "goal", "free_kick_shot", "penalty", "corner_kick"]
PROMOTED = ["shot_on_target", "shot_stop_diving", "shot_stop_standing"]


def post_filter(events: DataFrame, single_pass: bool = True) -> DataFrame:
    """Events (stream_id, seq, t, event_type, confidence, reasoning, cluster_size) after all contextual rules.

    Kickoffs go, but those with evidence and a cluster of two or more confirm goals 10 to 90 s before them.
    Goals without evidence (unless ``single_pass``) and goals told as saves become shots; standing saves become
    catches, and catches need a shot in the 10 s before them.  ``notes`` says what was done.  All conditions
    read the events as they came in.
    """
    kickoffs = events.where((F.col("event_type") == "kickoff") & text.kickoff_evidence(F.col("reasoning")) & (F.coalesce("cluster_size", F.lit(1)) >= 2))
    shots = events.where(F.col("event_type").isin(BEFORE_CATCH))
    rows = events.where(F.col("event_type") != "kickoff")
    mark = lambda hits, name: hits.select("stream_id", "seq", F.lit(True).alias(name))
    rows = rows.join(mark(tm.within(rows, kickoffs, 10.0, 90.0, "left_semi"), "ko"), ["stream_id", "seq"], "left")
    base = [c for c in rows.columns if c != "ko"]
    rows = rows.join(mark(tm.within(rows.select(*base), shots, -10.0, 0.0, "left_semi", False, True), "shot"), ["stream_id", "seq"], "left")

    demoted = (F.col("event_type") == "goal") & ~F.lit(single_pass) & ~text.goal_evidence(F.lower("reasoning"))
    one = F.when(demoted, "shot_on_target").otherwise(F.col("event_type"))
    rows = rows.withColumn("k1", one)
    inferred = F.col("k1").isin(PROMOTED) & F.col("ko")
    rows = rows.withColumn("k2", F.when(F.coalesce(inferred, F.lit(False)), "goal").otherwise(F.col("k1"))).withColumn("inferred", F.coalesce(inferred, F.lit(False)))
    rows = rows.withColumn("k3", F.when(F.col("k2") == "shot_stop_standing", "catch").otherwise(F.col("k2")))
    rows = rows.where((F.col("k3") != "catch") | F.col("shot"))
    suppressed = (F.col("k3") == "goal") & ~F.col("inferred") & text.save_language(F.col("reasoning"))
    notes = F.array_compact(F.array(F.when(demoted, "goal_demoted"), F.when(F.col("inferred"), "goal_inferred"), F.when(suppressed, "goal_suppressed")))
    return rows.select(
        *(c for c in base if c not in ("event_type", "confidence")),
        F.when(suppressed, "shot_on_target").otherwise(F.col("k3")).alias("event_type"),
        F.when(F.col("inferred"), F.least(F.col("confidence") + 0.1, F.lit(1.0))).otherwise(F.col("confidence")).alias("confidence"), notes.alias("notes"),
    )
