"""The event row, the closed set of event types, and the small dimension tables that rules look up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT_DDL = (
    "event_id string, job_id string, source_file string, event_type string, timestamp_start double, timestamp_end double, "
    "confidence double, reel_targets array<string>, player_track_id bigint, is_goalkeeper_event boolean, frame_start bigint, "
    "frame_end bigint, bounding_box struct<x:double,y:double,width:double,height:double>, "
    "field_position struct<x_meters:double,y_meters:double>, reviewed boolean, review_override boolean, metadata string, created_at string"
)

# Event types with label, category, seconds before and after in a clip, longest clip,
# detection threshold, whether a keeper acts, inclusion threshold, and default reels.
EVENT_TYPES = [
    ("shot_stop_diving", "Diving Save", "goalkeeper", 8.0, 2.0, 25.0, 0.75, True, 0.55, []),
    ("shot_stop_standing", "Standing Save", "goalkeeper", 8.0, 2.0, 25.0, 0.70, True, 0.55, []),
    ("punch", "Punch", "goalkeeper", 8.0, 2.0, 25.0, 0.65, True, 0.60, []),
    ("catch", "Catch", "goalkeeper", 8.0, 2.0, 25.0, 0.70, True, 0.60, []),
    ("goal_kick", "Goal Kick", "goalkeeper", 10.0, 15.0, 45.0, 0.65, True, 0.50, []),
    ("distribution_short", "Short Distribution", "goalkeeper", 1.0, 2.0, 20.0, 0.65, True, 0.60, []),
    ("distribution_long", "Long Distribution", "goalkeeper", 1.0, 2.0, 20.0, 0.68, True, 0.60, []),
    ("one_on_one", "1-on-1", "goalkeeper", 3.0, 2.0, 30.0, 0.75, True, 0.65, []),
    ("corner_kick", "Corner Kick", "goalkeeper", 5.0, 12.0, 35.0, 0.65, True, 0.50, []),
    ("penalty", "Penalty", "goalkeeper", 8.0, 2.0, 25.0, 0.60, True, 0.50, ["highlights", "keeper"]),
    ("shot_on_target", "Shot on Target", "highlights", 3.0, 5.0, 30.0, 0.70, False, 0.55, ["highlights"]),
    ("shot_off_target", "Shot off Target", "highlights", 3.0, 5.0, 30.0, 0.65, False, 0.55, ["highlights"]),
    ("goal", "Goal", "highlights", 10.0, 15.0, 60.0, 0.50, False, 0.50, ["highlights"]),
    ("near_miss", "Near Miss", "highlights", 3.0, 5.0, 30.0, 0.70, False, 0.60, ["highlights"]),
    ("dribble_sequence", "Dribble Sequence", "highlights", 3.0, 5.0, 30.0, 0.65, False, 0.65, []),
    ("tackle", "Tackle", "highlights", 3.0, 5.0, 30.0, 0.65, False, 0.65, []),
    ("free_kick_shot", "Free Kick Shot", "highlights", 3.0, 5.0, 30.0, 0.65, False, 0.55, ["highlights"]),
    ("kickoff", "Kickoff", "highlights", 2.0, 2.0, 10.0, 0.50, False, 0.50, []),
    ("throw_in", "Throw-in", "highlights", 1.0, 2.0, 10.0, 0.50, False, 0.50, []),
    ("set_piece", "Set Piece", "highlights", 3.0, 5.0, 30.0, 0.50, False, 0.50, ["highlights"]),
]
EVENT_TYPES_DDL = (
    "event_type string, label string, category string, pre_pad double, post_pad double, max_clip double, "
    "min_confidence double, is_gk boolean, threshold double, reels array<string>"
)
DEFAULT_THRESHOLD = 0.65
DEFAULT_PADDING = (3.0, 5.0, 90.0)

# Reel presets.
KEEPER_TYPES = [
    "shot_stop_diving", "shot_stop_standing", "punch", "catch", "goal_kick", "distribution_short",
    "distribution_long", "one_on_one", "corner_kick", "penalty", "goal", "shot_on_target",
]
HIGHLIGHT_TYPES = ["shot_on_target", "shot_off_target", "goal", "near_miss", "penalty", "free_kick_shot"]
REEL_PRESETS = {
    "keeper": KEEPER_TYPES, "goalkeeper": KEEPER_TYPES, "highlights": HIGHLIGHT_TYPES,
    "goal_kicks": ["goal_kick"], "goal_kick": ["goal_kick"], "corner_kicks": ["corner_kick"],
    "corner_kick": ["corner_kick"], "goals": ["goal"], "goal": ["goal"],
}
MAX_REEL_SEC = 1200.0

# The states of a job, and the states from which each action is allowed.
JOB_STATUS = ["pending", "ingesting", "detecting", "segmenting", "assembling", "complete", "failed", "paused", "cancelled"]

SAVE_TYPES = ["shot_stop_diving", "shot_stop_standing", "punch", "catch"]
SHOT_TYPES = ["shot_on_target", "shot_off_target"]


def event_types(spark: SparkSession) -> DataFrame:
    """The dimension of event types; 20 rows."""
    return spark.createDataFrame(EVENT_TYPES, EVENT_TYPES_DDL)


def reel_presets(spark: SparkSession) -> DataFrame:
    """Preset reels by name; 9 rows."""
    return spark.createDataFrame([(k, v, MAX_REEL_SEC) for k, v in REEL_PRESETS.items()], "reel string, event_types array<string>, max_reel_sec double")


def values_sql(rows: list[tuple], names: str) -> str:
    """The same fixed rows as a DuckDB table expression, for the SQL twins."""
    def lit(x) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "[" + ", ".join(map(lit, x)) + "]::VARCHAR[]"
        return f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"
