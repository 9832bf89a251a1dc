"""Annotated truths in their several layouts, and the clock rows of games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels by name and outcome (else type) of an annotation.
LABELS = {
    ("Shots & Goals", "Goals"): "goal", ("Shots & Goals", "Shots On Target"): "shot_on_target", ("Shots & Goals", "Shots Off Target"): "shot_off_target",
    ("Shots & Goals", "Blocked Shots"): "shot_blocked", ("Shots & Goals", "Keeper Rush-outs"): "keeper_rushout", ("Saves", "Catches"): "save_catch", ("Saves", "Parries"): "save_parry",
    ("Set Pieces", "Corners"): "corner_kick", ("Set Pieces", "Goal Kicks"): "goal_kick", ("Set Pieces", "Throw-Ins"): "throw_in", ("Set Pieces", "Freekicks"): "free_kick", ("Set Pieces", "Penalty Kicks"): "penalty",
}
ANCHORS = ["throw_in", "corner_kick", "goal_kick", "free_kick"]
GAME_ANCHORS = ["throw_in", "corner_kick", "goal_kick"]
# Where each category's arrays are, and the type that they stand for.
CATEGORIES = [
    ("goal", "goals.events"), ("shot_on_target", "shots_on_target.events"), ("corner_kick", "corners.events"), ("goal_kick", "goal_kicks.elena_goal_kicks.events"), ("goal_kick", "goal_kicks.opponent_goal_kicks.events"),
    ("throw_in", "throw_ins.events"), ("free_kick_shot", "free_kicks.events"), ("saves", "saves.elena_saves.events"), ("saves", "saves.opponent_gk_saves.events"),
]
MOMENTS = "events: array<struct<time_ms:bigint,half:int>>"
CATEGORY_DDL = (
    f"goals struct<{MOMENTS}>, shots_on_target struct<{MOMENTS}>, corners struct<{MOMENTS}>, throw_ins struct<{MOMENTS}>, free_kicks struct<{MOMENTS}>, "
    f"goal_kicks struct<elena_goal_kicks: struct<{MOMENTS}>, opponent_goal_kicks: struct<{MOMENTS}>>, saves struct<elena_saves: struct<{MOMENTS}>, opponent_gk_saves: struct<{MOMENTS}>>"
)


def annotations(docs: DataFrame) -> DataFrame:
    """Exported annotations one a row: game, row_no, event_no, name, type, outcome, half, ms, team, player, x, y."""
    have = {f.name for f in docs.schema["data"].dataType.elementType}
    rows = docs.select("game", F.posexplode("data").alias("row_no", "d")).select("game", "row_no", "d.*", F.posexplode("d.events").alias("event_no", "e"))
    extra = [(F.col(c) if c in have else F.lit(None).cast("string")).alias(a) for c, a in (("team_name", "team"), ("player_name", "player"))]
    return rows.select(
        "game", "row_no", "event_no", F.col("e.event_name").alias("name"), F.col("e.property.Type").alias("type"), F.col("e.property.Outcome").alias("outcome"),
        F.when(F.coalesce(F.col("period_name").startswith("1st"), F.lit(False)), 1).otherwise(2).alias("half"), F.coalesce("event_time", F.lit(0)).alias("ms"), *extra, "x", "y",
    )


def outcome_label(name: Column, type_: Column, outcome: Column) -> Column:
    """A label by outcome first, then by what the type is or holds; null for all else."""
    kind, out = F.coalesce(type_, F.lit("")), F.coalesce(outcome, F.lit(""))
    shot, piece = name == "Shots & Goals", name == "Set Pieces"
    return (
        F.when(shot & (out == "Goals"), "goal").when(shot & (out == "Shots On Target"), "shot_on_target").when(shot & (out == "Shots Off Target"), "shot_off_target").when(shot & (out == "Blocked Shots"), "blocked_shot")
        .when((name == "Saves") & (kind == "Catches"), "catch").when((name == "Saves") & (kind == "Parries"), "parry").when(piece & (kind == "Goal Kicks"), "goal_kick").when(kind.contains("Corners"), "corner_kick")
        .when(piece & (kind == "Throw-Ins"), "throw_in").when(piece & kind.contains("Freekick"), "free_kick").when(piece & kind.contains("Penalty"), "penalty")
    )


def outcome_truths(docs: DataFrame) -> DataFrame:
    a = annotations(docs).withColumn("label", outcome_label(F.col("name"), F.col("type"), F.col("outcome")))
    return a.where(F.col("label").isNotNull()).select("game", "label", (F.col("ms") / 1000.0).alias("t"), "team", "player")


def labelled_truths(docs: DataFrame) -> DataFrame:
    """Annotations with one of the twelve labels, by name and outcome, or type where there is no outcome."""
    a = annotations(docs).withColumn("key", F.coalesce("outcome", "type", F.lit("")))
    label = F.lit(None).cast("string")
    for (name, key), value in LABELS.items():
        label = F.when((F.col("name") == name) & (F.col("key") == key), value).otherwise(label)
    return a.withColumn("label", label).where(F.col("label").isNotNull()).drop("key", "name", "type", "outcome")


def on_video(truths: DataFrame, offsets: DataFrame) -> DataFrame:
    """Truths with ``t``, their second in the video, by the offsets of game and half (game, h1_offset, h2_offset)."""
    return truths.join(F.broadcast(offsets), "game").withColumn("t", F.col("ms") / 1000.0 + F.when(F.col("half") == 1, F.col("h1_offset")).otherwise(F.col("h2_offset"))).drop("h1_offset", "h2_offset")


def category_truths(docs: DataFrame, pre_game: float = 800.0) -> DataFrame:
    """(game, event_type, half, t) of documents with one array a category (game and the columns of CATEGORY_DDL)."""
    def moments(kind: str, path: str) -> Column:
        held = F.coalesce(F.col(path), F.array().cast("array<struct<time_ms:bigint,half:int>>"))
        return F.transform(held, lambda e: F.struct(F.lit(kind).alias("event_type"), e["half"].alias("half"), (pre_game + e["time_ms"] / 1000.0).alias("t")))

    return docs.select("game", F.inline(F.concat(*(moments(*c) for c in CATEGORIES))))


def first_anchors(truths: DataFrame, kinds: list[str], or_any: bool = False) -> DataFrame:
    """(game, half, events, ms, label, team) of the first truth of ``kinds`` in each half; with ``or_any`` else the first of all."""
    own = F.col("label").isin(kinds)
    pick = F.struct("ms", "label", "team")
    order = F.struct(F.col("ms"), F.col("row_no"), F.col("event_no"))
    anchor = F.min_by(F.when(own, pick), F.when(own, order))
    if or_any:
        anchor = F.coalesce(anchor, F.min_by(pick, order))
    return truths.groupBy("game", "half").agg(F.count("*").alias("events"), anchor.alias("a"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")).select("game", "half", "events", "first_ms", "last_ms", "a.*")


def _halves(anchors: DataFrame, *fields: str) -> DataFrame:
    side = lambda h: F.first(F.when(F.col("half") == h, F.struct(*fields)), ignorenulls=True).alias(f"h{h}")
    return anchors.groupBy("game").agg(side(1), side(2))


def calibration_template(truths: DataFrame) -> DataFrame:
    """A row a game to fill in: the first set piece of each half, and how many truths it has."""
    h = _halves(first_anchors(truths, ANCHORS), "events", "ms", "label", "team")
    one = lambda k: [F.col(f"h{k}.ms").alias(f"h{k}_anchor_event_ms"), F.col(f"h{k}.label").alias(f"h{k}_anchor_event_label"), F.col(f"h{k}.team").alias(f"h{k}_anchor_event_team"), F.lit(None).cast("double").alias(f"h{k}_anchor_video_sec"), F.lit(None).cast("double").alias(f"h{k}_offset_sec")]
    return h.select("game", *one(1), *one(2), F.format_string("Total events: H1=%d, H2=%d", F.coalesce("h1.events", F.lit(0)), F.coalesce("h2.events", F.lit(0))).alias("notes"))


def game_rows(truths: DataFrame, transitions: DataFrame) -> DataFrame:
    """A clock row a game from its truths and its transitions (game, h1_kickoff, ht_start, ht_end, h2_kickoff, in video seconds).

    Offsets are kickoff less clock; the second is checked against what half-time leads to expect.  Games
    without truths in both halves go.
    """
    h = _halves(first_anchors(truths, GAME_ANCHORS, or_any=True), "events", "ms", "label", "first_ms", "last_ms").where(F.col("h1").isNotNull() & F.col("h2").isNotNull())
    g = h.join(transitions, "game").withColumn("o1", F.col("h1_kickoff")).withColumn("o2", F.col("h2_kickoff") - F.col("h2.first_ms") / 1000.0)
    expected = F.col("o1") + (F.col("ht_end") - F.col("ht_start")) - (F.col("h2.first_ms") - F.col("h1.last_ms")) / 1000.0
    r = lambda c: F.round(c, 1)
    return g.select(
        "game", r(F.col("o1")).alias("h1_offset_sec"), r(F.col("o2")).alias("h2_offset_sec"), r(expected).alias("expected_h2_offset_sec"), r(F.abs(F.col("o2") - expected)).alias("h2_offset_delta_sec"),
        r(F.col("ht_end") - F.col("ht_start")).alias("halftime_gap_sec"),
        *(c for k in (1, 2) for c in (F.col(f"h{k}.ms").alias(f"h{k}_anchor_event_ms"), F.col(f"h{k}.label").alias(f"h{k}_anchor_event_label"), r(F.col(f"h{k}.ms") / 1000.0 + F.col(f"o{k}")).alias(f"h{k}_anchor_predicted_video_sec"))),
        F.format_string("H1=%d, H2=%d events", "h1.events", "h2.events").alias("notes"),
    )


def overridden(rows: DataFrame, manual: DataFrame) -> DataFrame:
    """Clock rows whose offsets a manual anchor (game, h1_anchor_video_sec, h2_anchor_video_sec) replaces where it has one."""
    m = rows.join(manual, "game", "left")
    new = {f"h{k}_offset_sec": F.coalesce(F.round(F.col(f"h{k}_anchor_video_sec") - F.col(f"h{k}_anchor_event_ms") / 1000.0, 1), F.col(f"h{k}_offset_sec")) for k in (1, 2)}
    return m.select(*(new.get(c, F.col(c)).alias(c) for c in rows.columns))


def games_of(files: DataFrame) -> DataFrame:
    """(game, videos, exports) of folders with a video and an export at least; ``files`` has path."""
    f = files.select(F.element_at(F.split("path", "/"), -2).alias("game"), F.lower(F.substring_index("path", ".", -1)).alias("kind"), "path")
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("path"))))
    return f.groupBy("game").agg(pick("mp4").alias("videos"), pick("json").alias("exports")).where((F.size("videos") > 0) & (F.size("exports") > 0))


def labelled_records(records: DataFrame) -> DataFrame:
    """Training or holdout records (one JSON text ``value`` a row) with their true label, "none" without one."""
    meta = F.try_parse_json("value")
    return records.where(meta.isNotNull()).select("*", F.coalesce(F.try_variant_get(meta, "$._meta.label", "string"), F.lit("none")).alias("label"))
