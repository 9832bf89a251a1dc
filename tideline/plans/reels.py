"""Reels: which events a reel takes, how they become clips, and plugins that bundle both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import schema
from tideline.operators import folds
from tideline.plans import spatial
from tideline.plans.verdicts import should_include, with_types

# Extra seconds of a clip after a parry, and the order in which signatures name a clip.
PARRY_PAD = 3.0
SIGNATURE_ORDER = ["parry", "catch", "deflection", "missed", "insufficient_data"]
MERGE_GAP = 2.0
CLIP_CAP = 90.0
OVERLAP = 0.3
MIN_CLIP = 2.0


@dataclass(frozen=True)
class ReelSpec:
    """What a user asks for: a name, event types, and a budget in seconds."""

    name: str
    event_types: tuple[str, ...]
    max_reel_sec: float = schema.MAX_REEL_SEC


def specs_of(names: list[str]) -> list[ReelSpec]:
    """Preset specs by name; an unknown name gives a spec without types."""
    return [ReelSpec(n, tuple(schema.REEL_PRESETS.get(n, ()))) for n in names]


def spec_table(spark: SparkSession, specs: list[ReelSpec]) -> DataFrame:
    """(reel, event_type, max_reel_sec), one row a known type of each spec."""
    known = {t[0] for t in schema.EVENT_TYPES}
    rows = [(s.name, t, float(s.max_reel_sec)) for s in specs for t in dict.fromkeys(s.event_types) if t in known]
    return spark.createDataFrame(rows, "reel string, event_type string, max_reel_sec double")


def selected(events: DataFrame, specs: list[ReelSpec], check: bool = True) -> DataFrame:
    """Events of each reel; with ``check`` only those that the review or their confidence admits."""
    rows = with_types(events).where(should_include(F.col("threshold"))) if check else events
    return rows.join(F.broadcast(spec_table(events.sparkSession, specs)), "event_type")


def event_clips(events: DataFrame) -> DataFrame:
    """start, end and cap of each event's clip: the type's padding, longer after a parry, cut to the video.

    ``events`` has t0, t1 (the event's span), duration and signature.
    """
    pre, post, cap = schema.DEFAULT_PADDING
    typed = events if "pre_pad" in events.columns else with_types(events)
    extra = F.when(F.col("signature") == "parry", PARRY_PAD).otherwise(0.0)
    return (
        typed.withColumn("start", F.greatest(F.lit(0.0), F.col("t0") - F.coalesce("pre_pad", F.lit(pre))))
        .withColumn("end", F.least(F.col("duration"), F.col("t1") + F.coalesce("post_pad", F.lit(post)) + extra))
        .withColumn("cap", F.least(F.coalesce("max_clip", F.lit(cap)), F.lit(CLIP_CAP)))
    )


def reel_clips(events: DataFrame, by: tuple[str, ...] = ("stream_id", "reel"), gap: float = MERGE_GAP) -> DataFrame:
    """Clips of each reel: padded, merged under the running cap, named after the most confident event."""
    return folds.capped_merge(event_clips(events), gap, F.col("cap"), by)


def finished(clips: DataFrame, budget: DataFrame | None = None, by: tuple[str, ...] = ("stream_id", "reel"), cap: float = schema.MAX_REEL_SEC) -> DataFrame:
    """Suppresses overlaps, drops clips under two seconds, prunes to the budget; in that order."""
    rows = clips.withColumn("n_events", F.size("members")).withColumn("seq", F.element_at("members", 1)).withColumn("score", F.coalesce("confidence", F.lit(0.5)))
    kept = folds.suppress_overlaps(rows, OVERLAP, by, fields=["start", "end", "seq", "n_events", "score", "event_type", "members"])
    return folds.budget_prune(kept.where(F.col("end") - F.col("start") >= MIN_CLIP), cap, by)


def clip_stats(clips: DataFrame, *by: str) -> DataFrame:
    """Clips, seconds in all and on average, kinds."""
    length = F.col("end") - F.col("start")
    return clips.groupBy(*by).agg(F.count("*").alias("clips"), F.sum(length).alias("seconds"), F.bround(F.avg(length), 1).alias("mean_seconds"), F.count_distinct("event_type").alias("kinds"))


def signature_of(signatures: Column) -> Column:
    """The signature of a clip: the first, in the fixed order, that any of its events has."""
    order = F.array(*map(F.lit, SIGNATURE_ORDER))
    ranks = F.transform(F.filter(signatures, lambda s: F.array_contains(order, s)), lambda s: F.array_position(order, s))
    return F.when(F.size(ranks) > 0, F.get(order, (F.array_min(ranks) - 1).cast("int")))


@dataclass(frozen=True)
class ClipParams:
    """How a plugin cuts clips; all in seconds."""

    pre_pad: float = 3.0
    post_pad: float = 5.0
    max_clip: float = CLIP_CAP
    merge_gap: float = MERGE_GAP
    min_clip: float = MIN_CLIP
    max_reel: float = schema.MAX_REEL_SEC

    def __post_init__(self):
        if min(self.pre_pad, self.post_pad, self.merge_gap, self.min_clip) < 0 or min(self.max_clip, self.max_reel) <= 0:
            raise ValueError("clip parameters must not be negative, and limits must be positive")


@dataclass(frozen=True)
class Context:
    """What a plugin may know besides the events: half-time, and sides if the keeper's are known."""

    half_t: float = 2700.0
    sides: DataFrame | None = None


class Plugin(Protocol):
    """A named selection of events for a reel and a filter of its clips; both pure."""

    name: str
    reel: str
    params: ClipParams

    def select(self, events: DataFrame, ctx: Context) -> DataFrame: ...

    def post(self, clips: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class KeeperPlugin:
    """Keeper events of some types that pass inclusion, the similarity gate and the side filter."""

    name: str
    event_types: tuple[str, ...]
    reel: str = "keeper"
    params: ClipParams = field(default_factory=ClipParams)
    saves_gate: float = 0.55

    def select(self, events: DataFrame, ctx: Context) -> DataFrame:
        rows = with_types(events) if "threshold" not in events.columns else events
        keeper = F.coalesce(F.col("is_goalkeeper_event"), F.lit(False)) | (F.col("event_type") == "penalty")
        gate = spatial.similarity_gate(F.col("event_type"), F.col("similarity"), self.saves_gate, goal_kick_exempt=False)
        own = rows.where(F.col("event_type").isin(*self.event_types) & keeper & should_include(F.col("threshold")) & gate)
        half = F.lit(ctx.half_t)
        sides = ctx.sides if ctx.sides is not None else spatial.keeper_sides(spatial.side_voters(rows), half, opposite=False)
        return spatial.own_side(own, sides, half)

    def post(self, clips: DataFrame) -> DataFrame:
        return clips.where(F.col("end") - F.col("start") >= self.params.min_clip)


@dataclass(frozen=True)
class HighlightsPlugin:
    """Shots and goals that pass inclusion."""

    name: str = "highlights_shots"
    reel: str = "highlights"
    event_types: tuple[str, ...] = tuple(schema.HIGHLIGHT_TYPES)
    params: ClipParams = field(default_factory=ClipParams)

    def select(self, events: DataFrame, ctx: Context) -> DataFrame:
        rows = with_types(events) if "threshold" not in events.columns else events
        return rows.where(F.col("event_type").isin(*self.event_types) & should_include(F.col("threshold")))

    def post(self, clips: DataFrame) -> DataFrame:
        return clips.where(F.col("end") - F.col("start") >= self.params.min_clip)


BUILT_IN: dict[str, Callable[[], Plugin]] = {
    "keeper_saves": lambda: KeeperPlugin("keeper_saves", (*schema.SAVE_TYPES, "penalty")),
    "keeper_goal_kick": lambda: KeeperPlugin("keeper_goal_kick", ("goal_kick",)),
    "keeper_distribution": lambda: KeeperPlugin("keeper_distribution", ("distribution_short", "distribution_long")),
    "keeper_one_on_one": lambda: KeeperPlugin("keeper_one_on_one", ("one_on_one",)),
    "keeper_corner_kick": lambda: KeeperPlugin("keeper_corner_kick", ("corner_kick",)),
    "highlights_shots": HighlightsPlugin,
}


class PluginRegistry:
    """Plugins by name; reels in the order in which they were first named."""

    def __init__(self):
        self._plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self._plugins:
            raise ValueError(f"plugin {plugin.name} is registered already")
        self._plugins[plugin.name] = plugin

    def of_reel(self, reel: str) -> list[Plugin]:
        return [p for p in self._plugins.values() if p.reel == reel]

    @property
    def reels(self) -> list[str]:
        return [*dict.fromkeys(p.reel for p in self._plugins.values())]

    @classmethod
    def from_names(cls, names: list[str] | None = None) -> PluginRegistry:
        """Built-in plugins by name, all by default; an unknown name is a KeyError."""
        out = cls()
        for name in BUILT_IN if names is None else names:
            out.register(BUILT_IN[name]())
        return out
