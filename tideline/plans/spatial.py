"""Rules on positions: bands of the field, distances in equal frames, spread, velocity, sides of a half."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.timeline import in_order

# Bands of the field in shares of its width and height.
TOUCHLINE = (0.28, 0.72)
CORNER = (0.25, 0.75)
GOAL_LINE = (0.20, 0.80)
MIDFIELD = (0.35, 0.65)
EXEMPT = ("penalty", "corner_kick", "goal_kick")
SIDE_EXEMPT = ("corner_kick", "goal_kick")
VOTER_CONFIDENCE, VOTER_SIMILARITY = 0.75, 0.77
STATIONARY = (0.04, 0.08)
# Fixed values of contacts: degrees, shares of the speed before, and a speed in shares of the field a second.
PARRY_ANGLE, DEFLECTION_ANGLE = 90.0, 30.0
CATCH_RATIO, MISSED_RATIO = 0.3, 0.8
LEAST_MOTION = 0.01


def proximity(a: DataFrame, b: DataFrame, limit: float, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Per frame with both kinds of points: the smallest distance, its time (the earliest of equals), and whether it is within ``limit``."""
    right = b.select(*by, "frame", F.col("x").alias("bx"), F.col("y").alias("by_"))
    d = F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by_")) * (F.col("y") - F.col("by_")))
    best = F.min(F.struct(d.alias("d"), F.col("t").alias("t")))
    return a.join(right, [*by, "frame"]).groupBy(*by, "frame").agg(best.alias("m")).select(*by, "frame", F.col("m.d").alias("distance"), F.col("m.t").alias("contact_t"), (F.col("m.d") <= limit).alias("contact"))


def throw_in_place(y: Column) -> Column:
    return (y <= TOUCHLINE[0]) | (y >= TOUCHLINE[1])


def corner_place(x: Column, y: Column) -> Column:
    """Within the corner band of both axes."""
    edge = lambda v: (v <= CORNER[0]) | (v >= CORNER[1])
    return edge(x) & edge(y)


def goal_kick_place(x: Column, y: Column) -> Column:
    return ((x <= GOAL_LINE[0]) | (x >= GOAL_LINE[1])) & (y >= CORNER[0]) & (y <= CORNER[1])


def landmark(kind: Column, x: Column, y: Column) -> Column:
    """Whether a restart happens where it can; true for kinds without a rule."""
    return F.when(kind == "throw_in", throw_in_place(y)).when(kind == "corner_kick", corner_place(x, y)).when(kind == "goal_kick", goal_kick_place(x, y)).otherwise(True)


def similarity_gate(kind: Column, similarity: Column, saves: float = 0.60, goal_kick_exempt: bool = True) -> Column:
    """Penalties, corners (and goal kicks) pass; saves need ``saves``, all else 0.75; a missing value is 0."""
    exempt = EXEMPT if goal_kick_exempt else EXEMPT[:2]
    s = F.coalesce(similarity, F.lit(0.0))
    return F.when(kind.isin(*exempt), True).when(kind.isin("shot_stop_diving", "shot_stop_standing", "punch", "catch"), s >= saves).otherwise(s >= 0.75)


def side_voters(df: DataFrame) -> DataFrame:
    """Keeper events that say where the keeper stands: sure, alike, placed outside midfield, and no restart."""
    mid = (F.col("x") > MIDFIELD[0]) & (F.col("x") < MIDFIELD[1])
    sure = (F.col("confidence") >= VOTER_CONFIDENCE) & (F.col("similarity") >= VOTER_SIMILARITY)
    return df.where(F.col("is_goalkeeper_event") & F.col("x").isNotNull() & ~mid & sure & ~F.col("event_type").isin(*SIDE_EXEMPT))


def keeper_sides(df: DataFrame, half_t: Column, share: float = 0.55, least: int = 2, opposite: bool = True) -> DataFrame:
    """(stream_id, first_side, second_side): in each half the side with at least ``share`` of two or more voters, left first.

    With ``opposite`` the sides of the halves differ: an unknown one follows from the other, and where both
    agree, the half with more voters decides (the first, of equals).
    """
    left = F.col("x") < 0.5
    first = F.col("t") < half_t
    votes = df.groupBy("stream_id").agg(
        F.count_if(first).alias("n1"), F.count_if(first & left).alias("l1"), F.count_if(~first).alias("n2"), F.count_if(~first & left).alias("l2")
    )
    side = lambda n, k: F.when(n < least, None).when(k / n >= share, "left").when((n - k) / n >= share, "right")
    other = lambda s: F.when(s == "left", "right").when(s == "right", "left")
    s1, s2 = side(F.col("n1"), F.col("l1")), side(F.col("n2"), F.col("l2"))
    both = votes.withColumn("s1", s1).withColumn("s2", s2)
    if not opposite:
        return both.select("stream_id", F.col("s1").alias("first_side"), F.col("s2").alias("second_side"))
    clash = F.col("s1") == F.col("s2")
    return both.select(
        "stream_id",
        F.when(clash & (F.col("n2") > F.col("n1")), other(F.col("s2"))).otherwise(F.coalesce("s1", other(F.col("s2")))).alias("first_side"),
        F.when(clash & (F.col("n2") <= F.col("n1")), other(F.col("s1"))).otherwise(F.coalesce("s2", other(F.col("s1")))).alias("second_side"),
    )


def own_side(df: DataFrame, sides: DataFrame, half_t: Column) -> DataFrame:
    """Rows outside midfield on the keeper's side of their half; goal kicks, corners, rows without a place, and unknown sides stay."""
    side = F.when(F.col("t") < half_t, F.col("first_side")).otherwise(F.col("second_side"))
    mid = (F.col("x") > MIDFIELD[0]) & (F.col("x") < MIDFIELD[1])
    fits = F.when(F.col("x").isNull() | F.col("event_type").isin(*SIDE_EXEMPT), True).when(mid, False).when(side.isNull(), True).when(side == "left", F.col("x") < 0.5).otherwise(F.col("x") >= 0.5)
    return df.join(sides, "stream_id", "left").where(fits).select(*df.columns)


def spread(points: DataFrame, *by: str) -> DataFrame:
    """Population deviation of x and y, the larger, and the gate's word: moving, still, or kept for want of points."""
    s = points.groupBy(*by).agg(F.count("*").alias("points"), F.greatest(F.stddev_pop("x"), F.stddev_pop("y")).alias("spread"))
    word = F.when(F.col("points") < 2, "keep").when(F.col("spread") >= STATIONARY[1], "reject").when(F.col("spread") <= STATIONARY[0], "keep").otherwise("keep_unsure")
    return s.withColumn("verdict", word)


def velocities(points: DataFrame, *by: str) -> DataFrame:
    """Mean velocity of each track over steps longer than a microsecond, its speed, and the number of steps."""
    w = in_order(*by)
    dt = F.col("t") - F.lag("t").over(w)
    steps = points.withColumn("dt", dt).withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.col("y") - F.lag("y").over(w)).where(F.col("dt") > 1e-6)
    v = steps.groupBy(*by).agg(F.avg(F.col("dx") / F.col("dt")).alias("vx"), F.avg(F.col("dy") / F.col("dt")).alias("vy"), F.count("*").alias("steps"))
    return v.withColumn("speed", F.hypot("vx", "vy"))


def turn(ax: Column, ay: Column, bx: Column, by_: Column) -> Column:
    """Degrees between two directions; null where one has no length."""
    n = F.hypot(ax, ay) * F.hypot(bx, by_)
    cos = (ax * bx + ay * by_) / n
    return F.when(n > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def split_tracks(balls: DataFrame, keepers: DataFrame, *by: str) -> DataFrame:
    """One row a track (``by``): its points, the contact, and the mean velocity on either side of it.

    The contact is the point nearest to a keeper seen at the same time (to hundredths of a second; the earliest of equals),
    or the middle point where no keeper is seen with the ball; it is moved inwards until a step lies on either side.
    ``balls`` has t, seq, x, y and ``keepers`` t, x, y.  Columns: points, contact_t and distance (null without a keeper),
    vx0, vy0, vx1, vy1, which are 0 where a side has no step longer than a microsecond.
    """
    w = in_order(*by)
    frame = F.bround("t", 2).alias("frame")
    places = balls.select(*by, "t", "seq", "x", "y", (F.row_number().over(w) - 1).alias("i"), F.lag("t").over(w).alias("t0"), F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), frame)
    seen = keepers.select(*by, F.bround("t", 2).alias("frame"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    dx, dy = F.col("x") - F.col("kx"), F.col("y") - F.col("ky")
    apart = F.sqrt(dx * dx + dy * dy)
    nearest = places.join(seen, [*by, "frame"]).groupBy(*by).agg(F.min(F.struct(apart.alias("d"), "i", "t")).alias("m"))
    sizes = places.groupBy(*by).agg(F.count("*").alias("points")).join(nearest, list(by), "left")
    at = F.greatest(F.lit(1), F.least(F.coalesce("m.i", F.floor(F.col("points") / 2)), F.col("points") - 2))
    contacts = sizes.select(*by, "points", at.alias("at"), F.col("m.t").alias("contact_t"), F.col("m.d").alias("distance"))
    dt = F.col("t") - F.col("t0")
    side = lambda cond, new, old: F.coalesce(F.avg(F.when(cond & (dt > 1e-6), (F.col(new) - F.col(old)) / dt)), F.lit(0.0))
    before, after = F.col("i") <= F.col("at"), F.col("i") > F.col("at")
    means = {"vx0": side(before, "x", "x0"), "vy0": side(before, "y", "y0"), "vx1": side(after, "x", "x0"), "vy1": side(after, "y", "y0")}
    return places.join(contacts, list(by)).groupBy(*by).agg(*(F.first(c).alias(c) for c in ("points", "contact_t", "distance")), *(v.alias(k) for k, v in means.items()))


def trajectory_signature(points: Column, before: Column, after: Column, ratio: Column, angle: Column) -> Column:
    """What happened at a contact, from the speeds on either side, their ratio and the turn in degrees; the first that holds.

    Under three points, or without motion on either side, nothing can be said; a sharp turn is a parry, a fall in speed
    a catch, a mild turn a deflection, and a ball that goes on as it came was missed.  What is left counts as a deflection.
    """
    return (
        F.when((points < 3) | (F.greatest(before, after) < LEAST_MOTION), "insufficient_data")
        .when(angle >= PARRY_ANGLE, "parry").when(ratio <= CATCH_RATIO, "catch").when(angle >= DEFLECTION_ANGLE, "deflection").when(ratio >= MISSED_RATIO, "missed")
        .otherwise("deflection")
    )


def contact_signatures(balls: DataFrame, keepers: DataFrame, *by: str) -> DataFrame:
    """The signature of each track of ``balls`` (``split_tracks``), with speeds, their ratio and the angle it comes from.

    A ratio is 1 where the ball stood before, an angle 0 where it stood on either side.
    """
    tracks = split_tracks(balls, keepers, *by)
    still = 1e-6
    sped = tracks.withColumn("speed_before", F.hypot("vx0", "vy0")).withColumn("speed_after", F.hypot("vx1", "vy1"))
    moved = (F.col("speed_before") >= still) & (F.col("speed_after") >= still)
    angle = F.when(moved, turn(F.col("vx0"), F.col("vy0"), F.col("vx1"), F.col("vy1"))).otherwise(0.0)
    ratio = F.when(F.col("speed_before") > still, F.col("speed_after") / F.col("speed_before")).otherwise(1.0)
    out = sped.withColumn("speed_ratio", ratio).withColumn("angle", angle)
    signature = trajectory_signature(*(F.col(c) for c in ("points", "speed_before", "speed_after", "speed_ratio", "angle")))
    return out.withColumn("signature", signature).drop("vx0", "vy0", "vx1", "vy1")


def union_box(boxes: DataFrame, *by: str) -> DataFrame:
    """The box around all boxes (x, y, w, h) of a group, and its area."""
    u = boxes.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return u.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def zoom_window(cx: Column, cy: Column, width: int, height: int, zw: int = 640, zh: int = 360) -> Column:
    """A window around a point, moved to lie inside the frame, in whole pixels."""
    x = F.greatest(F.lit(0), F.least(F.lit(width - zw), F.floor(cx * width - zw / 2).cast("int")))
    y = F.greatest(F.lit(0), F.least(F.lit(height - zh), F.floor(cy * height - zh / 2).cast("int")))
    return F.struct(x.alias("x"), y.alias("y"), F.lit(zw).alias("w"), F.lit(zh).alias("h"))


def crop_box(boxes: DataFrame, *by: str, pad: float = 0.1, least: float = 0.05, most: float = 0.9) -> DataFrame:
    """The padded union box of a group, cut to the frame, and whether to crop to it: "cropped", "too_small" or "too_big"."""
    u = union_box(boxes, *by)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    low = lambda c: F.greatest(F.lit(0.0), c)
    high = lambda c: F.least(F.lit(1.0), c)
    p = u.select(*by, low(F.col("x0") - pad * w).alias("x0"), low(F.col("y0") - pad * h).alias("y0"), high(F.col("x1") + pad * w).alias("x1"), high(F.col("y1") + pad * h).alias("y1"))
    p = p.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return p.withColumn("gate", F.when(F.col("area") < least, "too_small").when(F.col("area") > most, "too_big").otherwise("cropped"))


def gated(events: DataFrame, features: DataFrame, gates: dict[str, Column], fail_open: bool = True) -> DataFrame:
    """Events whose type's gate, a condition over ``features``, holds; types without a gate pass.

    Where an event has no row of features (stream_id, seq, ...), or the gate is null on it, it stays if
    ``fail_open``, and goes otherwise.
    """
    seen = events.join(features.withColumn("__seen", F.lit(True)), ["stream_id", "seq"], "left")
    keep = F.lit(True)
    for kind, gate in gates.items():
        keep = F.when(F.col("event_type") == kind, F.coalesce(F.when(F.col("__seen"), gate), F.lit(fail_open))).otherwise(keep)
    return seen.where(keep).select(*events.columns)
