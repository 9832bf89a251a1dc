"""Two-level scans against plain loops, and their plans."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.operators import folds
from tideline.operators import timeline as tm
from tideline.plans import routing, signals

SCHEMA = "stream_id string, seq bigint, t double, v double"


def rows(n, seed=3, span=20000.0):
    """Streams with ties in time and long empty stretches; one holds most rows, one has no name."""
    rng = random.Random(seed)
    out = [(rng.choice(["a", "a", "a", "b", None]), i, round(rng.choice([0.0, span / 2]) + rng.random() * span / 8, 1), float(rng.randrange(-8, 9))) for i in range(n)]
    return out + [("lonely", n, 5.0, 1.0), ("far", n + 1, -3000.0, 2.0), ("far", n + 2, 90000.0, 3.0)]


def streams(data):
    found = {}
    for r in sorted(data, key=lambda r: (r[2], r[1])):
        found.setdefault(r[0], []).append(r)
    return found


def test_scan_equals_a_loop(spark):
    data = rows(400)
    got = tm.scan(spark.createDataFrame(data, SCHEMA), before={"p": F.col("v")}, after={"n": F.col("t")}, highest={"h": F.col("v")}, summed={"s": F.col("v")})
    want = {}
    for held in streams(data).values():
        for i, r in enumerate(held):
            past = [x[3] for x in held[:i]]
            want[r[1]] = (past[-1] if past else None, held[i + 1][2] if i + 1 < len(held) else None, max(past, default=None), sum(past))
    assert {r["seq"]: (r["p"], r["n"], r["h"], r["s"]) for r in got.collect()} == want


def test_scan_takes_nulls_for_values(spark):
    data = [("s", 0, 0.0, 1.0), ("s", 1, 1000.0, None), ("s", 2, 2000.0, 3.0)]
    got = tm.scan(spark.createDataFrame(data, SCHEMA), before={"p": F.col("v")}, highest={"h": F.col("v")}, summed={"s": F.col("v")}).orderBy("seq").collect()
    assert [(r["p"], r["h"], r["s"]) for r in got] == [(None, None, 0.0), (1.0, 1.0, 1.0), (None, 1.0, 1.0)]


def test_scan_of_nothing(spark):
    assert tm.scan(spark.createDataFrame([], SCHEMA), before={"p": F.col("v")}, summed={"s": F.lit(1)}).count() == 0


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_frames_across_blocks(spark, size):
    data, half = rows(300, 5), 3
    dealt, block = tm.in_blocks(spark.createDataFrame(data, SCHEMA), half, ("stream_id",), size)
    got = tm.own(dealt.withColumn("m", F.sum("v").over(block.rowsBetween(-half, half)))).collect()
    want = {r[1]: sum(x[3] for x in held[max(0, i - half) : i + half + 1]) for held in streams(data).values() for i, r in enumerate(held)}
    assert {r["seq"]: r["m"] for r in got} == want and len(got) == len(data)


def test_numbers_of_streams_without_a_name(spark):
    data = rows(300, 9)
    want = {}
    for held in streams(data).values():
        n = 0
        for i, r in enumerate(held):
            n += i > 0 and r[2] - held[i - 1][2] > 4.0
            want[r[1]] = n
    got = tm.sessions(spark.createDataFrame(data, SCHEMA), 4.0)
    assert {r["seq"]: r["session"] for r in got.collect()} == want


def test_interval_chunks_equal_a_loop(spark):
    rng = random.Random(2)
    data = [(s, i, start, start + rng.choice([0.5, 2.0, 1500.0 if i % 40 == 0 else 1.0])) for s in ("a", "b") for i, start in enumerate(sorted(round(rng.random() * 9000, 1) for _ in range(150)))]
    got = folds.interval_chunks(spark.createDataFrame(data, "stream_id string, seq bigint, start double, end double"), 20.0)
    want = {}
    for s in ("a", "b"):
        until, n = None, 0
        for _, i, start, end in (r for r in data if r[0] == s):
            n += until is not None and start > until + 20.0
            until = end if until is None else max(until, end)
            want[s, i] = n
    assert {(r["stream_id"], r["seq"]): r["chunk"] for r in got.collect()} == want


def test_first_rows_are_the_first_of_all_parts(spark):
    data = rows(300, 4)
    got = tm.first_rows(spark.createDataFrame(data, SCHEMA), 5, ("stream_id",), (F.desc("v"), F.col("seq")), tm.stretch_of("t"), "r")
    want = {(r[1], i + 1) for held in streams(data).values() for i, r in enumerate(sorted(held, key=lambda r: (-r[3], r[1]))[:5])}
    assert {(r["seq"], r["r"]) for r in got.collect()} == want


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_ranked_values(spark, p):
    rng = random.Random(8)
    held = {"outlier": [*(rng.random() for _ in range(3000)), 1e12, -1e9], "ties": [0.5] * 2000 + [0.25, 0.75], "one": [3.0], "two": [2.0, 1.0]}
    df = spark.createDataFrame([(s, x) for s, xs in held.items() for x in [*xs, None]], "stream_id string, v double")
    # few values make the sketch coarse: the part that holds the rank need not be the middle one
    for accuracy in (10, 10_000):
        got = {r["stream_id"]: r["x"] for r in routing.ranked_value(df, "v", p, name="x", accuracy=accuracy).collect()}
        assert got == {s: sorted(xs)[min(int(len(xs) * p), len(xs) - 1)] for s, xs in held.items()}


SPANS = "stream_id string, seq bigint, start double, end double, score double"
PLANS = {
    "sessions": lambda d, s: tm.sessions(d, 4.0),
    "islands": lambda d, s: tm.islands(d, F.col("v") > 0),
    "runs_above": lambda d, s: tm.runs_above(d, F.col("v"), F.lit(1.0)),
    "gaps": lambda d, s: tm.gaps(d),
    "rolling": lambda d, s: tm.rolling(d, "v", 3),
    "rolling_padded": lambda d, s: tm.rolling_padded(d, "v", 3),
    "adaptive": lambda d, s: signals.adaptive(d, "v", 3),
    "active_runs": lambda d, s: signals.active_runs(d.select("stream_id", "seq", "t", (F.col("v") > 0).alias("active"), F.col("v").alias("amplitude")), 1.0, True),
    "dead_runs": lambda d, s: signals.dead_runs(d.withColumn("dead", F.col("v") < 0), 1),
    "interval_chunks": lambda d, s: folds.interval_chunks(s, 4.0),
    "budget_prune": lambda d, s: folds.budget_prune(s, 4.0),
    "greedy_match": lambda d, s: folds.greedy_match(d, d, 4.0),
}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_no_window_over_the_rows_of_a_stream(spark, name, capsys):
    """Windows go by stream and stretch, but for those over the rows that stretches hand on."""
    d = spark.createDataFrame(rows(20), SCHEMA)
    s = spark.createDataFrame([("a", 0, 0.0, 1.0, 0.5)], SPANS)
    PLANS[name](d, s).explain()
    said = capsys.readouterr().out
    # keys of windows over handed rows are fields of the struct of a stretch, so they have no column's name
    assert "Window" in said and not re.search(r"windowspecdefinition\(stream_id#\d+L?, (?!__bl_b)", said)
    assert "NestedLoop" not in said and "Cartesian" not in said
