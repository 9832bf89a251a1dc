"""Splitting windows at their largest gaps, against the recursion done one window at a time."""

from __future__ import annotations

import random

import pytest

from tideline.plans.signals import _cuts, flag_windows


def plain(flags, gap, pad, most):
    flags = sorted(flags)
    groups = [[flags[0]]]
    for f in flags[1:]:
        last = groups[-1][-1]
        if f[3] - last[4] > gap or f[2] != last[2]:
            groups.append([f])
        else:
            groups[-1].append(f)
    out, stack = [], groups
    while stack:
        g = stack.pop()
        a, b = max(0.0, g[0][3] - pad), g[-1][4] + pad
        if len(g) == 1 or b - a <= most:
            out.append((a, b, len(g)))
            continue
        i = max(range(1, len(g)), key=lambda i: (g[i][3] - g[i - 1][4], -i))
        stack += [g[:i], g[i:]]
    return sorted(out)


def made(rng, n, kind):
    t, out = 0.0, []
    for i in range(n):
        t += {"even": 2.0, "random": rng.choice([0.0, 0.5, 1.0, 3.0, 4.5]), "rising": 0.01 * i, "falling": 0.01 * (n - i), "same": 0.0}[kind]
        out.append((t, i, "z" if rng.random() < 0.98 else "y", t - 1, t + 1))
    return out


@pytest.mark.parametrize("kind", ["even", "random", "rising", "falling", "same"])
def test_windows_equal_the_recursion(spark, kind):
    rng = random.Random(kind)
    flags = made(rng, 400, kind)
    df = spark.createDataFrame([("s", t, i, "x", z, a, b) for t, i, z, a, b in flags], "stream_id string, t double, seq bigint, label string, zone string, start double, end double")
    got = sorted((round(r["start"], 6), round(r["end"], 6), r["n_flags"]) for r in flag_windows(df, 4.0, 3.0, 30.0).collect())
    assert got == sorted((round(a, 6), round(b, 6), n) for a, b, n in plain(flags, 4.0, 3.0, 30.0))


def test_a_long_even_stretch_in_linear_time():
    import numpy as np

    start = np.arange(200_000) * 2.0
    cuts = _cuts(start, start + 2, np.zeros(200_000, np.int64), 3.0, 60.0)
    assert not cuts[0] and cuts[1 : -40].all() and not cuts[-20:].any()


def test_points_and_nothing(spark):
    ddl = "stream_id string, t double, seq bigint, label string, zone string"
    got = flag_windows(spark.createDataFrame([("s", 1.0, 1, "b", None), ("s", 3.0, 2, "a", None), ("r", 3.0, 3, None, "z")], ddl), 4.0, 3.0, 60.0).collect()
    assert sorted((r["stream_id"], r["start"], r["end"], r["labels"], r["n_flags"]) for r in got) == [("r", 0.0, 6.0, [], 1), ("s", 0.0, 6.0, ["a", "b"], 2)]
    assert flag_windows(spark.createDataFrame([], ddl), 4.0, 3.0, 60.0).count() == 0
