"""Signatures of contacts, each kind from a track made for it."""

from __future__ import annotations

import pytest

from tideline.plans import reels, spatial

#: name: points (t, x, y), keepers (t, x, y), signature
TRACKS = {
    "turned back": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.5, 0.5), (3, 0.3, 0.5)], [(2, 0.52, 0.5)], "parry"),
    "held": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.5, 0.5), (3, 0.51, 0.5), (4, 0.52, 0.5)], [(2, 0.5, 0.5)], "catch"),
    "turned and slowed is a parry first": ([(0, 0.1, 0.5), (1, 0.5, 0.5), (2, 0.49, 0.5)], [(1, 0.5, 0.5)], "parry"),
    "glanced": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.5, 0.5), (3, 0.6, 0.6)], [(2, 0.5, 0.5)], "deflection"),
    "went on": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.5, 0.5), (3, 0.7, 0.5)], [(2, 0.5, 0.5)], "missed"),
    "slowed a little": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.5, 0.5), (3, 0.6, 0.5)], [(2, 0.5, 0.5)], "deflection"),
    "at rest": ([(0, 0.5, 0.5), (1, 0.505, 0.5), (2, 0.51, 0.5)], [(1, 0.5, 0.5)], "insufficient_data"),
    "two points": ([(0, 0.1, 0.5), (1, 0.5, 0.5)], [(1, 0.5, 0.5)], "insufficient_data"),
    "no keeper, split in the middle": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.5, 0.5), (3, 0.3, 0.5), (4, 0.1, 0.5)], [], "parry"),
    "keeper at other times": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.5, 0.5), (3, 0.7, 0.5)], [(2.5, 0.5, 0.5)], "missed"),
    "contact at the last point moves inwards": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.1, 0.5)], [(2, 0.1, 0.5)], "parry"),
    "contact at the first point moves inwards": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.1, 0.5)], [(0, 0.1, 0.5)], "parry"),
    "the nearer of two keepers": ([(0, 0.1, 0.5), (1, 0.3, 0.5), (2, 0.5, 0.5), (3, 0.505, 0.5), (4, 0.51, 0.5)], [(1, 0.9, 0.5), (2, 0.5, 0.52)], "catch"),
    "no time between points": ([(0, 0.1, 0.5), (0, 0.5, 0.5), (0, 0.9, 0.1)], [], "insufficient_data"),
}


@pytest.fixture(scope="module")
def found(spark):
    balls = [(k, i, float(t), x, y) for k, (points, _, _) in TRACKS.items() for i, (t, x, y) in enumerate(points)]
    keepers = [(k, float(t), x, y) for k, (_, seen, _) in TRACKS.items() for t, x, y in seen]
    out = spatial.contact_signatures(spark.createDataFrame(balls, "track string, seq bigint, t double, x double, y double"), spark.createDataFrame(keepers, "track string, t double, x double, y double"), "track")
    return {r["track"]: r for r in out.collect()}


def test_every_track_has_a_row(found):
    assert set(found) == set(TRACKS)


@pytest.mark.parametrize("name", TRACKS)
def test_signature(found, name):
    assert found[name]["signature"] == TRACKS[name][2]


def test_contact(found):
    assert found["the nearer of two keepers"]["contact_t"] == 2.0 and abs(found["the nearer of two keepers"]["distance"] - 0.02) < 1e-9
    assert found["no keeper, split in the middle"]["contact_t"] is None
    assert abs(found["turned back"]["angle"] - 180) < 1e-6 and found["at rest"]["speed_ratio"] == pytest.approx(1.0)


def test_a_parry_lengthens_its_clip(spark):
    rows = spark.createDataFrame([(10.0, 11.0, 100.0, s, "catch", 0.9) for s in ("parry", "catch", None)], "t0 double, t1 double, duration double, signature string, event_type string, confidence double")
    ends = {r["signature"]: r["end"] for r in reels.event_clips(rows).collect()}
    assert ends["parry"] == ends["catch"] + 3.0 == ends[None] + 3.0


def test_names_of_clips(spark):
    rows = spark.createDataFrame([(["missed", "catch"],), (["catch", "parry"],), (["insufficient_data", "missed"],), (["odd"],), ([],)], "s array<string>")
    assert [r[0] for r in rows.select(reels.signature_of(rows["s"])).collect()] == ["catch", "parry", "missed", None, None]
