"""The event log, jobs and other readers on files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tideline import schema
from tideline.plans import jobs, reels
from tideline.sources import events as src


def line(i, kind="goal", t=1.0, **more):
    return json.dumps({"event_id": str(i), "event_type": kind, "timestamp_start": t, "timestamp_end": t + 1, "confidence": 0.9} | more)


def test_log_scan_skips_and_compacts(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join([line(1), "", "not json", line(2, "no_such"), line(1, t=5.0), line(3, review_override=False)]) + "\n")
    log = src.read_log(spark, str(path))
    assert log.count() == 3 and src.line_count(spark, str(path)) == 5 and src.exists(spark, str(path))
    rows = {r["event_id"]: r for r in src.compacted(log).collect()}
    assert rows["1"]["timestamp_start"] == 5.0 and rows["3"]["review_override"] is False and rows["3"]["metadata"] == "{}"


def test_append_clear_and_merge(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    make = lambda i, t: spark.createDataFrame([(str(i), t)], "event_id string, timestamp_start double").withColumn("event_type", F.lit("goal"))
    src.append(make(1, 1.0), a)
    src.append(make(2, 2.0), a)
    src.append(make(2, 9.0), b)
    got = {r["event_id"]: r["timestamp_start"] for r in src.merged([src.read_log(spark, a), src.read_log(spark, b)]).collect()}
    assert got == {"1": 1.0, "2": 9.0}
    src.clear(spark, a)
    assert not src.exists(spark, str(tmp_path / "none")) and spark.read.text(a).count() == 0


def test_calibration_derives_offsets_and_drops(spark):
    games = {"a": {"h1_offset_sec": 10.0, "h2_anchor_video_sec": 4000.0, "h2_anchor_event_ms": 3000000.0}, "b": {"h1_offset_sec": 1.0}, "c": {"error": 1}}
    df = spark.createDataFrame([(json.dumps(games),)], "value string")
    assert [tuple(r) for r in src.calibration(df).collect()] == [("a", 10.0, 1000.0)]


def test_two_layouts_of_detections(spark):
    one = spark.createDataFrame([("goal", 1.0, 3.0, 0.5, '{"vlm_reasoning": "x"}')], "event_type string, timestamp_start double, timestamp_end double, confidence double, metadata string")
    two = spark.createDataFrame([("goal", 1.0, 3.0, 0.5, "x")], "event_type string, start_sec double, end_sec double, confidence double, reasoning string")
    assert src.detections(one).collect() == src.detections(two).collect()


def test_probe(spark):
    probe = {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "r_frame_rate": "30000/1001", "width": 1920, "height": 1080}], "format": {"duration": "12.5", "size": "99"}}
    r = src.probe_row(spark.createDataFrame([(json.dumps(probe),), ('{"streams": []}',)], "value string")).collect()
    assert len(r) == 1 and abs(r[0]["fps"] - 29.97) < 0.01 and r[0]["duration_sec"] == 12.5 and r[0]["size_bytes"] == 99


def test_files_and_content(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [r["size_bytes"] for r in src.files(spark, str(tmp_path)).collect()] == [1]
    assert len({r["sha256"] for r in src.content_ids(spark, str(tmp_path)).collect()}) == 1


def test_ids_of_files_of_any_size(spark, tmp_path):
    """One beyond what a cell can hold, one of a whole number of pieces, one empty, and one with an odd name."""
    import hashlib

    made = {"big.mp4": 2**31 + 10, "pieces.mp4": 2 * src.PIECE, "empty.mp4": 0, "odd name %20 é.mp4": 3}
    for name, n in made.items():
        with open(tmp_path / name, "wb") as f:
            f.truncate(n)
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in src.content_ids(spark, str(tmp_path)).collect()}
    for name in set(made) - {"empty.mp4"}:
        with open(tmp_path / name, "rb") as f:
            assert got.pop(name) == hashlib.file_digest(f, "sha256").hexdigest()
    assert not got


def test_job_rows(spark):
    assert jobs.by_status(spark.createDataFrame([("failed",)], "status string")).where("jobs = 0").count() == len(schema.JOB_STATUS) - 1
    p = spark.createDataFrame([("j", i, v) for i, v in enumerate([0.0, 5.0, 5.0, 5.05, 9.0])], "job_id string, tick int, pct double")
    assert [r["tick"] for r in jobs.stalled(p).collect()] == [3]
    s = spark.createDataFrame([("h", 1, "a", "failed"), ("h", 2, "b", "complete"), ("g", 3, "c", "failed")], "sha256 string, seq int, job_id string, status string")
    assert {r["sha256"]: (r["job_id"], r["requeue"]) for r in jobs.idempotent(s).collect()} == {"h": ("b", False), "g": ("c", True)}


def test_plugins():
    registry = reels.PluginRegistry.from_names()
    assert registry.reels == ["keeper", "highlights"] and len(registry.of_reel("keeper")) == 5
    with pytest.raises(ValueError):
        registry.register(reels.BUILT_IN["keeper_saves"]())
    with pytest.raises(KeyError):
        reels.PluginRegistry.from_names(["nope"])
    with pytest.raises(ValueError):
        reels.ClipParams(max_clip=0)


def test_keeper_plugin_gates(spark):
    ddl = "stream_id string, seq bigint, t double, event_type string, confidence double, is_goalkeeper_event boolean, similarity double, review_override boolean, x double"
    rows = [("s", 0, 10.0, "catch", 0.9, True, 0.6, None, 0.1), ("s", 1, 20.0, "catch", 0.9, True, 0.5, None, 0.1), ("s", 2, 30.0, "catch", 0.1, True, 0.9, None, 0.1), ("s", 3, 40.0, "catch", 0.1, True, 0.9, True, None), ("s", 4, 50.0, "catch", 0.9, True, 0.9, None, 0.9), ("s", 5, 60.0, "catch", 0.9, True, 0.9, None, 0.5)]
    got = reels.BUILT_IN["keeper_saves"]().select(spark.createDataFrame(rows, ddl), reels.Context())
    # a single voter settles no side, so only the gates and midfield decide
    assert sorted(r["seq"] for r in got.collect()) == [0, 3, 4]
    more = [("s", 6, 60.0, "catch", 0.9, True, 0.9, None, 0.1), ("s", 7, 61.0, "catch", 0.9, True, 0.9, None, 0.2), ("s", 8, 62.0, "goal_kick", 0.9, True, 0.9, None, 0.9)]
    both = spark.createDataFrame(rows + more, ddl)
    assert sorted(r["seq"] for r in reels.BUILT_IN["keeper_saves"]().select(both, reels.Context()).collect()) == [0, 3, 6, 7]
    assert [r["seq"] for r in reels.BUILT_IN["keeper_goal_kick"]().select(both, reels.Context()).collect()] == [8]
