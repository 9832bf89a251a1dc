"""Job log, clocks, sinks and settings against plain versions and on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tideline import config, sinks
from tideline.functions import answers
from tideline.plans import clock, evaluate, jobs, records, summaries
from tideline.queries import store
from tideline.sources import truths

SMALL = "/root/testdata/sf0.001"


def job_rows(spark, *rows):
    return spark.createDataFrame([(i, k, None, a, s, p, e, m) for i, k, a, s, p, e, m in rows], "job_id string, seq bigint, at timestamp, action string, new_status string, new_progress double, new_error string, new_paths map<string,string>")


def test_job_log(spark):
    log = jobs.created(spark.createDataFrame([("../a/b", 0), ("c", 1)], "job_id string, seq bigint").withColumn("created_at", F.lit("2026-01-01").cast("timestamp") + F.make_interval(days=F.col("seq").cast("int"))))
    assert [r["job_id"] for r in jobs.newest_first(log).collect()] == ["c", "ab"]
    step = lambda *rows: jobs.with_updates(log, job_rows(spark, *rows))
    log = log.unionByName(step(("ab", 2, "status", "failed", 30.0, "broken", {"x": "1"}), ("nobody", 3, "pause", None, None, None, None)))
    now = jobs.one(log, "../a/b").first()
    assert (now["status"], now["progress"], now["error"], now["output_paths"]) == ("failed", 30.0, "broken", {"x": "1"})
    log = log.unionByName(step(("ab", 4, "pause", None, None, None, None)))
    assert jobs.one(log, "ab").first()["pause_requested"] and jobs.one(log, "ab").first()["error"] == "broken"
    log = log.unionByName(step(("ab", 5, "status", "pending", None, None, {"x": "2", "y": "3"})))
    now = jobs.one(log, "ab").first()
    assert not now["pause_requested"] and now["error"] is None and now["progress"] == 30.0 and now["output_paths"] == {"x": "2", "y": "3"}
    log = log.unionByName(step(("ab", 6, "delete", None, None, None, None)))
    assert jobs.one(log, "ab").count() == 0 and jobs.current(log).count() == 1 and jobs.one(log, "nobody").count() == 0


def plain_search(want, found, weights, half2, tol, offsets, breaks):
    best = None
    for o in offsets:
        for b in breaks:
            h2, score, ssr, n = o + half2 + b, 0.0, 0.0, 0
            for s, half, t in want:
                at = t + o if half == 0 else t - half2 + h2
                near = min((abs(x - at) for k, x in found if k == s), default=1e9)
                if near <= tol:
                    score, ssr, n = score + weights[s], ssr + near * near, n + 1
            key = (score, -int(ssr * 1000 // 1), -o, -h2)
            if n and (best is None or key > best[0]):
                best = (key, (o, h2, score, n))
    return best[1]


def test_clock_search_equals_plain(spark):
    want, found = store.clock_sides(spark, SMALL)
    weights, coarse, fine = {"goal": 10.0, "shot": 1.0}, ((0.0, 100.0, 20.0), (300.0, 800.0, 100.0)), ((20.0, 5.0), (40.0, 10.0))
    got = {r["stream_id"]: tuple(r)[1:] for r in clock.search(want, found, weights, tolerance=5.0, coarse=coarse, fine=fine).collect()}
    sides = {}
    for r in want.collect():
        sides.setdefault(r["stream_id"], ([], []))[0].append((r["signal"], r["half"], r["t"]))
    for r in found.collect():
        sides.setdefault(r["stream_id"], ([], []))[1].append((r["signal"], r["t"]))
    checked = 0
    for stream, (w, f) in sides.items():
        if stream in got and w and f:
            o, h2, score, _ = plain_search(w, f, weights, 2700.0, 5.0, clock.grid(*coarse[0]), clock.grid(*coarse[1]))
            c = h2 - o - 2700
            low, low2 = max(0.0, o - 20), max(300.0, c - 40)
            offsets = [x for x in (low + 5 * k for k in range(9)) if x <= o + 20]
            breaks = [x for x in (low2 + 10 * k for k in range(9)) if x <= c + 40]
            assert got[stream][2] >= score
            assert got[stream][2:] == plain_search(w, f, weights, 2700.0, 5.0, offsets, breaks)[2:]
            checked += 1
    assert checked


def test_manifest_and_tags(spark, tmp_path):
    j = spark.createDataFrame([("j", "v.mp4", 90.0, ["keeper", "goals"], {"keeper": "k.mp4"})], "job_id string, source_file string, duration_sec double, reels array<string>, output_paths map<string,string>")
    e = spark.createDataFrame([("j", "b", "goal", 9.0, 12.0, 0.5, ["keeper"]), ("j", "a", "catch", 1.0, 3.0, 0.9, ["keeper", "other"])], "job_id string, event_id string, event_type string, timestamp_start double, timestamp_end double, confidence double, reel_targets array<string>")
    c = spark.createDataFrame([("j", "keeper", 1.004, 12.0, "goal", None, [1, 2])], "job_id string, reel string, start double, end double, event_type string, signature string, members array<bigint>")
    m = json.loads(sinks.manifest(j, e, c).first()["manifest"])
    assert [x["event_id"] for x in m["events_by_reel"]["keeper"]] == ["a", "b"] and m["events_by_reel"]["goals"] == [] and m["clips_by_reel"]["goals"] == []
    assert m["clips_by_reel"]["keeper"][0]["duration_sec"] == 11.0 and m["clips_by_reel"]["keeper"][0]["event_count"] == 2 and m["total_events"] == 2 and m["reels"] == {"keeper": "k.mp4"}
    line = sinks.tag_line(F.col("event_type"), F.col("timestamp_start"), F.col("timestamp_end"), F.lit(None).cast("string"), F.col("confidence"), F.lit(True), F.col("event_type") == "goal")
    sinks.tags(e.withColumn("line", line), str(tmp_path / "tags"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "tags")).collect()] == ["catch — 00:01.00 → 00:03.00 — team=unknown conf=0.90 [GK]", "goal — 00:09.00 → 00:12.00 — team=unknown conf=0.50 [GK] [INF]"]


def test_other_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "event_type string, n int")
    for _ in range(2):
        sinks.diagnostics({"shots": rows, "corners": rows.limit(0)}, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/shots")).count() == 1
    sinks.evaluation(rows, rows.agg(F.sum("n").alias("n")), str(tmp_path / "e"))
    doc = spark.read.json(str(tmp_path / "e")).first()
    assert doc["totals"]["n"] == 1 and doc["per_type"][0]["event_type"] == "a"
    samples = spark.createDataFrame([("g1", "goal", 5, 1, 0.0, 20.0, 10.0, [str(i) for i in range(9)], "none"), ("g2", "none", 6, 1, 0.0, 20.0, 10.0, [str(i) for i in range(9)], "none"), ("g1", "none", 7, 1, 0.0, 20.0, 10.0, ["x"], "none")],
                                    "game string, label string, ms bigint, half int, window_start double, window_end double, t double, frames array<string>, augmentation string")
    r = records.records(records.mirrored(samples), records.window_query("%.0f s?"), records.class_response({}))
    r = records.split(r.withColumn("game", F.col("_meta.game")), F.col("_meta.event_time_ms"), ["g2"], 0).drop("game")
    counts = {(x["split"], x["label"]): x["records"] for x in sinks.training(r, str(tmp_path / "t")).collect()}
    assert counts == {("train", "goal"): 2, ("holdout", "none"): 1}
    back = truths.labelled_records(spark.read.text(str(tmp_path / "t/split=train")).unionByName(spark.createDataFrame([('{"x": 1}',), ("broken",)], "value string")))
    assert sorted(x["label"] for x in back.collect()) == ["goal", "goal", "none"]
    assert records.capped(samples.withColumn("id", F.col("ms")), F.col("id"), {"none": 1}).groupBy("label").count().where("label = 'none'").first()["count"] == 1


def test_chat_form(spark):
    w = spark.createDataFrame([("g", "val", 3, 0.0, 15.0, ["a", "b"], [0.5, None], [("goal", 1.0)])], "game string, split string, window_no int, window_start double, window_end double, frames array<string>, times array<double>, target array<struct<event:string,start:double>>")
    r = records.chat_form(w, "%d frames, %.1f to %.1f", "/root/").first()
    assert r["query"] == "<image>t=0.5s\n<image>\n\n2 frames, 0.0 to 15.0" and json.loads(r["response"]) == [{"event": "goal", "start": 1.0}] and r["images"] == ["/root/a", "/root/b"] and r["_meta"]["n_gt_events_in_window"] == 1


def test_settings_and_teams(spark, tmp_path, monkeypatch):
    assert config.number(spark, "MIN_EVENT_CONFIDENCE") == 0.65 and config.setting(spark, "NOBODY_SET_THIS") is None
    spark.conf.set("tideline.min_event_confidence", "0.7")
    assert config.number(spark, "MIN_EVENT_CONFIDENCE") == 0.7
    monkeypatch.setenv("MIN_EVENT_CONFIDENCE", "0.8")
    assert dict(map(tuple, config.settings(spark).collect()))["MIN_EVENT_CONFIDENCE"] == "0.8"
    spark.conf.unset("tideline.min_event_confidence")
    for name, text in (("a", '{"team_name": "Ours", "kits": {"Home": {"outfield_color": "navy", "gk_color": "teal"}}}'), ("b", "{}"), ("c", "{broken")):
        (tmp_path / f"{name}.json").write_text(text)
    t = config.teams(spark, str(tmp_path))
    assert [r["team_name"] for r in t.collect()] == ["Ours"]
    kit = summaries.match_kits(t).first()
    assert kit["outfield_color"] == "navy" and kit["opponent_gk_color"] == "neon_yellow" and summaries.match_kits(t, "Away").count() == 0


def test_games_of_files(spark):
    f = spark.createDataFrame([("/g/one/a.mp4",), ("/g/one/b.JSON",), ("/g/two/a.mp4",), ("/g/three/x.json",)], "path string")
    assert [(r["game"], r["videos"], r["exports"]) for r in truths.games_of(f).collect()] == [("one", ["/g/one/a.mp4"], ["/g/one/b.JSON"])]


def test_manual_anchors_win(spark):
    rows = spark.createDataFrame([("g", 10.0, 20.0, 5000, 6000), ("h", 1.0, 2.0, 0, 0)], "game string, h1_offset_sec double, h2_offset_sec double, h1_anchor_event_ms bigint, h2_anchor_event_ms bigint")
    manual = spark.createDataFrame([("g", 30.0, None)], "game string, h1_anchor_video_sec double, h2_anchor_video_sec double")
    assert sorted(tuple(r)[:3] for r in truths.overridden(rows, manual).collect()) == [("g", 25.0, 20.0), ("h", 1.0, 2.0)]


@pytest.mark.parametrize("answer, want", [('{"is_goal": true, "confidence": 0.9, "reasoning": "r"}', (True, 0.9, "r")), ("so: {\"is_goal\": false}", (False, 0.5, "")), ("none", (False, 0.0, "parse error")), (None, (False, 0.0, "no answer"))])
def test_goal_check(spark, answer, want):
    assert tuple(spark.createDataFrame([(answer,)], "a string").select(answers.goal_check(F.col("a")).alias("x")).first()["x"]) == want


def test_flags(spark):
    said = ['{"flag": true, "reason": "x"}', '```json\n{"flag": false}\n```', 'well "flag": true I say', "?"]
    out = [tuple(r["x"]) for r in spark.createDataFrame([(s,) for s in said], "a string").select(answers.flag(F.col("a")).alias("x")).collect()]
    assert out == [(True, "x"), (False, ""), (True, 'well "flag": true I say'), (False, "PARSE_ERROR: ?")]


def test_spread(spark):
    swept = spark.createDataFrame([("a", 0.3, 0.5), ("a", 0.9, 0.75), ("b", 0.3, 0.5)], "event_type string, threshold double, precision double")
    assert {r["event_type"]: r["spread"] for r in evaluate.spread(swept).collect()} == {"a": 0.25, "b": None}


def test_merged_cues(spark):
    from tideline.plans import signals

    ddl = "stream_id string, seq bigint, t double, length double, peak double"
    w = spark.createDataFrame([("s", 1, 10.0, 1.0, 0.5), ("s", 2, 12.0, 2.0, 0.6), ("s", 3, 50.0, 1.0, 0.1)], ddl)
    e = spark.createDataFrame([("s", 1, 9.0, 4.0, 0.4), ("s", 2, 12.5, 0.5, 0.9), ("s", 3, 90.0, 1.0, 1.0)], ddl)
    got = sorted(tuple(r)[1:] for r in signals.merged_cues(w, e).collect())
    assert got == [(9.0, "whistle_and_surge", 4.0, 0.5), (12.0, "whistle_and_surge", 2.0, 0.9), (50.0, "whistle", 1.0, 0.1), (90.0, "energy_surge", 1.0, 1.0)]


def test_cache_keys(spark, tmp_path):
    import hashlib

    from tideline.sources import events as src

    data = bytes(range(256)) * 5000
    (tmp_path / "a.mp4").write_bytes(data)
    want = hashlib.sha1(str(tmp_path / "a.mp4").encode() + str(len(data)).encode() + data[: 1 << 20]).hexdigest()[:16]
    assert src.cache_keys(spark, str(tmp_path)).first()["key"] == want
