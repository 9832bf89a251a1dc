"""Folder source, guards, merged upserts, outer joins and jobs online; each over a restart."""

from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tideline.plans import rules
from tideline.sources.events import compacted
from tideline.streaming import events as st
from tideline.streaming import folder, guard, jobs, upserts


def wait(done, sec: float = 60.0) -> None:
    end = time.time() + sec
    while not done():
        assert time.time() < end, "nothing came"
        time.sleep(0.2)


def poll(stream, tmp_path, name: str = "files"):
    """One trigger: what lies there is looked at once, by a query that starts from the checkpoint."""
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def put(path, n: int) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"x" * n)


def failing_once(folder_: str):
    """A callback that writes down its calls and fails on the first of each path named bad."""
    def call(path: str, size: int) -> None:
        seen = f"{folder_}/{os.path.basename(path)}"
        with open(seen, "a") as f:
            f.write(f"{size}\n")
        if "bad" in path and len(open(seen).readlines()) == 1:
            raise OSError("busy")

    return call


def test_folder_of_growing_files_over_restarts(spark, tmp_path):
    src, calls = tmp_path / "in", tmp_path / "calls"
    calls.mkdir()
    stream = lambda: folder.stable_files(folder.listing(spark, str(src)), stable_sec=0.3, idle_sec=600, retry_sec=600, callback=failing_once(str(calls)))
    out = lambda: sorted((os.path.basename(r["path"]), r["size"], r["error"] or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    poll(stream(), tmp_path)  # the folder is not there yet
    put(src / "a.mp4", 5), put(src / "sub" / "deep" / "b.mp4", 7), put(src / "note.txt", 1), put(src / "bad.mp4", 3)
    poll(stream(), tmp_path)
    time.sleep(0.5)
    put(src / "sub" / "deep" / "b.mp4", 9)  # grows: its clock starts anew
    poll(stream(), tmp_path)
    assert out() == [("a.mp4", 5, ""), ("bad.mp4", 3, "OSError: busy")]
    time.sleep(0.5)
    poll(stream(), tmp_path)
    assert out() == [("a.mp4", 5, ""), ("b.mp4", 9, ""), ("bad.mp4", 3, ""), ("bad.mp4", 3, "OSError: busy")]
    poll(stream(), tmp_path)
    assert len(out()) == 4 and (calls / "a.mp4").read_text() == "5\n" and (calls / "bad.mp4").read_text() == "3\n3\n"


def test_a_timer_retries_without_news_of_the_file(spark, tmp_path):
    """The second poll settles the file and the callback fails; the file is not listed again, but the timer calls again."""
    calls, src = tmp_path / "calls", str(tmp_path / "polls")
    calls.mkdir()
    ddl = "path string, size bigint, seen double"
    now = time.time()
    spark.createDataFrame([("bad", 3, now - 2), ("bad", 3, now)], ddl).coalesce(1).write.parquet(src)
    stream = folder.stable_files(spark.readStream.schema(ddl).parquet(src), stable_sec=1, idle_sec=600, retry_sec=1, callback=failing_once(str(calls)))
    q = stream.writeStream.format("memory").queryName("retried").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        wait(lambda: spark.table("retried").count() == 2)
    finally:
        q.stop()
    assert [r["error"] for r in spark.table("retried").collect()] == ["OSError: busy", None]


def windows(spark, tmp_path, name, labels):
    src = str(tmp_path / name)
    for i in range(0, len(labels), 5):
        spark.createDataFrame([(f"w{i + k}", x) for k, x in enumerate(labels[i : i + 5])], "stream_id string, label string").coalesce(1).write.mode("append").parquet(src)
    df = spark.readStream.schema("stream_id string, label string").option("maxFilesPerTrigger", 1).parquet(src)
    return st.alarms(df, "canary").writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()


def test_a_dead_run_is_stopped_and_a_good_one_goes_on(spark, tmp_path):
    judge = guard.Guard(spark, windows=10).watch()
    try:
        dead = windows(spark, tmp_path, "dead", ["DEAD"] * 30)
        good = windows(spark, tmp_path, "good", ["DEAD", "PLAY", "GOAL"] * 10)
        wait(lambda: not dead.isActive)
        good.processAllAvailable()
        wait(lambda: str(good.runId) in judge.verdicts)
        assert good.isActive
        good.stop()
        a, b = judge.verdicts[str(dead.runId)], judge.verdicts[str(good.runId)]
        assert a.stopped and "0 of 10" in a.why and a.totals.windows == 10
        assert b.why is None and not b.stopped and b.totals.windows == 10
    finally:
        judge.leave()


def test_rules_of_the_guard():
    assert guard.hopeless(guard.Totals(20, 19, 2)) is None
    assert "1 of 21" in guard.hopeless(guard.Totals(21, 20, 2))
    assert "one label" in guard.hopeless(guard.Totals(20, 0, 1))


def test_fifty_batches_two_restarts_one_table(spark, tmp_path):
    rng = random.Random(3)
    ddl = "event_id string, confidence double, _seq bigint"
    rows = [[(f"e{rng.randrange(60)}", rng.random(), 100 * b + i) for i in range(6)] for b in range(50)]
    src, path = str(tmp_path / "in"), str(tmp_path / "table")
    for b, part in enumerate(rows):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(src)
    for stop in (17, 31, 50):
        table = upserts.UpsertTable(spark, path, ddl, fan=4)
        df = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)

        def sink(batch, number, table=table, stop=stop):
            if number >= stop:
                raise RuntimeError("lost")
            table.write(batch, number)

        q = df.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "lost" in str(e)
        q.stop()
    want = compacted(spark.createDataFrame([r for part in rows for r in part], ddl), "event_id", "_seq").select("event_id", "confidence", "_seq")
    assert sorted(table.rows().select(*want.columns).collect()) == sorted(want.collect())
    live = table.folders()
    assert sorted((x["first"], x["last"]) for x in live)[0][0] == 0 and sum(x["last"] - x["first"] + 1 for x in live) == 50
    assert max(sum(x["level"] == k for x in live) for k in range(4)) < 4 and len(live) <= 6
    one = want.first()["event_id"]
    assert table.of(one).select(*want.columns).collect() == want.where(F.col("event_id") == one).collect()
    # a batch that comes again, before or after its merge, changes nothing
    before = sorted(table.rows().collect())
    table.write(spark.createDataFrame([("e1", 9.0, 10**9)], ddl), 3)
    assert sorted(table.rows().collect()) == before


def test_a_reader_sees_old_or_new(spark, tmp_path):
    ddl = "event_id string, confidence double, _seq bigint"
    table = upserts.UpsertTable(spark, str(tmp_path / "t"), ddl, fan=2)
    assert table.rows().count() == 0
    table.write(spark.createDataFrame([("a", 0.1, 1), ("b", 0.2, 2)], ddl), 0)
    old = table.rows()
    # a merge that died before its list was written leaves folders that no reader looks at
    table._put(spark.createDataFrame([("a", 0.9, 9)], ddl), "level1-0-1")
    assert sorted(r["confidence"] for r in table.rows().collect()) == [0.1, 0.2]
    table.write(spark.createDataFrame([("a", 0.3, 3)], ddl), 1)
    assert [x["name"] for x in table.folders()] == ["level1-0-1"]
    assert sorted(r["confidence"] for r in table.rows().collect()) == [0.2, 0.3]
    assert sorted(r["confidence"] for r in old.collect()) == [0.1, 0.2]
    assert all(json.loads((tmp_path / "t" / "_lists" / v).read_text()) for v in table._versions())


EVENT = "stream_id string, seq bigint, ts timestamp, t double, event_type string, confidence double"


def feed(spark, path, rows):
    df = spark.createDataFrame([(s, i, float(t), k, 0.8) for s, i, t, k in rows], "stream_id string, seq bigint, t double, event_type string, confidence double")
    df.withColumn("ts", F.timestamp_seconds(F.col("t"))).select("stream_id", "seq", "ts", "t", "event_type", "confidence").coalesce(1).write.mode("append").parquet(path)


def collected(spark, fn, src, tmp_path):
    """Rows of a query that is stopped and started again after each file."""
    for _ in range(2):
        q = fn(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "jck")).start()
        q.processAllAvailable()
        q.stop()
        yield spark.read.parquet(str(tmp_path / "rows"))
        feed(spark, src, [("end", 10**6 + i, 10**6, k) for i, k in enumerate(("shot_on_target", "goal", "shot", "kickoff"))])


@pytest.mark.parametrize("seed", [1, 2])
def test_caught_shots_equal_the_batch_rule(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = ["shot_on_target"] * 5 + ["catch", "punch", "goal", "corner_kick", "kickoff", "goal_kick", "shot_off_target"]
    rows = sorted(((f"s{rng.randrange(2)}", i, 1000 + rng.randrange(0, 40_000) / 10, rng.choice(kinds)) for i in range(160)), key=lambda r: r[2])
    src = str(tmp_path / "in")
    feed(spark, src, rows)
    verdicts = spark.createDataFrame([(s, i, float(t), "confirmed", k, 0.8, "") for s, i, t, k in rows], "stream_id string, seq bigint, t double, result string, event_type string, confidence double, reasoning string")
    shots = {r[1] for r in rows if r[3] == "shot_on_target"}
    want = {r["seq"] for r in rules.catch_rule(rules.narrow(verdicts)).where("event_type = 'catch'").collect()} & shots
    *_, out = collected(spark, st.caught, src, tmp_path)
    got = out.collect()
    assert want and len(got) == len(want) and {r["seq"] for r in got} == want
    assert {(r["event_type"], round(r["confidence"], 6)) for r in got} == {("catch", 0.68)}


def test_shots_with_and_without_kickoffs(spark, tmp_path):
    src = str(tmp_path / "in")
    feed(spark, src, [("s", 1, 1000, "shot"), ("s", 2, 1050, "kickoff"), ("s", 3, 1060, "kickoff"), ("s", 4, 1100, "shot"), ("s", 5, 1190, "kickoff"), ("r", 6, 1120, "kickoff"), ("s", 7, 1195, "shot")])
    join = lambda d: st.shots_and_kickoffs(d.where("event_type = 'shot'"), d.where("event_type = 'kickoff'"))
    first, last = collected(spark, join, src, tmp_path)
    assert sorted((r["seq"], r["kickoff_seq"] or 0) for r in last.collect()) == [(1, 2), (1, 3), (4, 0), (7, 0)]


def run_batches(spark, fn, ddl, batches, tmp_path, keep=None):
    """Each batch is read by a query that starts from the checkpoint."""
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        poll(fn(spark.readStream.schema(ddl).parquet(src)), tmp_path)
    return spark.read.parquet(str(tmp_path / "out"))


def test_one_job_a_content(spark, tmp_path):
    batches = [
        [("h1", 1, "j1", "submitted"), ("h1", 2, "j2", "submitted"), ("h2", 3, "j3", "submitted")],
        [("h1", 4, "j1", "failed"), ("h1", 5, "j9", "complete"), ("h2", 6, "j3", "complete")],
        [("h1", 7, "j4", "submitted"), ("h1", 8, "j5", "submitted"), ("h2", 9, "j6", "submitted")],
    ]
    out = run_batches(spark, jobs.submitted, "sha256 string, seq bigint, job_id string, status string", batches, tmp_path)
    assert sorted((r["sha256"], r["action"], r["job_id"]) for r in out.collect()) == [("h1", "created", "j1"), ("h1", "existing", "j1"), ("h1", "existing", "j1"), ("h1", "requeued", "j1"), ("h2", "created", "j3"), ("h2", "existing", "j3")]


def test_results_are_told_once(spark, tmp_path):
    batches = [[("a", 1, "detecting", 5.0), ("b", 1, "failed", 9.0)], [("a", 2, "complete", 100.0), ("b", 2, "failed", 9.0)], [("a", 2, "complete", 100.0), ("a", 3, "complete", 100.0)]]
    out = run_batches(spark, lambda d: jobs.watched(d, 600), "job_id string, seq bigint, status string, progress double", batches, tmp_path)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "result", "complete", 100.0), ("b", "result", "failed", 9.0)]


def test_heartbeats_and_stalls_without_news(spark, tmp_path):
    ddl, src = "job_id string, seq bigint, status string, progress double", str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "detecting", 5.0)], ddl).coalesce(1).write.parquet(src)
    q = jobs.watched(spark.readStream.schema(ddl).parquet(src), 1.0).writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    try:
        wait(lambda: spark.table("beats").where("what = 'stalled'").count() >= 1)
        spark.createDataFrame([("a", 2, "complete", 100.0)], ddl).coalesce(1).write.mode("append").parquet(src)
        wait(lambda: spark.table("beats").where("what = 'result'").count() == 1)
        n = spark.table("beats").count()
        time.sleep(2.5)
        assert spark.table("beats").count() == n
    finally:
        q.stop()
    assert [r["what"] for r in spark.table("beats").collect()][:2] == ["heartbeat", "stalled"]
