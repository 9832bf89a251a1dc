"""Streaming forms against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import timeline as tm
from tideline.streaming import events as st


def run(spark, source, fn, schema, tmp_path, mode="append"):
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = fn(df).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql("select * from out")


def test_files_are_given_out_once_stable(spark, tmp_path):
    rows = [("a", 5, 0.0), ("a", 9, 10.0), ("a", 9, 30.0), ("a", 9, 41.0), ("a", 9, 90.0), ("b", 1, 0.0), ("b", 1, 29.0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "path string, size bigint, seen double").coalesce(1).write.parquet(src)
    out = run(spark, src, st.stable_files, "path string, size bigint, seen double", tmp_path)
    assert [tuple(r) for r in out.collect()] == [("a", 9)]


def test_dead_time_equals_batch(spark, tmp_path):
    rows = [("s", i, float(t), k) for i, (t, k) in enumerate([(0, "shot_on_target"), (50, "catch"), (60, "shot_on_target"), (104.9, "catch"), (200, "shot_on_target"), (200.5, "catch"), (245, "catch"), (400, "catch")])]
    ddl = "stream_id string, seq bigint, t double, event_type string"
    df = spark.createDataFrame(rows, ddl)
    src = str(tmp_path / "in")
    for part in range(2):
        df.where((F.col("seq") >= part * 4) & (F.col("seq") < part * 4 + 4)).coalesce(1).write.mode("append").parquet(src)
    batch = tm.within(df.where("event_type = 'shot_on_target'"), df, 1.0, 45.0, "left_anti", True, True, where=F.col("r.seq") != F.col("seq"))
    out = run(spark, src, st.dead_time, ddl, tmp_path)
    assert sorted(r["seq"] for r in out.collect()) == sorted(r["seq"] for r in batch.collect()) == [0, 4]


def test_sessions_and_duplicates(spark, tmp_path):
    ts = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [("s", "e%d" % i, "goal", 0.5, ts(s)) for i, s in enumerate([0, 29, 58, 100, 900])] + [("s", "e0", "goal", 0.9, ts(1))]
    df = spark.createDataFrame(rows, "stream_id string, event_id string, event_type string, confidence double, ts string").withColumn("ts", F.to_timestamp("ts"))
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    out = run(spark, src, lambda d: st.sessions(d, "30 seconds"), df.schema, tmp_path)
    assert sorted(r["cluster_size"] for r in out.collect()) == [1, 4]
    once = run(spark, src, st.first_of_each, df.schema, tmp_path / "b")
    assert once.count() == 5


def test_state_ends_when_nothing_comes(spark, tmp_path):
    """A stream that ends gives out its last shot once the watermark has passed its idle time."""
    ddl, src = "stream_id string, seq bigint, t double, event_type string, ts timestamp", str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame([(*r[:4], r[4]) for r in rows], ddl.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
    add(("s", 1, 0.0, "shot_on_target", "2024-01-01 00:00:00"), ("s", 2, 0.5, "catch", "2024-01-01 00:00:01"))
    df = spark.readStream.schema(ddl).parquet(src)
    q = st.dead_time(df, ts="ts", idle_sec=60).writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    assert spark.table("ended").count() == 0
    for k in range(2):
        add(("other", 10 + k, 1.0 + k, "catch", f"2024-01-01 01:0{k}:00"))
        q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("ended").collect()] == [("s", 1)]


def test_shots_confirmed_by_kickoffs(spark, tmp_path):
    ddl = "stream_id string, seq bigint, ts timestamp, kind string"
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = spark.createDataFrame([("s", i, at(t), k) for i, (t, k) in enumerate([(0, "shot"), (10, "kickoff"), (95, "kickoff"), (200, "shot"), (209, "kickoff"), (290, "kickoff")])], "stream_id string, seq bigint, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)
    out = run(spark, src, lambda d: st.confirmed_by_kickoff(d.where("kind = 'shot'"), d.where("kind = 'kickoff'")), ddl, tmp_path)
    assert sorted((r["seq"], r["kickoff_seq"]) for r in out.collect()) == [(0, 1), (3, 5)]


def test_upserts_replace_themselves(spark, tmp_path):
    from tideline.sources.events import compacted

    ddl, src, out = "event_id string, _seq bigint, confidence double", str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.3), ("b", 2, 0.2)], ddl).coalesce(1).write.parquet(src)
    write = st.upsert_latest(out)
    df = spark.readStream.schema(ddl).parquet(src)
    q = df.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    write(spark.read.schema(ddl).parquet(src), 0)
    write(spark.createDataFrame([("b", 9, 0.9)], ddl), 1)
    now = compacted(spark.read.parquet(out).drop("batch"), "event_id", "_seq")
    assert sorted((r["event_id"], r["confidence"]) for r in now.collect()) == [("a", 0.3), ("b", 0.9)]


def test_alarms_observe(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "DEAD"), ("b", "PLAY")], "stream_id string, label string").coalesce(1).write.parquet(src)
    df = spark.readStream.schema("stream_id string, label string").parquet(src)
    q = st.alarms(df).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    seen = [p.observedMetrics["canary"] for p in q.recentProgress if p.observedMetrics]
    q.stop()
    assert seen[0].windows == 2 and seen[0].dead == 1
