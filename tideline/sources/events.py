"""Readers and writers: the append-only event log, jobs, ground truth, detections, calibration, model answers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.timeline import scan

from tideline import schema

EVENT_KINDS = [t[0] for t in schema.EVENT_TYPES]


def parsed_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Event rows of JSON lines; blank lines, broken ones and those of unknown type or without an id go.

    Missing fields get the event's defaults; other columns of ``lines`` stay.
    """
    kept = lines.where(F.trim(value) != "")
    row = F.from_json(value, schema.EVENT_DDL)
    rest = [c for c in lines.columns if c != value]
    e = kept.select(*rest, row.alias("e")).select(*rest, "e.*").where(F.col("event_id").isNotNull() & F.col("event_type").isin(EVENT_KINDS))
    return e.na.fill({"reviewed": False, "is_goalkeeper_event": False, "metadata": "{}"})


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log as it is on disk, with ``_seq``, the order of its lines."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n")).alias("_seq"))
    return parsed_lines(lines)


def line_count(spark: SparkSession, path: str) -> int:
    """Lines that are not blank, valid or not."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], schema.EVENT_DDL).write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the log is there and has a byte."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and fs.getContentSummary(p).getLength() > 0


def compacted(log: DataFrame, key: str = "event_id", seq: str = "_seq") -> DataFrame:
    """The last row of each key; a combinable aggregate, so hot keys are reduced before they are shuffled."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("x")).select(key, "x.*")


def merged(logs: list[DataFrame], key: str = "event_id") -> DataFrame:
    """Several logs as one, the later log's rows winning; ``_seq`` becomes (log, line)."""
    tagged = [x.withColumn("_seq", F.struct(F.lit(i).alias("log"), F.col("_seq").alias("line"))) for i, x in enumerate(logs)]
    return compacted(reduce(DataFrame.unionByName, tagged), key)


def ground_truth(docs: DataFrame, mapping: DataFrame, half2_video_start: float = 3916.0, half2_game_offset: float = 2700.0) -> DataFrame:
    """Annotated events of exported matches: nested rows exploded, named kinds mapped, clocks turned to video seconds.

    ``docs`` has game and data (array of rows with event_time in ms, period_name, events with event_name and
    property).  ``mapping`` has name, type (null: any) and event_type; a match with type goes first.  Second-half
    times start at ``half2_game_offset`` on the clock and ``half2_video_start`` in the video.
    """
    rows = docs.select("game", F.posexplode("data").alias("row_no", "d")).select("game", "row_no", "d.*", F.posexplode("d.events").alias("event_no", "e"))
    kind = F.coalesce("e.property.Type", "e.property.Outcome")
    exact = mapping.where("type is not null").select(F.col("name").alias("n1"), F.col("type").alias("t1"), F.col("event_type").alias("k1"))
    plain = mapping.where("type is null").select(F.col("name").alias("n2"), F.col("event_type").alias("k2"))
    m = rows.withColumn("name", F.col("e.event_name")).withColumn("kind", kind)
    m = m.join(F.broadcast(exact), (F.col("name") == F.col("n1")) & (F.col("kind") == F.col("t1")), "left").join(F.broadcast(plain), F.col("name") == F.col("n2"), "left")
    sec = F.col("event_time") / 1000.0
    second = ~F.col("period_name").startswith("1st")
    t = F.when(second, sec - half2_game_offset + half2_video_start).otherwise(sec)
    return m.withColumn("event_type", F.coalesce("k1", "k2")).where(F.col("event_type").isNotNull()).select("game", "row_no", "event_no", "event_type", t.alias("t"), "team_name", "x", "y")


def detections(df: DataFrame) -> DataFrame:
    """Detections of either layout (timestamp_start, metadata.vlm_reasoning or start_sec, reasoning) as one."""
    have = set(df.columns)
    col = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    start, end = col("timestamp_start", "start_sec"), col("timestamp_end", "end_sec")
    why = [F.get_json_object("metadata", "$.vlm_reasoning")] if "metadata" in have else []
    why += [F.col("reasoning")] if "reasoning" in have else []
    return df.select("event_type", start.alias("start"), end.alias("end"), ((start + end) / 2).alias("centre"), "confidence", F.coalesce(*why, F.lit("")).alias("reasoning"))


def calibration(games: DataFrame) -> DataFrame:
    """Clock offsets of games from one row of JSON: the given offset, else anchor minus event time; incomplete games go."""
    one = "h1_offset_sec double, h2_offset_sec double, h1_anchor_video_sec double, h2_anchor_video_sec double, h1_anchor_event_ms double, h2_anchor_event_ms double".replace(" double", ":double")
    g = games.select(F.explode(F.from_json("value", f"map<string,struct<{one}>>")).alias("game", "c"))
    half = lambda h: F.coalesce(F.col(f"c.{h}_offset_sec"), F.col(f"c.{h}_anchor_video_sec") - F.col(f"c.{h}_anchor_event_ms") / 1000.0)
    return g.select("game", half("h1").alias("h1_offset"), half("h2").alias("h2_offset")).dropna()


def between_markers(lines: DataFrame, start: Column, stop: Column, seq: str = "seq") -> DataFrame:
    """Lines strictly after a start marker and before the next stop marker; ``lines`` has a stream and ``seq``."""
    # the last marker seen decides, which has the greatest number
    mark = F.when(start, F.struct(F.col(seq), F.lit(True).alias("opens"))).when(stop, F.struct(F.col(seq), F.lit(False).alias("opens")))
    seen = scan(lines, ("stream_id",), (seq,), highest={"__seen": mark})
    return seen.where(F.col("__seen.opens") & mark.isNull()).drop("__seen")


def probe_row(df: DataFrame, value: str = "value") -> DataFrame:
    """Video metadata of probe output: the first video stream, frames a second, duration of stream else container."""
    from tideline.functions.text import frames_per_second

    v = F.from_json(value, "streams array<struct<codec_type:string,codec_name:string,r_frame_rate:string,width:int,height:int,duration:string>>, format struct<duration:string,size:string>")
    p = df.withColumn("v", v).withColumn("s", F.get(F.filter("v.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))
    return p.where(F.col("s").isNotNull() & F.col("s.codec_name").isin("h264", "hevc")).select(
        *(c for c in df.columns if c != value), F.col("s.codec_name").alias("codec"), "s.width", "s.height", frames_per_second(F.col("s.r_frame_rate")).alias("fps"),
        F.coalesce(F.col("s.duration").try_cast("double"), F.col("v.format.duration").try_cast("double")).alias("duration_sec"), F.col("v.format.size").try_cast("bigint").alias("size_bytes"),
    )


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp4", "mov", "mkv")) -> DataFrame:
    """Files of a directory with their size and time; contents are not read."""
    ext = F.lower(F.substring_index("path", ".", -1))
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), "modificationTime").where(ext.isin(*extensions))


#: Bytes of a file that are in memory at once while it is hashed.
PIECE = 8 << 20


def content_ids(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file, of any size: a task opens its files itself and reads them piece by piece.

    Spark lists the files and deals them by path; the store must be one that Arrow opens.  A file that cannot be read fails its task;
    empty files are not listed.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                fs, at = FileSystem.from_uri(re.sub("^file:/+", "/", name) if name.startswith("file:") else quote(name, safe=":/"))
                state = hashlib.sha256()
                with fs.open_input_stream(at) as f:
                    while piece := f.read(PIECE):
                        state.update(piece)
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], names=["path", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path").repartition("path").mapInArrow(run, "path string, sha256 string")


#: The fields of a window's line in a worker's log.
WINDOW_LINE = r"single_pass\.window\s+elapsed=([\d.]+)s\s+end=([\d.]+)\s+events=(\d+)\s+idx=(\d+)\s+start=([\d.]+)\s+text='(.+?)'\s*$"


def window_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """elapsed, end, events, idx, start and text of the lines that tell of a window; other lines go."""
    part = lambda i: F.regexp_extract(value, WINDOW_LINE, i)
    kinds = (("elapsed", "double"), ("end", "double"), ("events", "int"), ("idx", "int"), ("start", "double"), ("text", "string"))
    return lines.where(F.col(value).rlike(WINDOW_LINE)).select(*(c for c in lines.columns if c != value), *(part(i + 1).cast(k).alias(n) for i, (n, k) in enumerate(kinds)))


def cache_keys(spark: SparkSession, path: str) -> DataFrame:
    """A short key of each file from its path, its size and its first megabyte."""
    plain = F.regexp_replace("path", "^file:/*", "/")
    said = F.concat(F.encode(plain, "UTF-8"), F.encode(F.col("length").cast("string"), "UTF-8"), F.substring("content", 1, 1 << 20))
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha1(said), 1, 16).alias("key"))
