"""Jobs: states, what may be done in them, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline import schema

RUNNING = ["pending", "ingesting", "detecting", "segmenting", "assembling"]
# The states in which each action is allowed.
ALLOWED = {"pause": RUNNING, "cancel": [*RUNNING, "paused"], "resume": ["paused"], "retry": ["failed", "cancelled"], "delete": ["complete", "failed", "cancelled"]}


def by_status(jobs: DataFrame) -> DataFrame:
    """(status, jobs) for every status."""
    dim = jobs.sparkSession.createDataFrame([(s,) for s in schema.JOB_STATUS], "status string")
    return dim.join(jobs.groupBy("status").agg(F.count("*").alias("jobs")), "status", "left").select("status", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def allowed_actions(status: Column) -> Column:
    return F.array_compact(F.array(*(F.when(status.isin(states), action) for action, states in ALLOWED.items())))


def prometheus(counts: DataFrame, metric: str = "jobs_total") -> DataFrame:
    """Lines of text exposition."""
    return counts.select(F.format_string(f'{metric}{{status="%s"}} %d', "status", "jobs").alias("value"))


def stalled(progress: DataFrame, least: float = 0.1, ticks: int = 2) -> DataFrame:
    """Ticks at which a job's progress grew less than ``least`` for ``ticks`` ticks in a row; progress has job_id, tick, pct."""
    w = W.partitionBy("job_id").orderBy("tick")
    slow = F.coalesce((F.col("pct") - F.lag("pct").over(w) < least).cast("int"), F.lit(0))
    p = progress.withColumn("slow", slow)
    return p.withColumn("run", F.sum("slow").over(w.rowsBetween(1 - ticks, 0))).where(F.col("run") == ticks).select("job_id", "tick", "pct")


def idempotent(submissions: DataFrame) -> DataFrame:
    """The first submission of each content hash that did not fail, else the latest failed one to be run again."""
    live = F.min(F.when(F.col("status") != "failed", F.struct("seq", "job_id")))
    dead = F.max(F.when(F.col("status") == "failed", F.struct("seq", "job_id")))
    return submissions.groupBy("sha256").agg(live.alias("a"), dead.alias("b")).select("sha256", F.coalesce("a.job_id", "b.job_id").alias("job_id"), F.col("a").isNull().alias("requeue"))


# A job log is append-only: (job_id, seq, status, progress, error, pause_requested, cancel_requested, output_paths,
# deleted, created_at, updated_at); the row with the highest seq is what a job is now.
JOB_LOG = (
    "job_id string, seq bigint, status string, progress double, error string, pause_requested boolean, cancel_requested boolean, "
    "output_paths map<string,string>, deleted boolean, created_at timestamp, updated_at timestamp"
)
FIELDS = [part.strip().split(" ")[0] for part in JOB_LOG.split(", ")]


def safe_id(job_id: Column) -> Column:
    """An id that cannot leave its folder."""
    return F.replace(F.replace(job_id, F.lit("/"), F.lit("")), F.lit(".."), F.lit(""))


def created(requests: DataFrame) -> DataFrame:
    """First log rows of new jobs; ``requests`` has job_id, seq and created_at."""
    fresh = {"status": F.lit("pending"), "progress": F.lit(0.0), "error": F.lit(None).cast("string"), "pause_requested": F.lit(False), "cancel_requested": F.lit(False), "output_paths": F.create_map().cast("map<string,string>"), "deleted": F.lit(False)}
    own = {"job_id": safe_id(F.col("job_id")), "seq": F.col("seq"), "created_at": F.col("created_at"), "updated_at": F.col("created_at")}
    return requests.select(*((own | fresh)[c].alias(c) for c in FIELDS))


def current(log: DataFrame) -> DataFrame:
    """The jobs that are not deleted, each as its last row says."""
    last = log.groupBy("job_id").agg(F.max_by(F.struct(*(c for c in FIELDS if c != "job_id")), "seq").alias("x"))
    return last.select("job_id", "x.*").where(~F.col("deleted")).select(*FIELDS)


def one(log: DataFrame, job_id: str) -> DataFrame:
    """A single job, or no row."""
    return current(log.where(F.col("job_id") == safe_id(F.lit(job_id))))


def with_updates(log: DataFrame, updates: DataFrame) -> DataFrame:
    """Log rows that ``updates`` append, at most one a job; jobs that are not there get none.

    ``updates`` has job_id, seq, at, and action: status (with new_status, new_progress, new_error, new_paths),
    pause, cancel or delete.  A state other than failed clears a stale error, pending clears both flags, new
    output paths are added to the old ones.
    """
    j = current(log).join(updates.select(safe_id(F.col("job_id")).alias("job_id"), F.col("seq").alias("new_seq"), "at", "action", "new_status", "new_progress", "new_error", "new_paths"), "job_id")
    moved = F.col("action") == "status"
    waits = moved & (F.col("new_status") == "pending")
    paths = F.when(moved & F.col("new_paths").isNotNull(), F.map_concat(F.map_filter("output_paths", lambda k, _: ~F.coalesce(F.map_contains_key("new_paths", k), F.lit(False))), "new_paths")).otherwise(F.col("output_paths"))
    new = {
        "job_id": F.col("job_id"), "seq": F.col("new_seq"), "status": F.when(moved, F.col("new_status")).otherwise(F.col("status")),
        "progress": F.when(moved, F.coalesce("new_progress", "progress")).otherwise(F.col("progress")),
        "error": F.when(moved & F.col("new_error").isNotNull(), F.col("new_error")).when(moved & (F.col("new_status") != "failed"), F.lit(None)).otherwise(F.col("error")),
        "pause_requested": F.when(waits, False).when(F.col("action") == "pause", True).otherwise(F.col("pause_requested")),
        "cancel_requested": F.when(waits, False).when(F.col("action") == "cancel", True).otherwise(F.col("cancel_requested")),
        "output_paths": paths, "deleted": F.col("action") == "delete", "created_at": F.col("created_at"), "updated_at": F.col("at"),
    }
    return j.select(*(new[c].alias(c) for c in FIELDS))


def newest_first(log: DataFrame) -> DataFrame:
    return current(log).orderBy(F.desc("created_at"), "job_id")
