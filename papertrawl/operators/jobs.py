"""Job ledger: states, history, idempotent submissions, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.operators.ranking import page, ranked_per_key

AT = ["ts", "event_id"]


def latest_state(events: DataFrame) -> DataFrame:
    """Status and progress per job. The first terminal event settles a job; later events do not reopen it.

    Aggregates only, so a busy job is combined on the map side.
    """
    at = F.struct(*AT)
    terminal = F.col("event").isin(fv.TERMINAL_EVENTS)
    seen = events.groupBy("job_id").agg(
        F.min(F.when(terminal, F.struct(*AT, "event"))).alias("end"),
        F.max_by("progress", F.when(F.col("event") == "progress", at)).alias("progress"),
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("events"),
    )
    return seen.select(
        "job_id",
        F.when(F.col("end.event") == "complete", "success").when(F.col("end.event") == "error", "failed")
        .otherwise("processing").alias("status"),
        F.when(F.col("end.event") == "complete", 100).otherwise(F.coalesce("progress", F.lit(0))).alias("progress"),
        "created_at", F.coalesce("end.ts", "last_seen").alias("updated_at"), "events",
    )


def last_events(events: DataFrame, n: int = fv.EVENTS_KEPT) -> DataFrame:
    """The newest n events of every job."""
    return ranked_per_key(events, ["job_id"], [F.desc(c) for c in AT], n, "age")


def timeouts(events: DataFrame, seconds: int = fv.JOB_TIMEOUT_SECONDS) -> DataFrame:
    """Jobs given up: their first progress event later than the limit after their start, unless settled before."""
    late = F.col("ts") > F.col("started") + F.make_interval(secs=F.lit(seconds))
    starts = events.groupBy("job_id").agg(F.min("ts").alias("started"))
    ends = events.join(starts, "job_id").groupBy("job_id").agg(
        F.min(F.when(late & (F.col("event") == "progress"), F.struct(*AT))).alias("late"),
        F.min(F.when(F.col("event").isin(fv.TERMINAL_EVENTS), F.struct(*AT))).alias("end"),
    )
    given_up = F.col("late").isNotNull() & (F.col("end").isNull() | (F.col("late") < F.col("end")))
    return ends.filter(given_up).select("job_id", F.col("late.ts").alias("timed_out_at"))


def replay_after(events: DataFrame, cursors: DataFrame, states: DataFrame) -> DataFrame:
    """Per reader (job_id, last_id): the state at connection, then every later event up to the one that ends the job."""
    snapshot = cursors.join(states, "job_id").select(
        "job_id", F.lit(None).cast("bigint").alias("event_id"), F.lit("job_update").alias("event"), "status"
    )
    unread = events.join(cursors, "job_id").filter(F.col("event_id") > F.col("last_id"))
    ends = unread.filter(F.col("event").isin(fv.TERMINAL_EVENTS)).groupBy("job_id").agg(F.min("event_id").alias("end_id"))
    unread = unread.join(ends, "job_id", "left").filter(F.col("end_id").isNull() | (F.col("event_id") <= F.col("end_id")))
    later = unread.select(
        "job_id", "event_id", "event", F.lit(None).cast("string").alias("status")
    )
    return snapshot.unionByName(later)


def job_counts(jobs: DataFrame, *dims: str) -> DataFrame:
    return jobs.groupBy(*dims).agg(F.count(F.lit(1)).alias("jobs"))


def owned_by(jobs: DataFrame, user_id, job_type: str | None = None, status: str | None = None) -> DataFrame:
    mine = jobs.filter(F.col("user_id") == user_id)
    if job_type:
        mine = mine.filter(F.col("job_type") == job_type)
    return mine.filter(F.col("status") == status) if status else mine


def job_history(jobs: DataFrame, page_no: int = 1, per_page: int = 20) -> DataFrame:
    return page(jobs, [F.desc("created_at"), F.asc("job_id")], page_no, per_page)


def attach_owner(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with their parent's columns; orphans drop out."""
    return children.join(parents, key)


def without_orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def assign_jobs(submissions: DataFrame) -> DataFrame:
    """Every submission with the job that serves it: a user's first one with the same file and mode.

    The first one is found by an aggregate; the join back has one row per key on its right side, so a file
    submitted very often only lengthens the left side, which the adaptive skew join splits.
    """
    keyed = submissions.withColumn("idempotency_key", F.concat_ws(":", "file_hash", "mode"))
    firsts = keyed.groupBy("user_id", "idempotency_key").agg(F.min("submission_id").alias("job_id"))
    return keyed.join(firsts, ["user_id", "idempotency_key"])


def new_jobs(assigned: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Submissions that create a job: the first of their key, and not known from earlier."""
    fresh = assigned.filter(F.col("submission_id") == F.col("job_id"))
    return fresh if existing is None else fresh.join(existing, ["user_id", "idempotency_key"], "left_anti")
