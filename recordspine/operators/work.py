"""Work that may start, and leases that have run out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a recovery leaves on jobs and runs.
LEASE_EXPIRED, ATTEMPTS_EXHAUSTED = "lease_expired", "lease_attempts_exhausted"


def expired(now: Column) -> Column:
    return (F.col("status") == "leased") & (F.col("lease_expires_at") < now)


def ready(jobs: DataFrame, deps: DataFrame, now: Column) -> DataFrame:
    """Jobs that may be leased: queued, or leased with a lease that has run out; attempts left; due, or without a time; and
    every known prerequisite succeeded. A failed or dead prerequisite holds its jobs back."""
    waiting = jobs.where("status <> 'succeeded'").select(F.col("job_id").alias("prerequisite_job_id"))
    blocked = deps.join(waiting, "prerequisite_job_id", "left_semi").select("job_id")
    due = F.col("scheduled_for").isNull() | (F.col("scheduled_for") <= now)
    return jobs.where(((F.col("status") == "queued") | expired(now)) & (F.col("attempt_count") < F.col("max_attempts")) & due).join(blocked, "job_id", "left_anti")


def recover_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs after a recovery: expired leases are queued again from now on, or dead letters if no attempt is left."""
    late = expired(now)
    dead = late & (F.col("attempt_count") >= F.col("max_attempts"))
    return jobs.withColumns({
        "status": F.when(dead, "dead_letter").when(late, "queued").otherwise(F.col("status")),
        "scheduled_for": F.when(late & ~dead, now).otherwise(F.col("scheduled_for")),
        "completed_at": F.when(dead, now),
        "error_class": F.when(dead, ATTEMPTS_EXHAUSTED).when(late, LEASE_EXPIRED),
        "lease_expires_at": F.when(~late, F.col("lease_expires_at")),
    })


def close_stale_runs(runs: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """runs after a recovery: what is still started for a job whose lease has run out has failed now."""
    late = jobs.where(expired(now)).select("job_id", F.lit(True).alias("_late"))
    stale = (F.col("status") == "started") & F.coalesce("_late", F.lit(False))
    out = runs.join(late, "job_id", "left").withColumns({"error_class": F.when(stale, LEASE_EXPIRED), "completed_at": F.when(stale, now), "status": F.when(stale, "failed").otherwise(F.col("status"))})
    return out.drop("_late")
