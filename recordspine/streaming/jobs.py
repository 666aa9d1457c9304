"""Streams over submissions, worker runs and source checks. Input is any streaming DataFrame with the named columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordspine.sources.tables import written
from recordspine.streaming.ordered import Fold, ordered


def first_submissions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first of each (producer, job_id, hash) within the watermark; later ones are duplicates."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["producer", "job_id", "hash"])


def submission_outcomes(stream: DataFrame, delay: int = 3600, keep: int = 30 * 86400) -> DataFrame:
    """accepted, duplicate or conflict for each submission of (producer, job_id): the first hash in event time wins, for as long
    as the job has been heard of in the last `keep` seconds. Columns: producer, job_id, turn, hash, ts. Late ones have no outcome."""

    def step(state, at, row):
        first = state[0] if state[0] is not None else row["hash"]
        outcome = "accepted" if state[0] is None else "duplicate" if row["hash"] == first else "conflict"
        return (first,), [(at, row["turn"], outcome)]

    return ordered(stream, ["producer", "job_id"], "ts", Fold("turn bigint, hash string", "first string", "turn bigint, outcome string", step, order=("turn", "hash")), delay, keep)


def cadence_counts(stream: DataFrame, cadence: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Runs by capability in tumbling windows of a cadence."""
    w = stream.withWatermark("started_at", delay).groupBy("capability", F.window("started_at", cadence).alias("w")).agg(F.count(F.lit(1)).alias("runs"))
    return w.select("capability", F.col("w.start").alias("bucket"), "runs")


def trailing_activity(stream: DataFrame, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Runs by capability in sliding windows."""
    w = stream.withWatermark("started_at", delay).groupBy("capability", F.window("started_at", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("runs"))
    return w.select("capability", F.col("w.end").alias("window_end"), "runs")


def work_sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Runs of a job that follow each other within a gap."""
    w = stream.withWatermark("started_at", delay).groupBy("job_id", F.session_window("started_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("runs"))
    return w.select("job_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "runs")


def lease_watch(stream: DataFrame, lease_seconds: int = 3600, max_attempts: int = 5, delay: str = "0 seconds") -> DataFrame:
    """requeue or dead_letter for each leased job without a terminal event by its deadline; a late success is told once.

    Columns: job_id, event (leased, succeeded, failed), ts. Event time drives the deadlines.
    """
    schema = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("decision", T.StringType()), T.StructField("attempts", T.LongType())])

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, deadline, expired = state.get if state.exists else (0, 0, False)
        out = []
        if state.hasTimedOut:
            out.append((key[0], "dead_letter" if attempts >= max_attempts else "requeue", attempts))
            state.update((attempts, 0, True))
        else:
            rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for event, at in zip(rows["event"], rows["ts"], strict=True):
                ms = int(at.timestamp() * 1000)
                if event == "leased":
                    if deadline and ms > deadline:
                        out.append((key[0], "dead_letter" if attempts >= max_attempts else "requeue", attempts))
                    attempts, deadline, expired = attempts + 1, ms + lease_seconds * 1000, False
                else:
                    if event == "succeeded" and (expired or deadline and ms > deadline):
                        out.append((key[0], "late_success", attempts))
                    deadline, expired = 0, False
            state.update((attempts, deadline, expired))
            if deadline:
                state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "decision", "attempts"])

    return stream.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(run, schema, "attempts long, deadline long, expired boolean", "append", GroupStateTimeout.EventTimeTimeout)


def staleness_alerts(stream: DataFrame, warn_hours: int = 36, error_hours: int = 72, delay: str = "0 seconds") -> DataFrame:
    """warning and error for each source that stays silent, in event time. Columns: source_id, ts."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, level = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            level += 1
            out.append((key[0], "warning" if level == 1 else "error"))
        else:
            newest, level = max(newest, *(int(f["ts"].max().timestamp() * 1000) for f in frames)), 0
        state.update((newest, level))
        if level < 2:
            state.setTimeoutTimestamp(max(newest + 3_600_000 * (warn_hours if level == 0 else error_hours), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source_id", "alert"])

    return stream.withWatermark("ts", delay).groupBy("source_id").applyInPandasWithState(run, "source_id long, alert string", "newest long, level int", "append", GroupStateTimeout.EventTimeTimeout)


def fingerprint_stream(stream: DataFrame, delay: int = 3600, keep: int = 90 * 86400) -> DataFrame:
    """Changes of a source's fingerprint in event time. A source that was silent for `keep` seconds starts anew. Columns: source_id,
    checked_at, fingerprint."""

    def step(state, at, row):
        return (row["fingerprint"],), [] if row["fingerprint"] == state[0] else [(at, state[0], row["fingerprint"])]

    return ordered(stream, ["source_id"], "checked_at", Fold("fingerprint bigint", "last bigint", "previous bigint, fingerprint bigint", step, order=("fingerprint",)), delay, keep)


def circuit_breaker(stream: DataFrame, failures: int = 5, open_seconds: int = 1800, delay: int = 60, keep: int = 86400) -> DataFrame:
    """A source's circuit: open once after so many failures in a row, closed by a success, half_open when its time is over; then one
    more failure opens it again. Failures while it is open move its end. Columns: source_id, ts, failed."""

    def step(state, at, row):
        n, until = state[0] or 0, state[1]
        out = [(until, "half_open", n)] if until is not None and at >= until else []
        until = None if out else until
        if not row["failed"]:
            return (0, None), [*out, *([(at, "closed", 0)] if until is not None else [])]
        n += 1
        if n >= failures:
            out += [(at, "open", n)] if until is None else []
            until = at + 1000 * open_seconds
        return (n, until), out

    def idle(state, clock):
        n, until = state
        return ((n, None), [(until, "half_open", n)]) if until is not None and clock >= until else (state, [])

    fold = Fold("failed boolean", "n bigint, until bigint", "state string, failures bigint", step, order=("failed",), idle=idle, wake=lambda s: s[1])
    return ordered(stream, ["source_id"], "ts", fold, delay, keep)


def lease_results(leases: DataFrame, results: DataFrame, horizon: int = 86400, delay: int = 600) -> DataFrame:
    """(job_id, lease_id, leased_at, decision, finished_at): what came of each lease, by a left outer interval join of two streams.

    leases: job_id, lease_id, leased_at, expires_at; results: job_id, lease_id, status, finished_at. A result within `horizon`
    seconds of the lease's start counts: success in time, late_success after its end, failed; a lease without any is expired as
    soon as no result can come. State of either side ends with the horizon. Rows later than `delay` belong to late_rows.
    """
    left = leases.select("job_id", "lease_id", "leased_at", "expires_at").withWatermark("leased_at", f"{delay} seconds")
    right = results.select(F.col("job_id").alias("_job"), F.col("lease_id").alias("_lease"), "status", "finished_at").withWatermark("finished_at", f"{delay} seconds")
    within = (F.col("finished_at") >= F.col("leased_at")) & F.expr(f"finished_at <= leased_at + INTERVAL {int(horizon)} SECONDS")
    both = left.join(right, (F.col("job_id") == F.col("_job")) & (F.col("lease_id") == F.col("_lease")) & within, "left")
    late = F.col("finished_at") > F.col("expires_at")
    decision = F.when(F.col("status").isNull(), "expired").when(F.col("status") != "succeeded", "failed").when(late, "late_success").otherwise("success")
    return both.select("job_id", "lease_id", "leased_at", decision.alias("decision"), "finished_at")


def late_rows(stream: DataFrame, keys: list[str], ts: str, delay: int = 600, keep: int = 86400) -> DataFrame:
    """(keys, at): rows that come more than `delay` seconds behind the stream's newest, for a side table; the others give nothing."""
    nothing = Fold("seen bigint", "n int", "none int", lambda state, at, row: (state, []))
    return ordered(stream.withColumn("seen", F.unix_micros(ts)), keys, ts, nothing, delay, keep).where("late").select(*keys, "at")


def reopen_all(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(scope, depth): what has to be looked at again when facts change, along all dependencies.

    changed: fact_key; dependencies: fact_key, scope, where a scope may be a fact of others. Each scope comes once, at its least
    depth; a changed fact itself comes only if it depends on another one, so cycles end. A round is one join of the newest
    scopes with the dependencies; rounds are written out.
    """
    seen = written(changed.select(F.col("fact_key").alias("scope")).distinct().withColumn("depth", F.lit(0)), "reopened")
    front, depth = seen, 0
    while True:
        depth += 1
        reached = front.select(F.col("scope").alias("fact_key")).join(dependencies, "fact_key").select("scope").distinct()
        front = written(reached.join(seen.where("depth > 0").select("scope"), "scope", "left_anti").withColumn("depth", F.lit(depth)), "reopened")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0").select("scope", "depth")


def start_reopening(changes: DataFrame, dependencies_path: str, out_path: str, checkpoint: str, trigger: dict):
    """A query that writes, for each batch of changed facts, the scopes to look at again. The dependencies are read anew for each
    batch, so what was added since counts; a batch that runs twice replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = reopen_all(batch, spark.read.parquet(dependencies_path))
        found.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def reopened_scopes(changes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Scopes to open again when a fact changes: a stream of (fact_key, ts) against a table of (fact_key, scope)."""
    return changes.join(dependencies, "fact_key").select("scope", "fact_key", "ts")
