"""Worker runs, jobs, monitoring: readiness, states, health, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordspine.functions import ladders
from recordspine.operators import graph, relational, work
from recordspine.operators.ordering import with_position
from recordspine.plans.registry import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def ts(c):
    return F.col(c).cast("timestamp_ntz")


READY_AT = "TIMESTAMP '2024-01-30 12:00:00'"


@query(f"""
WITH p AS (SELECT job_id, status FROM fx_jobs), held AS (SELECT d.job_id FROM fx_job_deps d JOIN p ON p.job_id = d.prerequisite_job_id GROUP BY d.job_id HAVING count(*) > count(*) FILTER (WHERE p.status = 'succeeded'))
SELECT job_id, status, priority, scheduled_for, row_number() OVER (ORDER BY priority DESC, scheduled_for NULLS FIRST, job_id) AS position FROM fx_jobs
WHERE (status = 'queued' OR status = 'leased' AND lease_expires_at < {READY_AT}) AND attempt_count < max_attempts AND (scheduled_for IS NULL OR scheduled_for <= {READY_AT}) AND job_id NOT IN (SELECT job_id FROM held)""")
def ready_work(t):
    """Jobs that may be leased, in the queue's order; a third of the dependencies have a prerequisite that failed."""
    jobs = t.jobs.withColumns({"scheduled_for": ts("scheduled_for"), "lease_expires_at": ts("lease_expires_at")})
    rows = work.ready(jobs, t.job_deps, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return with_position(rows.select("job_id", "status", "priority", "scheduled_for"), [F.desc("priority"), F.asc_nulls_first("scheduled_for"), F.asc("job_id")])


@query("SELECT job_id, worker_run_id, capability, status, started_at FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, worker_run_id DESC) AS r FROM fx_worker_runs) WHERE r = 1")
def latest_run_per_job(t):
    return relational.latest(t.worker_runs, ["job_id"], [F.col("started_at").desc(), F.col("worker_run_id").desc()]).select("job_id", "worker_run_id", "capability", "status", "started_at")


@query("SELECT capability, CAST(sum(records_read) AS BIGINT) AS records_read, CAST(sum(records_written) AS BIGINT) AS records_written, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) AS runs FROM fx_worker_runs GROUP BY capability")
def budget_usage(t):
    return t.worker_runs.groupBy("capability").agg(F.sum("records_read").alias("records_read"), F.sum("records_written").alias("records_written"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count(F.lit(1)).alias("runs"))


@query("""
SELECT capability, good, failed, CASE WHEN good = 0 AND failed > 0 THEN 'FAILED' WHEN good = 0 THEN 'READY' WHEN failed > 0 THEN 'DEGRADED' ELSE 'ACTIVE' END AS state FROM (
SELECT capability, count(*) FILTER (WHERE started_at >= TIMESTAMP '2024-01-29 00:00:00' AND status = 'succeeded' AND (records_read > 0 OR records_written > 0)) AS good, count(*) FILTER (WHERE started_at >= TIMESTAMP '2024-01-29 00:00:00' AND status = 'failed') AS failed FROM fx_worker_runs GROUP BY capability)""")
def capability_state(t):
    recent = ts("started_at") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    good = recent & (F.col("status") == "succeeded") & ((F.col("records_read") > 0) | (F.col("records_written") > 0))
    g = t.worker_runs.groupBy("capability").agg(F.count_if(good).alias("good"), F.count_if(recent & (F.col("status") == "failed")).alias("failed"))
    return g.withColumn("state", ladders.capability_state(F.lit("READY"), F.col("good"), F.col("failed")))


@query("SELECT capability, worker_run_id, started_at, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY started_at DESC, worker_run_id DESC) AS r FROM fx_worker_runs WHERE status = 'succeeded') WHERE r <= 10")
def recent_runs(t):
    return relational.top_k(t.worker_runs.where("status = 'succeeded'"), ["capability"], [F.col("started_at").desc(), F.col("worker_run_id").desc()], 10).select("capability", "worker_run_id", "started_at", "rank")


@query(f"""
SELECT job_id, attempt_count, CASE WHEN attempt_count >= max_attempts THEN 'dead_letter' ELSE 'requeue' END AS decision FROM fx_jobs WHERE status = 'leased' AND lease_expires_at < {NOW}""")
def expired_leases(t):
    j = t.jobs.where((F.col("status") == "leased") & (ts("lease_expires_at") < now()))
    return j.select("job_id", "attempt_count", F.when(F.col("attempt_count") >= F.col("max_attempts"), "dead_letter").otherwise("requeue").alias("decision"))


STREAKS = """SELECT *, sum(f) OVER (PARTITION BY job_id, island ORDER BY started_at, worker_run_id ROWS UNBOUNDED PRECEDING) AS failures FROM (
  SELECT *, sum(1 - f) OVER (PARTITION BY job_id ORDER BY started_at, worker_run_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS f FROM fx_worker_runs))"""


def failure_runs(t):
    return relational.streaks(t.worker_runs, "job_id", ["started_at", "worker_run_id"], F.col("status") == "failed")


@query(f"SELECT job_id, CAST(max(failures) AS BIGINT) AS longest, count(*) FILTER (WHERE failures >= 2) AS open_circuits FROM ({STREAKS}) GROUP BY job_id")
def failure_streaks(t):
    return failure_runs(t).groupBy("job_id").agg(F.max("failures").alias("longest"), F.count_if(F.col("failures") >= 2).alias("open_circuits"))


@query(f"""SELECT worker_run_id, CAST(failures AS BIGINT) AS failures, CAST(e + floor(e * 0.1 * ((failures % 7) / 7)) AS BIGINT) AS backoff_ms FROM (SELECT worker_run_id, CAST(failures AS INT) AS failures, least(900000.0::DOUBLE, 1000 * pow(2.0, greatest(failures - 1, 0))) AS e FROM ({STREAKS}) WHERE failures > 0)""")
def backoff_schedule(t):
    return failure_runs(t).where("failures > 0").select("worker_run_id", "failures", ladders.backoff_ms(F.col("failures"), 1000, 900000).alias("backoff_ms"))


@query("SELECT capability, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'started') AS started FROM fx_worker_runs GROUP BY capability")
def outcome_pivot(t):
    return t.worker_runs.groupBy("capability").pivot("status", ["succeeded", "failed", "started"]).count().fillna(0)


@query("SELECT job_id, round(avg(CASE WHEN status = 'succeeded' THEN 1.0 ELSE 0.0 END), 4) AS rate, avg(CASE WHEN status = 'succeeded' THEN 1.0 ELSE 0.0 END) >= 0.6 AS passes FROM fx_worker_runs GROUP BY job_id")
def success_rate(t):
    rate = F.avg((F.col("status") == "succeeded").cast("double"))
    return t.worker_runs.groupBy("job_id").agg(F.round(rate, 4).alias("rate"), (rate >= 0.6).alias("passes"))


@query("SELECT capability, count(*) AS attempts, count(DISTINCT job_id) AS unique_work, count(DISTINCT CASE WHEN status = 'succeeded' THEN job_id END) AS unique_done FROM fx_worker_runs GROUP BY capability")
def unique_work(t):
    return t.worker_runs.groupBy("capability").agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("job_id").alias("unique_work"), F.count_distinct(F.when(F.col("status") == "succeeded", F.col("job_id"))).alias("unique_done"))


@query("SELECT s.seat_id, m.observed FROM fx_seats s LEFT JOIN (SELECT job_id, max(started_at) AS observed FROM fx_worker_runs WHERE status = 'succeeded' AND job_id % 2 = 0 GROUP BY job_id) m ON m.job_id = s.seat_id ORDER BY m.observed NULLS FIRST, s.seat_id LIMIT 50")
def rotation_pick(t):
    seen = t.worker_runs.where("status = 'succeeded' AND job_id % 2 = 0").groupBy(F.col("job_id").alias("seat_id")).agg(F.max("started_at").alias("observed"))
    return t.seats.select("seat_id").join(seen, "seat_id", "left").orderBy(F.asc_nulls_first("observed"), "seat_id").limit(50)


@query("SELECT job_id, capability, count(*) AS occurrence_count, min(started_at) AS first_observed, max(started_at) AS last_observed FROM fx_worker_runs WHERE status = 'failed' GROUP BY job_id, capability")
def observation_counter(t):
    return t.worker_runs.where("status = 'failed'").groupBy("job_id", "capability").agg(F.count(F.lit(1)).alias("occurrence_count"), F.min("started_at").alias("first_observed"), F.max("started_at").alias("last_observed"))


@query("SELECT DISTINCT job_id, capability FROM fx_worker_runs r WHERE NOT EXISTS (SELECT 1 FROM fx_worker_runs b WHERE b.started_at < TIMESTAMP '2024-01-02 00:00:00' AND b.job_id = r.job_id AND b.capability = r.capability) AND started_at >= TIMESTAMP '2024-01-02 00:00:00'")
def insert_if_absent(t):
    cut = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    r = t.worker_runs.select("job_id", "capability", ts("started_at").alias("at"))
    return relational.insert_if_absent(r.where(F.col("at") < cut), r.where(F.col("at") >= cut), ["job_id", "capability"]).select("job_id", "capability")


@query("""
SELECT (SELECT count(*) FROM fx_jobs WHERE status = 'queued') AS queued, (SELECT count(*) FROM fx_jobs WHERE status = 'leased') AS leased, (SELECT count(*) FROM fx_jobs WHERE status = 'dead_letter') AS dead_letter,
  (SELECT count(*) FROM fx_worker_runs) AS runs, (SELECT count(*) FROM fx_worker_runs WHERE status = 'failed') AS failed_runs, (SELECT count(*) FROM fx_seats) AS seats, (SELECT count(*) FROM fx_seats WHERE monitoring_active) AS monitored, (SELECT count(*) FROM fx_claims) AS claims, (SELECT count(*) FROM fx_claims WHERE verification_state = 'verified') AS verified""")
def control_snapshot(t):
    count_of = lambda df, **named: df.agg(*(F.count_if(F.expr(v)).alias(k) for k, v in named.items()))
    parts = [count_of(t.jobs, queued="status = 'queued'", leased="status = 'leased'", dead_letter="status = 'dead_letter'"), count_of(t.worker_runs, runs="true", failed_runs="status = 'failed'"), count_of(t.seats, seats="true", monitored="monitoring_active"), count_of(t.claims, claims="true", verified="verification_state = 'verified'")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query("SELECT capability, status, count(*) AS n FROM fx_worker_runs WHERE status IS NOT NULL GROUP BY capability, status")
def status_counts(t):
    return t.worker_runs.where("status IS NOT NULL").groupBy("capability", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT job_id, max(started_at) AS newest, round(epoch({NOW} - max(started_at)) / 3600, 2) AS hours, CASE WHEN epoch({NOW} - max(started_at)) / 3600 > 72 THEN 'error' WHEN epoch({NOW} - max(started_at)) / 3600 > 36 THEN 'warning' ELSE 'fresh' END AS state FROM fx_worker_runs GROUP BY job_id")
def freshness_hours(t):
    g = t.worker_runs.groupBy("job_id").agg(F.max("started_at").alias("newest"))
    hours = (F.unix_micros(now().cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3_600_000_000
    return g.select("job_id", "newest", F.round(hours, 2).alias("hours"), F.when(hours > 72, "error").when(hours > 36, "warning").otherwise("fresh").alias("state"))


@query("SELECT capability, date_trunc('day', started_at) AS bucket, count(*) AS runs FROM fx_worker_runs GROUP BY ALL")
def cadence_windows(t):
    w = t.worker_runs.groupBy("capability", F.window("started_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("runs"))
    return w.select("capability", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "runs")


@query("""
WITH h AS (SELECT capability, date_trunc('hour', started_at) AS hr, count(*) AS n FROM fx_worker_runs GROUP BY ALL)
SELECT capability, hr + INTERVAL 1 HOUR * k.k AS window_end, CAST(sum(n) AS BIGINT) AS runs FROM h CROSS JOIN (SELECT unnest(range(1, 25)) AS k) k GROUP BY ALL""")
def sliding_activity(t):
    w = t.worker_runs.groupBy("capability", F.window("started_at", "24 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("runs"))
    return w.select("capability", F.col("w.end").cast("timestamp_ntz").alias("window_end"), "runs")


@query("SELECT worker_run_id, 'ingest:' || capability || ':' || strftime(started_at, '%Y-%m-%d') AS daily_key, '900s-' || CAST(CAST(floor(epoch(started_at) / 900) AS BIGINT) AS STRING) AS cadence_key FROM fx_worker_runs")
def dedupe_keys(t):
    seconds = F.unix_seconds(F.col("started_at").cast("timestamp"))
    return t.worker_runs.select("worker_run_id", F.concat_ws(":", F.lit("ingest"), "capability", F.date_format("started_at", "yyyy-MM-dd")).alias("daily_key"), F.concat(F.lit("900s-"), F.floor(seconds / 900).cast("string")).alias("cadence_key"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS STRING) || ',"type":"' || event_type || '"}' AS merged FROM events""")
def props_json(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k"), F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"type":"'), "event_type", F.lit('"}')).alias("merged"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT job_id AS a, prerequisite_job_id AS b FROM fx_job_deps), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT e.a AS job_id, e.b AS prerequisite_job_id FROM e JOIN reach r ON r.a = e.b AND r.b = e.a""")
def dependency_cycles(t):
    return graph.cyclic_edges(t.job_deps, "job_id", "prerequisite_job_id")


FP = """SELECT *, lag(fingerprint) OVER w AS previous, lag(fingerprint) OVER w IS NULL OR lag(fingerprint) OVER w <> fingerprint AS changed FROM fx_fingerprints WINDOW w AS (PARTITION BY source_id ORDER BY checked_at, fingerprint)"""


@query(f"SELECT source_id, checked_at, fingerprint, previous, changed, max(CASE WHEN changed THEN checked_at END) OVER (PARTITION BY source_id ORDER BY checked_at, fingerprint ROWS UNBOUNDED PRECEDING) AS last_changed_at FROM ({FP})")
def fingerprint_changes(t):
    return relational.change_points(t.fingerprints, "source_id", "checked_at", "fingerprint", ["fingerprint"])


@query("""
WITH first AS (SELECT source_id, fingerprint, min(CAST(checked_at AS DATE)) AS pass FROM fx_fingerprints GROUP BY ALL), passes AS (SELECT DISTINCT source_id, CAST(checked_at AS DATE) AS pass FROM fx_fingerprints),
n AS (SELECT p.source_id, p.pass, count(f.fingerprint) AS new_items FROM passes p LEFT JOIN first f ON f.source_id = p.source_id AND f.pass = p.pass GROUP BY ALL)
SELECT source_id, pass, new_items, row_number() OVER w >= 2 AND sum(new_items) OVER (PARTITION BY source_id ORDER BY pass ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 0 AS saturated FROM n WINDOW w AS (PARTITION BY source_id ORDER BY pass)""")
def saturation(t):
    f = t.fingerprints.select("source_id", "fingerprint", F.to_date("checked_at").alias("pass"))
    first = f.groupBy("source_id", "fingerprint").agg(F.min("pass").alias("pass")).groupBy("source_id", "pass").agg(F.count(F.lit(1)).alias("new_items"))
    n = f.select("source_id", "pass").distinct().join(first, ["source_id", "pass"], "left").fillna(0, ["new_items"])
    w = Window.partitionBy("source_id").orderBy("pass")
    return n.withColumn("saturated", (F.row_number().over(w) >= 2) & (F.sum("new_items").over(w.rowsBetween(-1, 0)) == 0))


@query("""SELECT n_nationkey AS collector, n, CASE WHEN n < 3 THEN 'below' WHEN n > 5 THEN 'above' ELSE 'healthy' END AS state FROM (SELECT n.n_nationkey, count(s.s_suppkey) AS n FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey)""")
def range_health(t):
    n = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("collector")).agg(F.count("s_suppkey").alias("n"))
    return n.withColumn("state", F.when(F.col("n") < 3, "below").when(F.col("n") > 5, "above").otherwise("healthy"))


@query("""
WITH c AS (SELECT n.n_regionkey AS region_id, n.n_nationkey, count(s.s_suppkey) AS n FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY ALL)
SELECT region_id, count(*) FILTER (WHERE n = 0) AS errors, count(*) FILTER (WHERE n > 0 AND (n < 3 OR n > 5)) AS attention, CASE WHEN count(*) FILTER (WHERE n = 0) > 0 THEN 'error' WHEN count(*) FILTER (WHERE n < 3 OR n > 5) > 0 THEN 'attention' ELSE 'healthy' END AS state FROM c GROUP BY region_id""")
def health_state(t):
    c = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_regionkey").alias("region_id"), "n_nationkey").agg(F.count("s_suppkey").alias("n"))
    severity = F.when(F.col("n") == 0, 2).when((F.col("n") < 3) | (F.col("n") > 5), 1).otherwise(0)
    worst = F.max(severity)
    return c.groupBy("region_id").agg(F.count_if(severity == 2).alias("errors"), F.count_if(severity == 1).alias("attention"), F.when(worst == 2, "error").when(worst == 1, "attention").otherwise("healthy").alias("state"))
