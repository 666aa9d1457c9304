from datetime import datetime, timedelta

import pytest
from conftest import SF
from pyspark.sql import functions as F

from recordspine.plans import catalog
from recordspine.plans.views import Tables
from recordspine.streaming import jobs
from recordspine.streaming.ordered import ROCKS


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def stream_of(spark, df, tmp_path, files=1):
    path = str(tmp_path / "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def result(spark, stream, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def same(a, b):
    return sorted(map(str, (tuple(r) for r in a.collect()))) == sorted(map(str, (tuple(r) for r in b.collect())))


@pytest.fixture
def runs(spark):
    return Tables(spark, SF).worker_runs.withColumn("started_at", F.col("started_at").cast("timestamp"))


def shuffled(spark, df, ts, tmp_path, files, last, seed=5):
    """A stream of df in files of random rows, then one row far ahead that lets all others through."""
    path = str(tmp_path / "in")
    df.withColumn("_f", (F.rand(seed) * files).cast("int")).repartition(files, "_f").drop("_f").write.parquet(path)
    end = spark.createDataFrame([last], df.schema)
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_submissions_equal_batch_in_any_order(spark, tmp_path):
    from recordspine.plans.universe import submissions

    rows = submissions(Tables(spark, SF)).withColumn("ts", F.timestamp_seconds(F.col("turn") + 1_700_000_000))
    last = tuple({"producer": "end", "job_id": -1, "turn": 0, "hash": "h", "ts": datetime(2030, 1, 1)}.get(c) for c in rows.columns)
    out = result(spark, jobs.submission_outcomes(shuffled(spark, rows, "ts", tmp_path, 5, last), delay=10**6, keep=2 * 10**6), tmp_path)
    want = catalog.queries()["receipt_idempotency"](spark, SF)
    assert same(out.where("producer <> 'end' AND NOT late").select(*want.columns), want)


def test_cadence_and_sliding_equal_batch(spark, runs, tmp_path):
    out = result(spark, jobs.cadence_counts(stream_of(spark, runs, tmp_path)), tmp_path, "complete")
    want = catalog.queries()["cadence_windows"](spark, SF)
    assert same(out.select("capability", F.col("bucket").cast("timestamp_ntz"), "runs"), want)
    (tmp_path / "b").mkdir()
    out = result(spark, jobs.trailing_activity(stream_of(spark, runs, tmp_path / "b")), tmp_path / "b", "complete")
    assert same(out.select("capability", F.col("window_end").cast("timestamp_ntz"), "runs"), catalog.queries()["sliding_activity"](spark, SF))


def test_fingerprints_equal_batch_in_any_order(spark, tmp_path):
    f = Tables(spark, SF).fingerprints.withColumns({"checked_at": F.col("checked_at").cast("timestamp"), "fingerprint": F.col("fingerprint").cast("long")})
    stream = shuffled(spark, f, "checked_at", tmp_path, 5, (-1, datetime(2025, 1, 1), 0))
    out = result(spark, jobs.fingerprint_stream(stream, delay=40 * 86400, keep=80 * 86400), tmp_path)
    want = catalog.queries()["fingerprint_changes"](spark, SF).where("changed").select("source_id", F.date_trunc("millisecond", F.col("checked_at").cast("timestamp")).alias("at"), "previous", "fingerprint")
    assert same(out.where("source_id >= 0 AND NOT late").select("source_id", "at", "previous", "fingerprint"), want)


def test_circuit_opens_once_and_stays_open(spark, tmp_path):
    at = datetime(2024, 1, 1)
    minutes = [(i, c == "f") for i, c in enumerate("fffsffffff")] + [(60, True), (61, False), (200, False), (2000, False)]
    rows = spark.createDataFrame([(1, at + timedelta(minutes=i), x) for i, x in minutes], "source_id long, ts timestamp, failed boolean")
    out = result(spark, jobs.circuit_breaker(stream_of(spark, rows, tmp_path)), tmp_path).orderBy("at").collect()
    told = [((r["at"] - at).total_seconds() / 60, r.state, r.failures) for r in out]
    assert told == [(8, "open", 5), (39, "half_open", 6), (60, "open", 7), (61, "closed", 0)]


def test_late_rows_change_nothing_and_state_ends(spark, tmp_path):
    at, path = datetime(2024, 1, 1), tmp_path / "in"
    schema = "source_id long, checked_at timestamp, fingerprint long"
    for i in range(100):
        rows = [(i, at + timedelta(hours=i), 1), (i, at + timedelta(hours=i, minutes=1), 2)] + [(7, at + timedelta(hours=1), 9)] * (i == 20)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(path))
    out = jobs.fingerprint_stream(stream, delay=60, keep=86400)
    q = out.writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("ends")
    assert [(r.source_id, r["at"]) for r in got.where("late").collect()] == [(7, at + timedelta(hours=1))]
    assert got.where("NOT late AND source_id < 90").count() == 180 and got.where("source_id = 7 AND fingerprint = 9").isEmpty()
    held = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert max(held) < 400 and q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 250


def test_lease_results_equal_batch_in_any_order(spark, tmp_path):
    at = datetime(2024, 1, 1)
    t = lambda m: at + timedelta(minutes=m)
    leases = [(i, 10 * i, t(i), t(i + 30)) for i in range(60)]
    results = [(i, 10 * i, "failed" if i % 5 == 0 else "succeeded", t(i + (20 if i % 3 else 50))) for i in range(60) if i % 4] + [(3, 31, "succeeded", t(9))]
    left = spark.createDataFrame(leases, "job_id long, lease_id long, leased_at timestamp, expires_at timestamp")
    right = spark.createDataFrame(results, "job_id long, lease_id long, status string, finished_at timestamp")
    (tmp_path / "l").mkdir(), (tmp_path / "r").mkdir()
    a = shuffled(spark, left, "leased_at", tmp_path / "l", 3, (-1, -1, t(9000), t(9030)))
    b = shuffled(spark, right, "finished_at", tmp_path / "r", 3, (-2, -2, "failed", t(9000)))
    out = result(spark, jobs.lease_results(a, b, horizon=7200, delay=36000), tmp_path)
    done = {(r[0], r[1]): ("failed" if r[2] == "failed" else "late_success" if r[3] > t(r[0] + 30) else "success") for r in results}
    assert {(r.job_id, r.lease_id): r.decision for r in out.where("job_id >= 0").collect()} == {(i, k): done.get((i, k), "expired") for i, k, *_ in leases}


def test_rows_behind_the_clock_go_to_a_side_table(spark, tmp_path):
    at, path = datetime(2024, 1, 1), str(tmp_path / "in")
    for rows in ([(1, at)], [(2, at + timedelta(hours=5))], [(3, at + timedelta(hours=1)), (4, at + timedelta(hours=5))], [(5, at + timedelta(hours=6))]):
        spark.createDataFrame(rows, "job_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("job_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    assert [(r.job_id, r["at"]) for r in result(spark, jobs.late_rows(stream, ["job_id"], "ts"), tmp_path).collect()] == [(3, at + timedelta(hours=1))]


def test_reopening_runs_along_chains_diamonds_and_cycles(spark, tmp_path):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("a", "x"), ("a", "y"), ("x", "z"), ("y", "z"), ("p", "q"), ("q", "p"), ("u", "v")]
    deps, path = str(tmp_path / "deps"), str(tmp_path / "in")
    spark.createDataFrame(edges, "fact_key string, scope string").write.parquet(deps)
    facts = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 2)), ("p", datetime(2024, 1, 1))], "fact_key string, ts timestamp")
    facts.coalesce(1).write.parquet(path)
    q = jobs.start_reopening(spark.readStream.schema(facts.schema).parquet(path), deps, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination(120)
    got = [(r.scope, r.depth) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5), ("p", 2), ("q", 1), ("x", 1), ("y", 1), ("z", 2)]


def test_leases_expire_and_late_success_counts_once(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(1, "leased", t(0)), (1, "leased", t(3)), (1, "succeeded", t(3.5)), (2, "leased", t(0)), (2, "succeeded", t(5)), (3, "leased", t(1)), (3, "failed", t(1.5))]
    df = spark.createDataFrame(rows, "job_id long, event string, ts timestamp")
    out = result(spark, jobs.lease_watch(stream_of(spark, df, tmp_path)), tmp_path)
    assert sorted((r.job_id, r.decision) for r in out.collect()) == [(1, "requeue"), (2, "late_success")]


def test_duplicates_and_dependents(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("p", 1, "h", at), ("p", 1, "h", at), ("p", 2, "h", at)], "producer string, job_id long, hash string, ts timestamp")
    assert result(spark, jobs.first_submissions(stream_of(spark, rows, tmp_path)), tmp_path).count() == 2
    (tmp_path / "b").mkdir()
    facts = spark.createDataFrame([("f1", at), ("f2", at)], "fact_key string, ts timestamp")
    deps = spark.createDataFrame([("f1", "s1"), ("f1", "s2")], "fact_key string, scope string")
    assert sorted(r.scope for r in result(spark, jobs.reopened_scopes(stream_of(spark, facts, tmp_path / "b"), deps), tmp_path / "b").collect()) == ["s1", "s2"]


def test_silent_sources_raise_alerts(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    df = spark.createDataFrame([(1, at(0)), (2, at(0)), (2, at(40)), (2, at(200)), (3, at(190))], "source_id long, ts timestamp")
    out = result(spark, jobs.staleness_alerts(stream_of(spark, df, tmp_path)), tmp_path).collect()
    assert [(r.source_id, r.alert) for r in out][:1] == [(1, "warning")] and {r.source_id for r in out} == {1}


def test_sessions_of_a_job(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    df = spark.createDataFrame([(1, at(0)), (1, at(5)), (1, at(20)), (2, at(0)), (9, at(400))], "job_id long, started_at timestamp")
    out = result(spark, jobs.work_sessions(stream_of(spark, df, tmp_path)), tmp_path).collect()
    assert sorted((r.job_id, r.runs) for r in out if r.job_id != 9) == [(1, 1), (1, 2), (2, 1)]
