"""Generated rows: schedules, cohort top-ups, contract rows; visibility and state upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordspine.operators import relational
from recordspine.plans.registry import query

DAYS = ["2024-01-02", "2024-01-03", "2024-01-04"]


@query("""
SELECT s.seat_id, d.day, 'monitor:seat:' || CAST(s.seat_id AS STRING) || ':daily:' || CAST(d.day AS STRING) AS dedupe_key
FROM fx_seats s CROSS JOIN (VALUES (DATE '2024-01-02'), (DATE '2024-01-03'), (DATE '2024-01-04')) AS d(day)
WHERE s.monitoring_active AND NOT EXISTS (SELECT 1 FROM fx_worker_runs r WHERE r.job_id = s.seat_id AND CAST(r.started_at AS DATE) = d.day)""")
def daily_schedule(t):
    due = t.seats.where("monitoring_active").select("seat_id", F.explode(F.array(*(F.to_date(F.lit(d)) for d in DAYS))).alias("day"))
    ran = t.worker_runs.select(F.col("job_id").alias("seat_id"), F.to_date("started_at").alias("day"))
    return due.join(ran, ["seat_id", "day"], "left_anti").select("seat_id", "day", F.concat_ws(":", F.lit("monitor:seat"), F.col("seat_id").cast("string"), F.lit("daily"), F.col("day").cast("string")).alias("dedupe_key"))


@query("""
WITH n AS (SELECT n.n_nationkey AS nation, count(s.s_suppkey) AS have FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey)
SELECT nation, CAST(o.o AS INT) AS ordinal FROM n CROSS JOIN (SELECT unnest(range(1, 7)) AS o) o WHERE o.o > n.have""")
def cohort_top_up(t):
    n = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("nation")).agg(F.count("s_suppkey").cast("int").alias("have"))
    return n.where("have < 6").select("nation", F.explode(F.sequence(F.col("have") + 1, F.lit(6))).alias("ordinal"))


@query("""
SELECT s.office_type || ':v1' AS contract_key, f.field_key, count(*) AS seats, count(*) FILTER (WHERE f.required_for_baseline) AS required FROM fx_seats s CROSS JOIN fx_contract_fields f GROUP BY ALL""")
def contract_rows(t):
    s = t.seats.groupBy(F.concat(F.col("office_type"), F.lit(":v1")).alias("contract_key")).agg(F.count(F.lit(1)).alias("seats"))
    return s.crossJoin(F.broadcast(t.contract_fields)).select("contract_key", "field_key", "seats", F.when(F.col("required_for_baseline"), F.col("seats")).otherwise(0).alias("required"))


@query("""
WITH visible AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey % 100 = 7)
SELECT v.o_orderkey AS petition_id, count(l.l_orderkey) AS evidence FROM visible v LEFT JOIN lineitem l ON l.l_orderkey = v.o_orderkey GROUP BY v.o_orderkey""")
def petition_visibility(t):
    visible = t.orders.where("o_orderstatus = 'F' OR o_custkey % 100 = 7").select(F.col("o_orderkey").alias("petition_id"))
    shown = t.lineitem.groupBy(F.col("l_orderkey").alias("petition_id")).agg(F.count(F.lit(1)).alias("n"))
    return visible.join(shown, "petition_id", "left").select("petition_id", F.coalesce("n", F.lit(0)).alias("evidence"))


@query("""
WITH b AS (SELECT source_id, min(checked_at) AS n FROM fx_fingerprints WHERE fingerprint % 2 = 0 GROUP BY source_id), d AS (SELECT source_id, min(checked_at) AS n FROM fx_fingerprints WHERE fingerprint % 2 = 1 GROUP BY source_id)
SELECT coalesce(b.source_id, d.source_id) AS source_id, least(b.n, d.n) AS next_check_at FROM b FULL JOIN d ON d.source_id = b.source_id""")
def monitoring_upsert(t):
    f = t.fingerprints
    part = lambda r, name: f.where(F.col("fingerprint") % 2 == r).groupBy("source_id").agg(F.min("checked_at").alias(name))
    return part(0, "old").join(part(1, "new"), "source_id", "full_outer").select("source_id", F.least("old", "new").alias("next_check_at"))


@query("""
SELECT election, seat_id, person_id, occupancy_id, CASE WHEN r = 1 THEN 'won' WHEN occupancy_status = 'completed' THEN 'withdrawn' ELSE 'lost' END AS outcome FROM (
  SELECT *, date_trunc('year', start_date)::DATE AS election, row_number() OVER (PARTITION BY date_trunc('year', start_date), seat_id ORDER BY CASE WHEN occupancy_status = 'completed' THEN 1 ELSE 0 END, start_date DESC, occupancy_id) AS r FROM fx_occupancies)""")
def election_outcomes(t):
    o = t.occupancies.withColumn("election", F.trunc("start_date", "year"))
    w = Window.partitionBy("election", "seat_id").orderBy((F.col("occupancy_status") == "completed").cast("int"), F.desc("start_date"), "occupancy_id")
    r = F.row_number().over(w)
    return o.withColumn("r", r).select("election", "seat_id", "person_id", "occupancy_id", F.when(F.col("r") == 1, "won").when(F.col("occupancy_status") == "completed", "withdrawn").otherwise("lost").alias("outcome"))


@query("""
SELECT claim_id, evidence_id, min(role) AS role, count(*) AS times FROM (SELECT claim_id, evidence_id, role FROM fx_claim_evidence UNION ALL SELECT claim_id, evidence_id, role FROM fx_claim_evidence WHERE evidence_id % 3 = 0) GROUP BY claim_id, evidence_id""")
def link_set_insert(t):
    e = t.claim_evidence
    again = e.where("evidence_id % 3 = 0")
    return e.unionAll(again).groupBy("claim_id", "evidence_id").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("times"))


@query("""
SELECT seat_id, string_agg(field_key, ',' ORDER BY k DESC, field_key) AS fields FROM (SELECT subject_id AS seat_id, field_key, count(*) AS k, row_number() OVER (PARTITION BY subject_id ORDER BY count(*) DESC, field_key) AS r FROM fx_claims GROUP BY subject_id, field_key) WHERE r <= 3 GROUP BY seat_id""")
def leading_fields(t):
    n = t.claims.groupBy(F.col("subject_id").alias("seat_id"), "field_key").agg(F.count(F.lit(1)).alias("k"))
    top = relational.top_k(n, ["seat_id"], [F.col("k").desc(), F.col("field_key")], 3)
    return top.groupBy("seat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "field_key"))), lambda x: x["field_key"]), ",").alias("fields"))
