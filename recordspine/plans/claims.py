"""Claims, their evidence, their states, contract completeness and the work that follows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordspine import functions as fn
from recordspine.functions import ladders
from recordspine.operators import quality, relational
from recordspine.plans.registry import query

IMPLEMENTED = ["occupancy", "portrait", "contact", "identity", "biography", "elections", "evidence", "monitoring"]


def value(c):
    return F.col(c)


@query("""SELECT claim_id, subject_id, field_key, CASE verification_state WHEN 'checked_no_authoritative_result' THEN 'CHECKED_NO_AUTHORITATIVE_RESULT' WHEN 'not_collected' THEN 'MISSING' ELSE CASE WHEN normalized_value <> '' THEN 'PRESENT' ELSE 'UNKNOWN' END END AS presence FROM fx_claims""")
def claim_presence(t):
    return t.claims.select("claim_id", "subject_id", "field_key", ladders.claim_presence(value("verification_state"), value("normalized_value"), F.lit(None).cast("string")).alias("presence"))


@query("""SELECT field_key, CASE WHEN verification_state IN ('verified','conflict','stale','rejected') THEN upper(verification_state) ELSE 'PENDING' END AS bucket, count(*) AS n FROM fx_claims GROUP BY ALL""")
def verification_buckets(t):
    return t.claims.groupBy("field_key", ladders.verification_bucket(value("verification_state")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


MOVES_SQL = ", ".join(f"('{a}', '{b}')" for a, to in ladders.CLAIM_MOVES.items() for b in to)


@query(f"""
WITH steps AS (SELECT claim_id, subject_id, field_key, verification_state AS from_state, lead(verification_state) OVER (PARTITION BY subject_id, field_key ORDER BY valid_from, claim_id, verification_state) AS to_state FROM fx_claims),
moves(a, b) AS (VALUES {MOVES_SQL})
SELECT s.* FROM steps s WHERE to_state IS NOT NULL AND from_state <> to_state AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.a = s.from_state AND m.b = s.to_state)""")
def illegal_transitions(t):
    w = Window.partitionBy("subject_id", "field_key").orderBy("valid_from", "claim_id", "verification_state")
    steps = t.claims.select("claim_id", "subject_id", "field_key", F.col("verification_state").alias("from_state"), F.lead("verification_state").over(w).alias("to_state"))
    moves = t.spark.createDataFrame([(a, b) for a, to in ladders.CLAIM_MOVES.items() for b in to], "from_state string, to_state string")
    return steps.where("to_state IS NOT NULL AND from_state <> to_state").join(F.broadcast(moves), ["from_state", "to_state"], "left_anti").select("claim_id", "subject_id", "field_key", "from_state", "to_state")


@query("SELECT subject_id, field_key, normalized_value, min(valid_from) AS first_seen, max(valid_from) AS last_seen, count(*) AS sightings FROM fx_claims GROUP BY ALL")
def claim_seen_span(t):
    return t.claims.groupBy("subject_id", "field_key", "normalized_value").agg(F.min("valid_from").alias("first_seen"), F.max("valid_from").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))


@query("SELECT claim_id, subject_id, field_key, valid_from, valid_to FROM fx_claims WHERE (valid_from IS NULL OR valid_from <= DATE '1998-06-30') AND (valid_to IS NULL OR valid_to > DATE '1998-06-30')")
def claims_as_of(t):
    return relational.valid_at(t.claims, F.to_date(F.lit("1998-06-30"))).select("claim_id", "subject_id", "field_key", "valid_from", "valid_to")


@query("""
SELECT subject_id, field_key, count(DISTINCT normalized_value) AS n_values, array_to_string(list_sort(list(DISTINCT normalized_value)), ',') AS competing FROM fx_claims
WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-06-30') AND normalized_value <> '' GROUP BY subject_id, field_key HAVING count(DISTINCT normalized_value) > 1""")
def competing_claims(t):
    at = relational.valid_at(t.claims, F.to_date(F.lit("1998-06-30"))).where("normalized_value <> ''")
    sets = at.groupBy("subject_id", "field_key").agg(F.collect_set("normalized_value").alias("v"))
    return sets.where(F.size("v") > 1).select("subject_id", "field_key", F.size("v").cast("long").alias("n_values"), F.array_join(F.sort_array("v"), ",").alias("competing"))


@query("""
WITH p AS (SELECT subject_id, field_key, normalized_value, left(claim_id, 2) AS part, count(*) AS n, md5(string_agg(claim_id, ',' ORDER BY claim_id)) AS d FROM fx_claims GROUP BY ALL)
SELECT subject_id, field_key, normalized_value, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(part || d, ',' ORDER BY part)) AS claims_digest FROM p GROUP BY subject_id, field_key, normalized_value HAVING sum(n) > 1""")
def duplicate_claims(t):
    """Claims of one value; their digest is made in parts by the first letters of the id, so that no list holds a hot value's claims."""
    return digested(t.claims, ["subject_id", "field_key", "normalized_value"], F.col("claim_id"), ",", "claims_digest").where("n > 1")


def digested(df, keys, item, joiner, name):
    """n and a digest of the items of each key: of each of 256 parts by claim_id, then of the parts."""
    md5 = lambda items, by: F.md5(F.array_join(F.sort_array(F.collect_list(items)), by).cast("binary"))
    parts = df.groupBy(*keys, F.left("claim_id", F.lit(2)).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), md5(item, joiner).alias("_d"))
    return parts.groupBy(*keys).agg(F.sum("_n").alias("n"), md5(F.concat("_part", "_d"), ",").alias(name))


@query("""
WITH base AS (SELECT subject_id, field_key, coalesce(normalized_value, '') AS v, min(valid_from) AS f, max(valid_from) AS l, min_by(verification_state, concat(CAST(valid_from AS STRING), claim_id)) AS s FROM fx_claims WHERE valid_from < DATE '1999-01-01' GROUP BY ALL),
delta AS (SELECT subject_id, field_key, coalesce(normalized_value, '') AS v, min(valid_from) AS f, max(valid_from) AS l, min_by(verification_state, concat(CAST(valid_from AS STRING), claim_id)) AS s FROM fx_claims WHERE valid_from >= DATE '1999-01-01' GROUP BY ALL)
SELECT coalesce(b.subject_id, d.subject_id) AS subject_id, coalesce(b.field_key, d.field_key) AS field_key, coalesce(b.v, d.v) AS normalized_value, coalesce(b.f, d.f) AS first_seen, coalesce(d.l, b.l) AS last_seen, coalesce(b.s, d.s) AS verification_state
FROM base b FULL JOIN delta d ON d.subject_id = b.subject_id AND d.field_key = b.field_key AND d.v = b.v""")
def claim_upsert(t):
    keys = ["subject_id", "field_key", "normalized_value"]
    order = F.concat(F.col("valid_from").cast("string"), F.col("claim_id"))
    c = t.claims.withColumn("normalized_value", F.coalesce("normalized_value", F.lit("")))
    grouped = lambda df: df.groupBy(*keys).agg(F.min("valid_from").alias("first_seen"), F.max("valid_from").alias("last_seen"), F.min_by("verification_state", order).alias("verification_state"))
    base, delta = grouped(c.where("valid_from < DATE '1999-01-01'")), grouped(c.where("valid_from >= DATE '1999-01-01'"))
    return relational.upsert(base, delta, keys, keep=["first_seen", "verification_state"]).select(*keys, "first_seen", "last_seen", "verification_state")


@query("SELECT claim_id, sha256(encode(field_key) || '\\x00'::BLOB || encode(coalesce(normalized_value, ''))) AS value_hash FROM fx_claims")
def value_hash(t):
    return t.claims.select("claim_id", fn.value_hash(F.col("field_key"), F.coalesce("normalized_value", F.lit(""))).alias("value_hash"))



@query("""
WITH p AS (SELECT subject_id, left(claim_id, 2) AS part, count(*) AS n, md5(string_agg(claim_id || ':' || verification_state, ';' ORDER BY claim_id || ':' || verification_state)) AS d FROM fx_claims GROUP BY ALL)
SELECT subject_id, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(part || d, ',' ORDER BY part)) AS digest FROM p GROUP BY subject_id""")
def group_digest(t):
    return digested(t.claims, ["subject_id"], F.concat_ws(":", "claim_id", "verification_state"), ";", "digest")


FUNNEL = ["collected_unreviewed", "verification_pending", "verified"]


@query("""
WITH s AS (SELECT x.i AS stage, x.state, count(DISTINCT c.subject_id) AS subjects, count(c.claim_id) AS claims FROM (VALUES (1,'collected_unreviewed'),(2,'verification_pending'),(3,'verified')) AS x(i, state) LEFT JOIN fx_claims c ON c.verification_state = x.state GROUP BY x.i, x.state)
SELECT stage, state, subjects, claims, claims - lag(claims) OVER (ORDER BY stage) AS delta FROM s""")
def funnel(t):
    stages = t.spark.createDataFrame(list(enumerate(FUNNEL, 1)), "stage int, state string")
    n = t.claims.where(F.col("verification_state").isin(*FUNNEL)).groupBy(F.col("verification_state").alias("state")).agg(F.count_distinct("subject_id").alias("subjects"), F.count("claim_id").alias("claims"))
    s = stages.join(n, "state", "left").fillna(0)
    return s.select("stage", "state", "subjects", "claims", (F.col("claims") - F.lag("claims").over(Window.orderBy("stage"))).alias("delta"))  # three rows


@query("""
SELECT s.seat_id, f.field_key FROM fx_seats s CROSS JOIN fx_contract_fields f WHERE f.required_for_baseline AND NOT EXISTS (
  SELECT 1 FROM fx_claims c WHERE c.subject_id = s.seat_id AND c.field_key = f.field_key AND c.normalized_value <> '' AND c.verification_state NOT IN ('conflict', 'stale'))""")
def known_gaps(t):
    usable = t.claims.where("normalized_value <> '' AND verification_state NOT IN ('conflict', 'stale')").select(F.col("subject_id").alias("seat_id"), "field_key").distinct()
    expected = t.seats.select("seat_id").join(F.broadcast(t.contract_fields.where("required_for_baseline").select("field_key")), how="cross")
    return expected.join(usable, ["seat_id", "field_key"], "left_anti")


ROLE_COUNTS = "count(*) FILTER (WHERE role = 'supports') AS supports, count(*) FILTER (WHERE role = 'contextualizes') AS partial, count(*) FILTER (WHERE role = 'contradicts') AS against"


@query(f"""
WITH n AS (SELECT claim_id, {ROLE_COUNTS} FROM fx_claim_evidence GROUP BY claim_id)
SELECT claim_id, supports, partial, against, CASE WHEN supports > 0 AND against > 0 THEN 'CONFLICTING_EVIDENCE' WHEN supports > 0 THEN 'EVIDENCE_SUPPORTS_FULFILLMENT' WHEN against > 0 THEN 'EVIDENCE_SUPPORTS_NON_FULFILLMENT' WHEN partial > 0 THEN 'EVIDENCE_SUPPORTS_PARTIAL_FULFILLMENT' ELSE 'INSUFFICIENT_EVIDENCE' END AS state FROM n""")
def evidence_alignment(t):
    n = t.claim_evidence.groupBy("claim_id").agg(*(F.count_if(F.col("role") == r).alias(k) for r, k in (("supports", "supports"), ("contextualizes", "partial"), ("contradicts", "against"))))
    return n.withColumn("state", ladders.alignment_state(F.lit(False), F.col("supports"), F.col("partial"), F.col("against")))


def flags(t):
    """For each claim id: whether it has evidence and whether evidence contradicts it."""
    return t.claim_evidence.groupBy("claim_id").agg(F.lit(True).alias("has_evidence"), F.bool_or(F.col("role") == "contradicts").alias("has_contradiction"))


@query("""
SELECT c.claim_id, c.subject_id, c.field_key, c.normalized_value FROM fx_claims c WHERE c.verification_state = 'verified'
  AND EXISTS (SELECT 1 FROM fx_claim_evidence e WHERE e.claim_id = c.claim_id) AND NOT EXISTS (SELECT 1 FROM fx_claim_evidence e WHERE e.claim_id = c.claim_id AND e.role = 'contradicts')
  AND EXISTS (SELECT 1 FROM fx_seats s WHERE s.seat_id = c.subject_id AND s.baseline_status <> 'discovered')""")
def publication_eligible_claims(t):
    ok = flags(t).where("NOT has_contradiction").select("claim_id")
    matched = t.seats.where("baseline_status <> 'discovered'").select(F.col("seat_id").alias("subject_id"))
    return t.claims.where("verification_state = 'verified'").join(ok, "claim_id", "left_semi").join(matched, "subject_id", "left_semi").select("claim_id", "subject_id", "field_key", "normalized_value")


@query("SELECT c.claim_id, c.field_key, e.evidence_id, l.role, e.source_key, e.content_hash FROM fx_claims c JOIN fx_claim_evidence l ON l.claim_id = c.claim_id JOIN fx_evidence e ON e.evidence_id = l.evidence_id WHERE e.verification_state = 'verified'")
def evidence_for_claim(t):
    e = t.evidence.where("verification_state = 'verified'").select("evidence_id", "source_key", "content_hash")
    return t.claims.select("claim_id", "field_key").join(t.claim_evidence, "claim_id").join(e, "evidence_id").select("claim_id", "field_key", "evidence_id", "role", "source_key", "content_hash")


@query("""
SELECT s.seat_id, f.field_key, f.required_for_baseline FROM fx_seats s CROSS JOIN fx_contract_fields f
WHERE NOT EXISTS (SELECT 1 FROM fx_claims c JOIN fx_claim_evidence l ON l.claim_id = c.claim_id WHERE c.subject_id = s.seat_id AND c.field_key = f.field_key)
  AND NOT EXISTS (SELECT 1 FROM fx_jobs j WHERE j.job_id = s.seat_id AND j.status = 'queued')""")
def evidence_gaps(t):
    linked = t.claims.join(t.claim_evidence.select("claim_id").distinct(), "claim_id", "left_semi").select(F.col("subject_id").alias("seat_id"), "field_key").distinct()
    queued = t.jobs.where("status = 'queued'").select(F.col("job_id").alias("seat_id"))
    expected = t.seats.select("seat_id").join(queued, "seat_id", "left_anti").crossJoin(F.broadcast(t.contract_fields.select("field_key", "required_for_baseline")))
    return expected.join(linked, ["seat_id", "field_key"], "left_anti").select("seat_id", "field_key", "required_for_baseline")


def evaluated(t):
    """One row for each seat and contract field: the claim that stands for it, its presence and what is to be done."""
    one = relational.latest(t.claims.select("claim_id", F.col("subject_id").alias("seat_id"), "field_key", "normalized_value", "verification_state"), ["seat_id", "field_key"], [F.col("claim_id"), F.col("verification_state"), F.col("normalized_value")])
    rows = t.seats.select("seat_id", "monitoring_active").crossJoin(F.broadcast(t.contract_fields)).join(one, ["seat_id", "field_key"], "left").join(flags(t), "claim_id", "left")
    rows = rows.withColumns({"has_evidence": F.coalesce("has_evidence", F.lit(False)), "has_contradiction": F.coalesce("has_contradiction", F.lit(False)), "implemented": F.col("category").isin(*IMPLEMENTED)})
    none = F.lit(None).cast("string")
    structural = (F.col("field_key") == "monitoring") & F.col("monitoring_active")
    out = ladders.field_evaluation(F.col("field_key"), F.col("required_for_baseline"), F.lit(False), F.col("implemented"), F.col("verification_state"), ladders.has_value(F.col("normalized_value"), none), structural, F.col("has_evidence"), F.col("has_contradiction"), ladders.claim_presence(F.col("verification_state"), F.col("normalized_value"), none))
    return rows.withColumn("e", out).select("seat_id", "field_key", "category", "required_for_baseline", "claim_id", "verification_state", "has_evidence", F.col("e.presence").alias("presence"), F.col("e.action").alias("action"))


EVALUATED = f"""
SELECT r.*, CASE WHEN contra THEN CASE WHEN verification_state = 'checked_no_authoritative_result' THEN 'CHECKED_NO_AUTHORITATIVE_RESULT' WHEN normalized_value <> '' THEN 'PRESENT' ELSE 'UNKNOWN' END
    WHEN verification_state = 'stale' THEN 'PRESENT' WHEN verification_state = 'checked_no_authoritative_result' THEN 'CHECKED_NO_AUTHORITATIVE_RESULT' WHEN present THEN 'PRESENT' ELSE 'MISSING' END AS presence,
  CASE WHEN contra THEN 'contradiction' WHEN verification_state = 'stale' THEN 'refresh' WHEN verification_state = 'checked_no_authoritative_result' THEN 'none'
    WHEN present AND required_for_baseline AND NOT has_evidence AND verification_state IS NOT NULL AND field_key <> 'monitoring' THEN 'verify' WHEN present THEN 'none' WHEN NOT implemented THEN 'close_not_implemented' ELSE 'collect' END AS action
FROM (
  SELECT s.seat_id, f.field_key, f.category, f.required_for_baseline, c.claim_id, c.verification_state, c.normalized_value, l.claim_id IS NOT NULL AS has_evidence, coalesce(l.contra, false) AS contra,
    (f.field_key = 'monitoring' AND s.monitoring_active) OR coalesce(length(trim(c.normalized_value)) > 0, false) AS present, f.category IN ({', '.join(f"'{c}'" for c in IMPLEMENTED)}) AS implemented
  FROM fx_seats s CROSS JOIN fx_contract_fields f
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id, field_key ORDER BY claim_id, verification_state, normalized_value NULLS FIRST) AS r FROM fx_claims) c ON c.r = 1 AND c.subject_id = s.seat_id AND c.field_key = f.field_key
  LEFT JOIN (SELECT claim_id, bool_or(role = 'contradicts') AS contra FROM fx_claim_evidence GROUP BY claim_id) l ON l.claim_id = c.claim_id) r"""


@query(f"SELECT seat_id, field_key, category, presence, action FROM ({EVALUATED})")
def field_evaluation(t):
    return evaluated(t).select("seat_id", "field_key", "category", "presence", "action")


@query(f"SELECT seat_id, count(*) AS total, count(*) FILTER (WHERE presence = 'PRESENT') AS present, round(count(*) FILTER (WHERE presence = 'PRESENT') / count(*), 4) AS share FROM ({EVALUATED}) WHERE required_for_baseline GROUP BY seat_id")
def completeness_report(t):
    g = evaluated(t).where("required_for_baseline").groupBy("seat_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("presence") == "PRESENT").alias("present"))
    return g.withColumn("share", F.round(F.col("present") / F.col("total"), 4))


@query(f"SELECT seat_id, category, count(*) FILTER (WHERE presence IN ('PRESENT', 'CHECKED_NO_AUTHORITATIVE_RESULT')) AS present, count(*) AS total, coalesce(string_agg(CASE WHEN presence NOT IN ('PRESENT', 'CHECKED_NO_AUTHORITATIVE_RESULT') THEN field_key END, ',' ORDER BY field_key), '') AS gaps FROM ({EVALUATED}) GROUP BY seat_id, category")
def category_rollup(t):
    closed = F.col("presence").isin("PRESENT", "CHECKED_NO_AUTHORITATIVE_RESULT")
    return evaluated(t).groupBy("seat_id", "category").agg(F.count_if(closed).alias("present"), F.count(F.lit(1)).alias("total"), F.array_join(F.sort_array(F.collect_list(F.when(~closed, F.col("field_key")))), ",").alias("gaps"))


@query(f"""
WITH e AS (SELECT seat_id, count(*) FILTER (WHERE required_for_baseline) AS required, count(*) FILTER (WHERE required_for_baseline AND presence IN ('PRESENT', 'CHECKED_NO_AUTHORITATIVE_RESULT')) AS closed, count(*) FILTER (WHERE action = 'refresh') AS stale, count(*) FILTER (WHERE action = 'contradiction') AS contradictions, count(*) FILTER (WHERE has_evidence) AS with_evidence, count(*) FILTER (WHERE action <> 'none') AS open_work FROM ({EVALUATED}) GROUP BY seat_id)
SELECT e.*, closed = required AS baseline_closed, open_work = 0 AS complete_and_fresh FROM e""")
def seat_audit(t):
    need = F.col("required_for_baseline")
    g = evaluated(t).groupBy("seat_id").agg(
        F.count_if(need).alias("required"), F.count_if(need & F.col("presence").isin("PRESENT", "CHECKED_NO_AUTHORITATIVE_RESULT")).alias("closed"), F.count_if(F.col("action") == "refresh").alias("stale"),
        F.count_if(F.col("action") == "contradiction").alias("contradictions"), F.count_if("has_evidence").alias("with_evidence"), F.count_if(F.col("action") != "none").alias("open_work"))
    return g.withColumns({"baseline_closed": F.col("closed") == F.col("required"), "complete_and_fresh": F.col("open_work") == 0})


PURPOSE = {"refresh": "refresh", "contradiction": "contradiction_check", "verify": "verification", "dataset_unit": "dataset_unit", "collect": "collect"}


@query(f"""SELECT seat_id, field_key, p.purpose, concat_ws(':', 'work', p.purpose, CAST(seat_id AS STRING), field_key) AS dedupe_key, CASE WHEN required_for_baseline THEN 420 ELSE 260 END AS priority
FROM ({EVALUATED}) e JOIN (VALUES ('refresh','refresh'),('contradiction','contradiction_check'),('verify','verification'),('dataset_unit','dataset_unit'),('collect','collect')) AS p(action, purpose) ON p.action = e.action""")
def plan_work(t):
    purposes = F.broadcast(t.spark.createDataFrame(list(PURPOSE.items()), "action string, purpose string"))
    w = evaluated(t).join(purposes, "action")
    return w.select("seat_id", "field_key", "purpose", F.concat_ws(":", F.lit("work"), "purpose", F.col("seat_id").cast("string"), "field_key").alias("dedupe_key"), F.when(F.col("required_for_baseline"), 420).otherwise(260).alias("priority"))


@query("""
SELECT DISTINCT claim_id, verification_state, field_key, CASE
  WHEN verification_state = 'collected_unreviewed' AND NOT matched THEN 'entity_match_pending'
  WHEN verification_state = 'collected_unreviewed' AND NOT ev THEN 'evidence_pending'
  WHEN verification_state IN ('collected_unreviewed', 'verification_pending') THEN CASE WHEN contra THEN 'conflict' WHEN field_key = 'portrait' THEN 'rejected' WHEN NOT ev THEN 'checked_no_authoritative_result' WHEN tier AND matched THEN 'verified' ELSE 'verification_pending' END
  ELSE verification_state END AS next_state
FROM (SELECT c.claim_id, c.verification_state, c.field_key, s.baseline_status <> 'discovered' AS matched, l.claim_id IS NOT NULL AS ev, coalesce(l.contra, false) AS contra, s.branch = 'executive' AS tier
  FROM fx_claims c JOIN fx_seats s ON s.seat_id = c.subject_id LEFT JOIN (SELECT claim_id, bool_or(role = 'contradicts') AS contra FROM fx_claim_evidence GROUP BY claim_id) l ON l.claim_id = c.claim_id)""")
def claim_next_state(t):
    c = t.claims.join(t.seats.select(F.col("seat_id").alias("subject_id"), "baseline_status", "branch"), "subject_id").join(flags(t), "claim_id", "left")
    no = F.lit(False)
    nxt = ladders.next_claim_state(F.col("verification_state"), F.col("field_key"), F.col("baseline_status") != "discovered", F.coalesce("has_evidence", no), F.coalesce("has_contradiction", no), no, F.col("branch") == "executive", F.lit(True))
    return c.select("claim_id", "verification_state", "field_key", nxt.alias("next_state")).distinct()


@query("""
SELECT s.seat_id, f.field_key, coalesce(j.done, false) AS covered, coalesce(j.n, 0) AS jobs FROM fx_seats s CROSS JOIN fx_contract_fields f
LEFT JOIN (SELECT job_id, CAST(job_id % 12 AS INT) AS field_id, bool_or(status = 'succeeded') AS done, count(*) AS n FROM fx_jobs GROUP BY ALL) j ON j.job_id = s.seat_id AND j.field_id = f.field_id""")
def scope_coverage(t):
    j = t.jobs.groupBy(F.col("job_id").alias("seat_id"), (F.col("job_id") % 12).cast("int").alias("field_id")).agg(F.bool_or(F.col("status") == "succeeded").alias("done"), F.count(F.lit(1)).alias("n"))
    return t.seats.select("seat_id").crossJoin(F.broadcast(t.contract_fields)).join(j, ["seat_id", "field_id"], "left").select("seat_id", "field_key", F.coalesce("done", F.lit(False)).alias("covered"), F.coalesce("n", F.lit(0)).alias("jobs"))


@query("""
SELECT s.seat_id, f.field_key AS section, CASE WHEN h.subject_id IS NOT NULL THEN 'canonical' WHEN f.required_for_baseline THEN 'queued' ELSE 'deferred' END AS status
FROM fx_seats s CROSS JOIN fx_contract_fields f LEFT JOIN (SELECT DISTINCT subject_id, field_key FROM fx_claims WHERE verification_state = 'verified') h ON h.subject_id = s.seat_id AND h.field_key = f.field_key""")
def research_queue(t):
    have = t.claims.where("verification_state = 'verified'").select(F.col("subject_id").alias("seat_id"), "field_key", F.lit(True).alias("have")).distinct()
    q = t.seats.select("seat_id").crossJoin(F.broadcast(t.contract_fields)).join(have, ["seat_id", "field_key"], "left")
    return q.select("seat_id", F.col("field_key").alias("section"), F.when(F.col("have"), "canonical").when(F.col("required_for_baseline"), "queued").otherwise("deferred").alias("status"))


@query("""
WITH q AS (SELECT s.seat_id, h.subject_id IS NOT NULL AS done FROM fx_seats s CROSS JOIN fx_contract_fields f LEFT JOIN (SELECT DISTINCT subject_id, field_key FROM fx_claims WHERE verification_state = 'verified') h ON h.subject_id = s.seat_id AND h.field_key = f.field_key WHERE f.required_for_baseline AND f.field_key <> 'monitoring')
SELECT count(*) AS tasks, CAST(sum(CASE WHEN all_done THEN 1 ELSE 0 END) AS BIGINT) AS complete_tasks, CAST(sum(sections) AS BIGINT) AS sections, CAST(sum(n_done) AS BIGINT) AS canonical_sections FROM (SELECT seat_id, bool_and(done) AS all_done, count(*) AS sections, count(*) FILTER (WHERE done) AS n_done FROM q GROUP BY seat_id)""")
def queue_summary(t):
    have = t.claims.where("verification_state = 'verified'").select(F.col("subject_id").alias("seat_id"), "field_key", F.lit(True).alias("have")).distinct()
    fields = t.contract_fields.where("required_for_baseline AND field_key <> 'monitoring'").select("field_key")
    q = t.seats.select("seat_id").crossJoin(F.broadcast(fields)).join(have, ["seat_id", "field_key"], "left").withColumn("done", F.coalesce("have", F.lit(False)))
    per = q.groupBy("seat_id").agg(F.bool_and("done").alias("all_done"), F.count(F.lit(1)).alias("sections"), F.count_if("done").alias("n_done"))
    return per.agg(F.count(F.lit(1)).alias("tasks"), F.count_if("all_done").alias("complete_tasks"), F.sum("sections").alias("sections"), F.sum("n_done").alias("canonical_sections"))


@query("""
SELECT DISTINCT l.claim_id, l.evidence_id, CASE WHEN e.evidence_id IS NULL THEN 'missing_evidence' WHEN e.content_hash <> md5(d.text || CASE WHEN e.evidence_id % 10 = 0 THEN 'x' ELSE '' END) THEN 'hash_mismatch' END AS violation
FROM fx_claim_evidence l LEFT JOIN fx_evidence e ON e.evidence_id = l.evidence_id LEFT JOIN documents d ON d.doc_id = l.evidence_id
WHERE e.evidence_id IS NULL OR e.content_hash <> md5(d.text || CASE WHEN e.evidence_id % 10 = 0 THEN 'x' ELSE '' END)""")
def lineage_violations(t):
    # Every tenth document reads as changed since its evidence was taken.
    now = t.documents.select(F.col("doc_id").alias("evidence_id"), F.md5(F.concat("text", F.when(F.col("doc_id") % 10 == 0, "x").otherwise("")).cast("binary")).alias("now"))
    l = t.claim_evidence.join(t.evidence.select("evidence_id", "content_hash"), "evidence_id", "left").join(now, "evidence_id", "left")
    why = F.when(F.col("content_hash").isNull(), "missing_evidence").when(F.col("content_hash") != F.col("now"), "hash_mismatch")
    return l.select("claim_id", "evidence_id", why.alias("violation")).where("violation IS NOT NULL").distinct()


@query("""
WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7 + l_orderkey) % (n + n // 10) AS evidence_id FROM lineitem, n) SELECT r.* FROM r LEFT JOIN documents d ON d.doc_id = r.evidence_id WHERE d.doc_id IS NULL""")
def orphan_references(t):
    """References of the line items' claims to documents that are not there."""
    n = t.documents.count()
    refs = t.lineitem.select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % (n + n // 10)).alias("evidence_id"))
    return quality.orphans(refs, "evidence_id", t.documents, "doc_id").select("l_orderkey", "l_linenumber", "evidence_id")


@query("""
WITH a AS (SELECT subject_id, field_key, max(coalesce(normalized_value, '')) AS v, CAST(count(*) AS STRING) AS n FROM fx_claims WHERE valid_from <= DATE '1996-01-01' AND (valid_to IS NULL OR valid_to > DATE '1996-01-01') GROUP BY ALL),
b AS (SELECT subject_id, field_key, max(coalesce(normalized_value, '')) AS v, CAST(count(*) AS STRING) AS n FROM fx_claims WHERE valid_from <= DATE '1998-01-01' AND (valid_to IS NULL OR valid_to > DATE '1998-01-01') GROUP BY ALL),
j AS (SELECT coalesce(a.subject_id, b.subject_id) AS subject_id, coalesce(a.field_key, b.field_key) AS field_key, CASE WHEN a.subject_id IS NULL THEN 'created' WHEN b.subject_id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS av, b.v AS bv, a.n AS an, b.n AS bn FROM a FULL JOIN b ON b.subject_id = a.subject_id AND b.field_key = a.field_key)
SELECT subject_id, field_key, change, 'v' AS field, av AS old_value, bv AS new_value FROM j WHERE av IS DISTINCT FROM bv UNION ALL SELECT subject_id, field_key, change, 'n', an, bn FROM j WHERE an IS DISTINCT FROM bn""")
def snapshot_diff(t):
    at = lambda day: relational.valid_at(t.claims, F.to_date(F.lit(day))).groupBy("subject_id", "field_key").agg(F.max(F.coalesce("normalized_value", F.lit(""))).alias("v"), F.count(F.lit(1)).alias("n"))
    return relational.full_diff(at("1996-01-01"), at("1998-01-01"), ["subject_id", "field_key"], ["v", "n"])
