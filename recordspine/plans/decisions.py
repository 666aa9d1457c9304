"""Decisions with their reasons: steps of claims, contract fields, sources of a policy, counts of a collector."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspine.functions import ladders
from recordspine.operators import quality, relational
from recordspine.plans.claims import EVALUATED, IMPLEMENTED, flags
from recordspine.plans.registry import query

STEP_STATE = "CASE WHEN verification_state = 'collected_unreviewed' AND day(valid_from) % 2 = 0 THEN 'extracted' WHEN verification_state = 'stale' AND day(valid_from) % 3 = 0 THEN 'entity_match_pending' WHEN verification_state = 'stale' AND day(valid_from) % 3 = 1 THEN 'evidence_pending' ELSE verification_state END"
STEP_VALUE = "CASE WHEN normalized_value IS NULL THEN NULL WHEN month(valid_from) % 4 = 0 THEN 'https://www.senate.gov/' || normalized_value WHEN month(valid_from) % 4 = 1 THEN 'http://www.senate.gov/' || normalized_value WHEN month(valid_from) % 4 = 2 THEN 'https://images.google.com/' || normalized_value ELSE 'https://example.org/' || normalized_value END"
STEP_TIER = "CASE subject_id % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'secondary' ELSE 'TIER_1_PRIMARY_OFFICIAL' END"


@query(f"""
WITH c AS (SELECT c.claim_id, c.field_key, {STEP_STATE} AS state, {STEP_VALUE} AS v, subject_id % 3 <> 1 AS primary_tier, subject_id % 5 <> 0 AS certified, s.baseline_status <> 'discovered' AS matched FROM fx_claims c JOIN fx_seats s ON s.seat_id = c.subject_id),
e AS (SELECT claim_id, bool_or(role = 'contradicts') AS contra FROM fx_claim_evidence GROUP BY claim_id),
a AS (SELECT c.*, e.claim_id IS NOT NULL AS ev, coalesce(e.contra, false) AS contra, CASE WHEN v IS NULL THEN 'invalid_url' WHEN starts_with(v, 'http:') THEN 'insecure_url' WHEN contains(v, 'google.com') THEN 'search_engine_image_rejected' WHEN contains(v, 'senate.gov') THEN 'official_gov_host' ELSE 'not_official_gov_host' END AS address FROM c LEFT JOIN e ON e.claim_id = c.claim_id),
r AS (SELECT *, CASE WHEN state = 'collected_unreviewed' THEN 'payload_extracted' WHEN state = 'extracted' THEN 'ready_for_entity_match' WHEN state = 'entity_match_pending' THEN CASE WHEN matched THEN 'entities_matched' ELSE 'entity_match_pending' END
  WHEN state = 'evidence_pending' THEN CASE WHEN ev THEN 'evidence_present_unreviewed' ELSE 'evidence_missing' END WHEN state <> 'verification_pending' THEN 'no_change' WHEN contra THEN 'contradiction_open'
  WHEN field_key = 'portrait' THEN CASE WHEN address = 'official_gov_host' THEN 'portrait_gov_host_still_requires_review' ELSE address END WHEN NOT ev THEN 'no_authoritative_evidence' WHEN primary_tier AND certified AND matched THEN 'tier1_schema_unique_evidence' ELSE 'evidence_backed_not_auto_verified' END AS reason FROM a)
SELECT DISTINCT claim_id, state, CASE reason WHEN 'payload_extracted' THEN 'extracted' WHEN 'ready_for_entity_match' THEN 'entity_match_pending' WHEN 'entities_matched' THEN 'evidence_pending' WHEN 'evidence_present_unreviewed' THEN 'verification_pending' WHEN 'contradiction_open' THEN 'conflict'
  WHEN 'no_authoritative_evidence' THEN 'checked_no_authoritative_result' WHEN 'tier1_schema_unique_evidence' THEN 'verified' WHEN 'invalid_url' THEN 'rejected' WHEN 'insecure_url' THEN 'rejected' WHEN 'search_engine_image_rejected' THEN 'rejected' WHEN 'not_official_gov_host' THEN 'rejected' ELSE state END AS next_state, reason FROM r""")
def claim_transition(t):
    """One step of each claim's state machine with its reason; a portrait's address decides, a secondary source never verifies alone."""
    c = t.claims.select("claim_id", "subject_id", "field_key", F.expr(STEP_STATE).alias("state"), F.expr(STEP_VALUE).alias("value"), ladders.authority_tier(F.expr(STEP_TIER)).alias("tier"), (F.col("subject_id") % 5 != 0).alias("certified"))
    c = c.join(t.seats.select(F.col("seat_id").alias("subject_id"), (F.col("baseline_status") != "discovered").alias("matched")), "subject_id").join(flags(t), "claim_id", "left")
    no = F.lit(False)
    step = ladders.claim_step(F.col("state"), F.col("field_key"), F.col("value"), F.col("matched"), F.coalesce("has_evidence", no), F.coalesce("has_contradiction", no), F.col("tier"), F.col("certified"))
    return c.withColumn("s", step).select("claim_id", "state", F.col("s.to").alias("next_state"), F.col("s.reason").alias("reason")).distinct()


ENUMERABLE = ("election_history", "campaign_finance", "financial_disclosure")
OPEN_ENDED = ("biography", "promises_statements")
listed = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(f"""
WITH m AS (SELECT subject_id AS seat_id, field_key, count(*) FILTER (WHERE coalesce(normalized_value, '') = '') AS missing FROM fx_claims GROUP BY ALL),
e AS (SELECT r.seat_id, r.field_key, r.category, r.verification_state AS state, r.presence, coalesce(m.missing, 0) AS missing,
  CASE WHEN r.action = 'none' AND r.presence = 'PRESENT' AND r.field_key IN ({listed(ENUMERABLE)}) AND r.category IN ({listed([*IMPLEMENTED, 'finance'])}) AND coalesce(m.missing, 0) > 0 THEN 'dataset_unit' WHEN r.action = 'close_not_implemented' AND r.category = 'finance' THEN 'collect' ELSE r.action END AS action
  FROM ({EVALUATED}) r LEFT JOIN m ON m.seat_id = r.seat_id AND m.field_key = r.field_key)
SELECT seat_id, field_key, presence, action, CASE WHEN action = 'contradiction' THEN 'unresolved contradiction on ' || field_key WHEN action = 'refresh' THEN 'claim is stale and requires refresh' WHEN presence = 'CHECKED_NO_AUTHORITATIVE_RESULT' THEN 'checked; no authoritative result'
  WHEN action = 'verify' THEN 'value present but evidence is insufficient for a material claim' WHEN action = 'dataset_unit' THEN 'enumerable dataset incomplete; missing ' || CAST(missing AS STRING) || ' units'
  WHEN action = 'close_not_implemented' THEN 'NULL is not complete; capability ' || category || ' is NOT_IMPLEMENTED' WHEN action = 'collect' AND state IS NULL THEN 'required field ' || field_key || ' has no claim; NULL is not complete' WHEN action = 'collect' THEN 'required field ' || field_key || ' is ' || state || '; NULL/empty is not complete'
  WHEN field_key IN ({listed(OPEN_ENDED)}) THEN 'coverage_complete_for_defined_scope (never everything_on_the_internet_complete)' WHEN state IS NOT NULL THEN 'field contains information in state ' || state ELSE 'structural entity present' END AS explanation FROM e""")
def field_explanations(t):
    """Contract fields with action and explanation; a dataset whose claims hold empty values lacks that many units."""
    c = t.claims.select("claim_id", F.col("subject_id").alias("seat_id"), "field_key", "normalized_value", "verification_state")
    one = relational.latest(c, ["seat_id", "field_key"], [F.col("claim_id"), F.col("verification_state"), F.col("normalized_value")])
    missing = c.groupBy("seat_id", "field_key").agg(F.count_if(F.coalesce("normalized_value", F.lit("")) == "").alias("missing"))
    rows = t.seats.select("seat_id", "monitoring_active").crossJoin(F.broadcast(t.contract_fields)).join(one, ["seat_id", "field_key"], "left").join(missing, ["seat_id", "field_key"], "left").join(flags(t), "claim_id", "left")  # twelve fields
    no, none, state, value = F.lit(False), F.lit(None).cast("string"), F.col("verification_state"), F.col("normalized_value")
    lacks, opened = F.coalesce("missing", F.lit(0)), F.col("field_key").isin(*OPEN_ENDED)
    structural = (F.col("field_key") == "monitoring") & F.col("monitoring_active")
    rows = rows.withColumn("e", ladders.field_evaluation(
        F.col("field_key"), F.col("required_for_baseline"), opened, F.col("category").isin(*IMPLEMENTED, "finance"), state, ladders.has_value(value, none), structural, F.coalesce("has_evidence", no), F.coalesce("has_contradiction", no),
        ladders.claim_presence(state, value, none), F.col("field_key").isin(*ENUMERABLE), lacks > 0))
    why = ladders.field_explanation(F.col("e.action"), F.col("e.presence"), F.col("field_key"), state, F.col("category"), opened, lacks)
    return rows.select("seat_id", "field_key", "e.presence", "e.action", why.alias("explanation"))


SOURCES = """SELECT concat('src-', CAST(c_custkey % 40 AS STRING)) AS source_key, min(c_custkey) % 5 > 0 AS active, CASE WHEN sum(c_nationkey) % 4 = 0 THEN concat('http://h', CAST(c_custkey % 40 AS STRING), '.gov/') WHEN sum(c_nationkey) % 7 = 0 THEN concat('https://user@h', CAST(c_custkey % 40 AS STRING), '.gov/') ELSE concat('https://h', CAST(c_custkey % 40 AS STRING), '.gov/') END AS source_url,
  CASE WHEN sum(c_nationkey) % 3 = 0 THEN 'specialist_database' ELSE 'TIER_1_PRIMARY_OFFICIAL' END AS authority_tier FROM customer GROUP BY c_custkey % 40"""
POLICIES = "SELECT s_suppkey AS seat_id, CASE WHEN s_suppkey % 11 > 0 THEN concat('src-', CAST(s_suppkey * 7 % 45 AS STRING), ' , src-', CAST(s_suppkey * 3 % 40 AS STRING), ',src-', CAST(s_suppkey % 41 AS STRING)) END AS policy FROM supplier"


@query(f"""
WITH s AS ({SOURCES}), ok AS (SELECT source_key FROM s WHERE active AND regexp_matches(source_url, '^https://[^@/]+/') AND authority_tier = 'TIER_1_PRIMARY_OFFICIAL'), p AS ({POLICIES}),
k AS (SELECT seat_id, trim(unnest(string_split(policy, ','))) AS source_key, generate_subscripts(string_split(policy, ','), 1) AS pos FROM p), f AS (SELECT k.seat_id, min_by(k.source_key, k.pos) AS source_key, CAST(min(k.pos) AS INT) AS position FROM k JOIN ok ON ok.source_key = k.source_key GROUP BY k.seat_id)
SELECT p.seat_id, f.source_key, f.position, CASE WHEN f.seat_id IS NULL THEN 'BLOCKED' ELSE 'ROUTED' END AS state, CASE WHEN p.policy IS NULL THEN 'SOURCE_POLICY_UNSUPPORTED' WHEN f.seat_id IS NULL THEN 'NO_APPROVED_AUTHORITATIVE_SOURCE' END AS reason FROM p LEFT JOIN f ON f.seat_id = p.seat_id""")
def source_policy_route(t):
    """The first source of each policy's ordered list that is active, primary and at a plain https address."""
    s = t.spark.sql(SOURCES.replace("FROM customer", "FROM {customer}"), customer=t.customer)
    usable = F.col("active") & F.col("source_url").rlike("^https://[^@/]+/") & ladders.is_government_primary(ladders.authority_tier(F.col("authority_tier")))
    p = t.spark.sql(POLICIES.replace("FROM supplier", "FROM {supplier}"), supplier=t.supplier)
    named = p.select("seat_id", F.posexplode(F.split("policy", ",")).alias("pos", "key")).select("seat_id", (F.col("pos") + 1).alias("pos"), F.trim("key").alias("source_key"))
    first = named.join(s.where(usable).select("source_key"), "source_key").groupBy("seat_id").agg(F.min_by("source_key", "pos").alias("source_key"), F.min("pos").alias("position"))
    routed = F.col("position").isNotNull()
    return p.join(first, "seat_id", "left").select("seat_id", "source_key", "position", F.when(routed, "ROUTED").otherwise("BLOCKED").alias("state"), F.when(F.col("policy").isNull(), "SOURCE_POLICY_UNSUPPORTED").when(~routed, "NO_APPROVED_AUTHORITATIVE_SOURCE").alias("reason"))


MANIFEST = "SELECT n_nationkey AS collector, n_nationkey % 3 * 2 AS expected_minimum, n_nationkey % 3 * 2 + 3 + n_nationkey % 5 * 20 AS expected_maximum FROM nation"
COUNTED = f"SELECT m.*, count(s.s_suppkey) AS n FROM ({MANIFEST}) m LEFT JOIN supplier s ON s.s_nationkey = m.collector GROUP BY ALL"


def manifest(t):
    return t.spark.sql(MANIFEST.replace("FROM nation", "FROM {nation}"), nation=t.nation)


@query(f"""SELECT collector, n, CASE WHEN n < expected_minimum OR n > expected_maximum THEN 'rejected' ELSE 'success' END AS status,
  CASE WHEN n < expected_minimum OR n > expected_maximum THEN concat('wrote ', CAST(n AS STRING), ' records; expected ', CAST(expected_minimum AS STRING), '-', CAST(expected_maximum AS STRING)) END AS message FROM ({COUNTED})""")
def collector_counts(t):
    """Each collector's records against its manifest; a count outside of the bounds rejects the run."""
    return quality.count_gate(manifest(t), t.supplier.select(F.col("s_nationkey").alias("collector")), "collector").select("collector", "n", "status", "message")


@query(f"SELECT s.s_suppkey AS record_id, s.s_nationkey AS collector FROM supplier s JOIN ({COUNTED}) c ON c.collector = s.s_nationkey WHERE c.n BETWEEN c.expected_minimum AND c.expected_maximum")
def accepted_records(t):
    """Records of collectors whose count keeps to the manifest; all of a rejected collector's wait."""
    records = t.supplier.select(F.col("s_suppkey").alias("record_id"), F.col("s_nationkey").alias("collector"))
    good = quality.count_gate(manifest(t), records, "collector").where("status = 'success'").select("collector")
    return records.join(good, "collector", "left_semi").select("record_id", "collector")
