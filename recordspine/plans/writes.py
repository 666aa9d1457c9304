"""Keyed writes: identities, terms, winners, incidents, coverage and seats as they stand after a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspine.functions import vocabularies as v
from recordspine.operators import identity, relational, terms
from recordspine.plans.records import rows_of
from recordspine.plans.registry import query

NAME = "concat(CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'Pat ' WHEN 1 THEN 'PÁT  ' WHEN 2 THEN ' pat.' ELSE '“Pat” ' END, CAST(c_custkey % 300 AS STRING))"
PEOPLE = f"""SELECT c_custkey AS person_id, {NAME} AS canonical_name, CASE WHEN c_custkey % 3 = 0 THEN concat('B', CAST(c_custkey % 900 AS STRING)) END AS bioguide,
  CASE WHEN c_custkey % 4 = 0 THEN concat('w', CAST(c_custkey % 500 AS STRING), ' ') WHEN c_custkey % 4 = 2 THEN ' ' END AS wikidata FROM customer"""
CANDIDATES = f"""SELECT c_custkey AS candidate_id, {NAME.replace("c_custkey % 300", "(c_custkey - 1) % 300")} AS canonical_name, CASE WHEN c_custkey % 3 = 0 THEN concat(' b', CAST(c_custkey % 900 AS STRING)) END AS bioguide, CASE WHEN c_custkey % 5 = 0 THEN concat('W', CAST((c_custkey - 1) % 500 AS STRING)) WHEN c_custkey % 5 = 1 THEN '  ' END AS wikidata,
  CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 END AS given_id, CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 7 + 1 END AS seat_id, CASE WHEN c_custkey % 4 = 1 THEN concat('n-', CAST(c_custkey % 25 AS STRING)) END AS jurisdiction_id FROM customer WHERE c_custkey % 2 = 1"""
IDS = ["bioguide", "wikidata"]

CASCADE = f"""
WITH n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(strip_accents(canonical_name)), '["“”'']', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name, lower(trim(bioguide)) AS b, nullif(lower(trim(wikidata)), '') AS w FROM ({PEOPLE}) WHERE person_id % 2 = 0),
c AS (SELECT *, trim(regexp_replace(regexp_replace(lower(strip_accents(canonical_name)), '["“”'']', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name, lower(trim(bioguide)) AS b, nullif(lower(trim(wikidata)), '') AS w FROM ({CANDIDATES})),
held AS (SELECT DISTINCT o.seat_id, o.person_id, n.name, s.jurisdiction_id FROM fx_occupancies o JOIN n ON n.person_id = o.person_id JOIN fx_seats s ON s.seat_id = o.seat_id),
ext AS (SELECT c.candidate_id, min(n.person_id) AS hit FROM c JOIN n ON n.b = c.b OR n.w = c.w GROUP BY c.candidate_id),
seat AS (SELECT c.candidate_id, min(h.person_id) AS hit FROM c JOIN held h ON h.seat_id = c.seat_id AND h.name = c.name GROUP BY c.candidate_id HAVING count(DISTINCT h.person_id) = 1),
area AS (SELECT c.candidate_id, min(h.person_id) AS hit FROM c JOIN held h ON h.jurisdiction_id = c.jurisdiction_id AND h.name = c.name GROUP BY c.candidate_id HAVING count(DISTINCT h.person_id) = 1),
same AS (SELECT name, count(*) AS n FROM n GROUP BY name),
r AS (SELECT c.*, CASE WHEN given_id IS NOT NULL THEN g.person_id ELSE coalesce(ext.hit, seat.hit, area.hit) END AS resolved_id, coalesce(same.n, 0) > 1 AND c.seat_id IS NULL AND c.jurisdiction_id IS NULL AS namesakes
  FROM c LEFT JOIN n g ON g.person_id = c.given_id LEFT JOIN ext ON ext.candidate_id = c.candidate_id LEFT JOIN seat ON seat.candidate_id = c.candidate_id LEFT JOIN area ON area.candidate_id = c.candidate_id LEFT JOIN same ON same.name = c.name)
SELECT candidate_id, canonical_name, b, w, bioguide, wikidata, resolved_id, CASE WHEN resolved_id IS NOT NULL THEN 'matched' WHEN namesakes THEN 'conflict' ELSE 'unmatched' END AS status,
  CASE WHEN resolved_id IS NULL THEN CASE WHEN namesakes THEN 'name_only' ELSE 'none' END WHEN given_id IS NOT NULL THEN 'person_id' WHEN b IS NOT NULL OR w IS NOT NULL THEN 'external_identifier' WHEN seat_id IS NOT NULL THEN 'normalized_name_seat' ELSE 'normalized_name_jurisdiction' END AS method FROM r"""


def resolved(t):
    people = rows_of(t, PEOPLE, "customer").where("person_id % 2 = 0")
    return people, identity.resolve_persons(people, t.occupancies, t.seats, rows_of(t, CANDIDATES, "customer"), IDS)


@query(f"SELECT candidate_id, status, method, resolved_id FROM ({CASCADE})")
def identity_cascade(t):
    """Candidates, whose names and identifiers are spelt in several ways, and the persons that they are."""
    return resolved(t)[1].select("candidate_id", "status", "method", "resolved_id")


@query(f"""
WITH m AS ({CASCADE}), people AS (SELECT * FROM ({PEOPLE}) WHERE person_id % 2 = 0),
k AS (SELECT coalesce(resolved_id, candidate_id) AS person_id, candidate_id, canonical_name, trim(bioguide) AS bioguide, nullif(trim(wikidata), '') AS wikidata FROM m WHERE status <> 'conflict'),
w AS (SELECT person_id, max_by(bioguide, candidate_id) FILTER (WHERE bioguide IS NOT NULL) AS bioguide, max_by(wikidata, candidate_id) FILTER (WHERE wikidata IS NOT NULL) AS wikidata, min_by(canonical_name, candidate_id) AS name, count(*) AS written FROM k GROUP BY 1)
SELECT coalesce(p.person_id, w.person_id) AS person_id, coalesce(p.canonical_name, w.name) AS canonical_name, coalesce(w.bioguide, p.bioguide) AS bioguide, coalesce(w.wikidata, p.wikidata) AS wikidata, coalesce(w.written, 0) AS written FROM people p FULL JOIN w ON w.person_id = p.person_id""")
def person_upsert(t):
    """People after the candidates are written."""
    people, c = resolved(t)
    return identity.upsert_persons(people, c, IDS)


TERMS = """SELECT o_orderkey % 2 AS side, o_orderkey % (SELECT count(*) FROM supplier) AS seat_id, o_custkey % 20 AS person_id, CASE WHEN o_orderkey % 5 > 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS start_date,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderdate AS DATE) END AS end_date, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'current' ELSE 'acting' END AS status FROM orders"""


@query(f"""
WITH x AS ({TERMS}), k AS (SELECT seat_id, person_id, start_date, max(status) FILTER (WHERE side = 0) AS old, max(status) FILTER (WHERE side = 1) AS new, max(end_date) FILTER (WHERE side = 0) AS old_end, max(end_date) FILTER (WHERE side = 1) AS new_end FROM x GROUP BY ALL),
u AS (SELECT seat_id, person_id, start_date, coalesce(new, old) AS status, coalesce(new_end, old_end) AS end_date, old IS NULL AS inserted FROM k),
keep AS (SELECT seat_id, person_id, start_date FROM (SELECT *, row_number() OVER (PARTITION BY seat_id ORDER BY start_date DESC NULLS LAST, person_id DESC) AS r FROM u WHERE status IN ('current', 'acting')) WHERE r = 1),
d AS (SELECT u.*, u.status IN ('current', 'acting') AND keep.seat_id IS NULL AS demoted FROM u LEFT JOIN keep ON keep.seat_id = u.seat_id AND keep.person_id = u.person_id AND keep.start_date IS NOT DISTINCT FROM u.start_date)
SELECT seat_id, person_id, start_date, CASE WHEN demoted THEN coalesce(end_date, DATE '1998-08-02') ELSE end_date END AS end_date, CASE WHEN demoted THEN 'completed' ELSE status END AS status, demoted, inserted FROM d""")
def term_upsert(t):
    """Terms after a batch: of a seat's running terms the latest stays, the others end."""
    x = rows_of(t, TERMS, "supplier", "orders")
    return terms.upsert_terms(x.where("side = 0").drop("side"), x.where("side = 1").drop("side"), F.to_date(F.lit("1998-08-02")))


CAMPAIGNS = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS election, o_orderkey % (SELECT count(*) FROM supplier) AS seat_id, o_custkey AS person_id, CASE WHEN o_orderkey % 6 = 0 THEN 'withdrawn' ELSE 'filed' END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS votes FROM orders"""


@query(f"""
WITH c AS (SELECT election, seat_id, person_id, max(status) AS status, max(votes) AS votes FROM ({CAMPAIGNS}) GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY election, seat_id ORDER BY votes DESC, person_id) AS r FROM c WHERE status <> 'withdrawn')
SELECT seat_id, person_id, election, election + 30 AS start_date, 'current' AS occupancy_status, 'elected' AS how, 'pending' AS evidence_state FROM w WHERE r = 1""")
def winner_occupancies(t):
    """One campaign for each election, seat and person, withdrawal included; the winner's term waits for evidence."""
    c = t.spark.sql(CAMPAIGNS.replace("FROM supplier", "FROM {supplier}").replace("FROM orders", "FROM {orders}"), supplier=t.supplier, orders=t.orders)
    one = c.groupBy("election", "seat_id", "person_id").agg(F.max("status").alias("status"), F.max("votes").alias("votes")).where("status <> 'withdrawn'")
    won = one.groupBy("election", "seat_id").agg(F.max(F.struct("votes", (-F.col("person_id")).alias("first"))).alias("w"))
    state = {"occupancy_status": "current", "how": "elected", "evidence_state": "pending"}
    return won.select("seat_id", (-F.col("w.first")).alias("person_id"), "election", F.date_add("election", 30).alias("start_date"), *(F.lit(x).alias(k) for k, x in state.items()))


@query("""
WITH o AS (SELECT started_at, 'run:' || CAST(job_id AS STRING) || ':' || sha256('{"capability": "' || capability || '", "records_read": ' || CAST(records_read AS STRING) || '}') AS incident_key FROM fx_worker_runs WHERE status = 'failed')
SELECT incident_key, min(started_at) AS first_observed_at, max(started_at) AS last_observed_at, count(*) AS observations FROM o GROUP BY incident_key""")
def incident_register(t):
    """Incidents by what was observed: changed facts make a new one, equal facts move its last time."""
    seen = F.concat(F.lit('{"capability": "'), F.col("capability"), F.lit('", "records_read": '), F.col("records_read").cast("string"), F.lit("}"))
    key = F.concat_ws(":", F.lit("run"), F.col("job_id").cast("string"), F.sha2(seen, 256))
    o = t.worker_runs.where("status = 'failed'").select(key.alias("incident_key"), "started_at")
    return o.groupBy("incident_key").agg(F.min("started_at").alias("first_observed_at"), F.max("started_at").alias("last_observed_at"), F.count(F.lit(1)).alias("observations"))


FINITE = ("election_history", "campaign_finance", "financial_disclosure", "executive_actions", "prior_offices")


# What is on record: an audit for each seat and field that an order has touched, governors' or not.
RECORDED = """SELECT DISTINCT o_custkey % 60 AS seat_id, CAST(o_orderkey % 12 AS INT) AS field_id, o_custkey % 3 > 0 AS audited FROM orders WHERE o_custkey % 2 = 0"""


@query(f"""
WITH r AS (SELECT seat_id, f.field_key AS scope_key, bool_or(audited) AS audited FROM ({RECORDED}) x JOIN fx_contract_fields f ON f.field_id = x.field_id GROUP BY ALL),
j AS (SELECT (job_id - job_id % 5) % 50 AS seat_id, f.field_key AS scope_key, bool_or(status IN ('leased', 'running', 'succeeded')) AS going FROM fx_jobs JOIN fx_contract_fields f ON f.field_id = job_id % 12 GROUP BY ALL),
n AS (SELECT s.seat_id, f.field_key AS scope_key, coalesce(j.going, false) AS going FROM fx_seats s CROSS JOIN fx_contract_fields f LEFT JOIN j ON j.seat_id = s.seat_id AND j.scope_key = f.field_key WHERE s.office_type = 'governor')
SELECT coalesce(n.seat_id, r.seat_id) AS seat_id, coalesce(n.scope_key, r.scope_key) AS scope_key, CASE WHEN coalesce(n.scope_key, r.scope_key) IN ({", ".join(f"'{x}'" for x in FINITE)}) THEN 'FINITE' ELSE 'OPEN_ENDED' END AS dataset_kind,
  CASE WHEN going IS NULL THEN 'UNKNOWN' WHEN going THEN 'IN_PROGRESS' ELSE 'CAPABILITY_BLOCKED' END AS coverage_state, CASE WHEN r.audited THEN 'AUDITED' ELSE 'PENDING' END AS audit_state, CASE WHEN NOT going THEN 'CAPABILITY_NOT_IMPLEMENTED_OR_NOT_ROUTED' END AS blocker,
  CASE WHEN going THEN 'COLLECT_THEN_INDEPENDENT_COVERAGE_AUDIT' WHEN NOT going THEN 'IMPLEMENT_COMPATIBLE_CAPABILITY_ROUTE' END AS next_action,
  CASE WHEN going IS NULL THEN 'kept' WHEN r.seat_id IS NULL THEN 'inserted' ELSE 'changed' END AS written FROM n FULL JOIN r ON r.seat_id = n.seat_id AND r.scope_key = n.scope_key""")
def scope_coverage_upsert(t):
    """Coverage on record after each governor's seat and contract field was looked at: an audit that is on record stays, other
    values change, and what this batch has not looked at is kept."""
    fields = t.contract_fields.select("field_id", F.col("field_key").alias("scope_key"))
    kind = F.when(F.col("scope_key").isin(*FINITE), "FINITE").otherwise("OPEN_ENDED").alias("dataset_kind")
    none = F.lit(None).cast("string")
    base = rows_of(t, RECORDED, "orders").join(F.broadcast(fields), "field_id").groupBy("seat_id", "scope_key").agg(F.when(F.bool_or("audited"), "AUDITED").otherwise("PENDING").alias("audit_state"))  # twelve fields
    base = base.select("seat_id", "scope_key", kind, F.lit("UNKNOWN").alias("coverage_state"), "audit_state", none.alias("blocker"), none.alias("next_action"))
    j = t.jobs.select(((F.col("job_id") - F.col("job_id") % 5) % 50).alias("seat_id"), (F.col("job_id") % 12).alias("field_id"), "status").join(F.broadcast(fields), "field_id")
    j = j.groupBy("seat_id", "scope_key").agg(F.bool_or(F.col("status").isin("leased", "running", "succeeded")).alias("going"))
    new = t.seats.where("office_type = 'governor'").select("seat_id").crossJoin(F.broadcast(fields.select("scope_key"))).join(j, ["seat_id", "scope_key"], "left")
    going = F.coalesce("going", F.lit(False))
    new = new.select("seat_id", "scope_key", kind, F.when(going, "IN_PROGRESS").otherwise("CAPABILITY_BLOCKED").alias("coverage_state"), F.lit("PENDING").alias("audit_state"),
                     F.when(~going, "CAPABILITY_NOT_IMPLEMENTED_OR_NOT_ROUTED").alias("blocker"), F.when(going, "COLLECT_THEN_INDEPENDENT_COVERAGE_AUDIT").otherwise("IMPLEMENT_COMPATIBLE_CAPABILITY_ROUTE").alias("next_action"))
    out = relational.upsert(base, new, ["seat_id", "scope_key"], keep=["audit_state"])
    written = F.when(F.col("_in_delta") == 0, "kept").when(F.col("_only_delta") == 1, "inserted").otherwise("changed")
    return out.withColumn("written", written).drop("_in_delta", "_only_delta")


@query(f"""
WITH p AS (SELECT user_id AS job_id, list_value({", ".join(f"'{c}'" for c in v.QUEUE_OF_CAPABILITY)})[user_id % {len(v.QUEUE_OF_CAPABILITY)} + 1] AS capability, CASE WHEN count(*) % 3 = 0 THEN 'DEGRADED' ELSE 'NOT_IMPLEMENTED' END AS state FROM events GROUP BY user_id)
SELECT job_id, capability, CASE WHEN state = 'NOT_IMPLEMENTED' AND capability IN ({", ".join(f"'{c}'" for c in v.READY_CAPABILITIES)}) THEN 'READY' ELSE state END AS state, state = 'NOT_IMPLEMENTED' AND capability IN ({", ".join(f"'{c}'" for c in v.READY_CAPABILITIES)}) AS promoted FROM p""")
def capability_promotion(t):
    """Only what is not implemented becomes ready; every other state stays as it is."""
    names = list(v.QUEUE_OF_CAPABILITY)
    p = t.events.groupBy(F.col("user_id").alias("job_id")).agg(F.when(F.count(F.lit(1)) % 3 == 0, "DEGRADED").otherwise("NOT_IMPLEMENTED").alias("was"))
    p = p.withColumn("capability", F.get(F.array(*map(F.lit, names)), (F.col("job_id") % len(names)).cast("int")))
    promoted = (F.col("was") == "NOT_IMPLEMENTED") & F.col("capability").isin(*v.READY_CAPABILITIES)
    return p.select("job_id", "capability", F.when(promoted, "READY").otherwise(F.col("was")).alias("state"), promoted.alias("promoted"))


UNITS = """SELECT c_custkey AS unit_id, CASE WHEN c_custkey % 13 > 0 THEN concat('k-', CAST(c_custkey % 700 AS STRING)) END AS seat_key, CASE WHEN c_custkey % 3 = 0 THEN 'DONE' ELSE 'UNRESOLVED' END AS review_state, concat('src-', CAST(c_custkey % 4 AS STRING)) AS source_key FROM customer"""


@query(f"""
WITH u AS ({UNITS}), s AS (SELECT concat('k-', CAST(s_suppkey AS STRING)) AS seat_key FROM supplier), f AS (SELECT seat_key, min(unit_id) AS first_unit FROM u WHERE review_state = 'UNRESOLVED' AND seat_key IS NOT NULL GROUP BY seat_key)
SELECT u.unit_id, u.seat_key, CASE WHEN u.review_state <> 'UNRESOLVED' OR u.seat_key IS NULL THEN 'left' WHEN s.seat_key IS NULL AND f.first_unit = u.unit_id THEN 'created' ELSE 'reused' END AS seat_outcome,
  CASE WHEN u.review_state = 'UNRESOLVED' AND u.seat_key IS NOT NULL THEN 'NEEDS_IDENTITY_RESEARCH' ELSE u.review_state END AS review_state,
  CASE WHEN u.review_state = 'UNRESOLVED' AND u.seat_key IS NOT NULL AND list_contains(string_split(replace('src-1, src-2', ' ', ''), ','), u.source_key) THEN 'need:' || CAST(u.unit_id AS STRING) || ':' || u.seat_key END AS need_key
FROM u LEFT JOIN s ON s.seat_key = u.seat_key LEFT JOIN f ON f.seat_key = u.seat_key""")
def roster_units_to_seats(t):
    """Open roster units find their seat or make it, once for each key, and ask for the holder's identity where the contract's
    policy names their source. Units without a key or already done stay."""
    u = t.spark.sql(UNITS.replace("FROM customer", "FROM {customer}"), customer=t.customer)
    goes = (F.col("review_state") == "UNRESOLVED") & F.col("seat_key").isNotNull()
    known = t.supplier.select(F.concat(F.lit("k-"), F.col("s_suppkey").cast("string")).alias("seat_key"), F.lit(True).alias("known"))
    first = u.where(goes).groupBy("seat_key").agg(F.min("unit_id").alias("first_unit"))
    out = u.join(known, "seat_key", "left").join(first, "seat_key", "left")
    outcome = F.when(~goes, "left").when(F.col("known").isNull() & (F.col("first_unit") == F.col("unit_id")), "created").otherwise("reused")
    asks = goes & F.array_contains(F.split(F.lit("src-1, src-2"), r"\s*,\s*"), F.col("source_key"))
    need = F.when(asks, F.concat_ws(":", F.lit("need"), F.col("unit_id").cast("string"), "seat_key"))
    return out.select("unit_id", "seat_key", outcome.alias("seat_outcome"), F.when(goes, "NEEDS_IDENTITY_RESEARCH").otherwise(F.col("review_state")).alias("review_state"), need.alias("need_key"))
