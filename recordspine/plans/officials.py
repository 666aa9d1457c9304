"""Seats, holders, identities and coverage by place."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordspine import functions as fn
from recordspine.functions import ladders
from recordspine.operators import graph, relational
from recordspine.operators.ordering import with_position
from recordspine.plans.registry import query
from recordspine.sources import tables

CURRENT = ("current", "acting")


def projection(t):
    """Current holders of seats with verified identity and evidence: what may be published."""
    o = t.occupancies.where(F.col("occupancy_status").isin(*CURRENT) & F.col("evidence_state").isin("verified", "reviewed", "authoritative"))
    p = t.persons.where(F.col("identity_status").isin("verified", "resolved"))
    s = t.seats.where(F.col("baseline_status") != "discovered")
    return o.join(p, "person_id").join(s, "seat_id").join(t.jurisdictions.select("jurisdiction_id", F.col("name").alias("jurisdiction")), "jurisdiction_id")


PROJECTION = """
SELECT o.occupancy_id, s.seat_id, s.seat_name, s.office_type, s.branch, p.person_id, p.canonical_name, j.name AS jurisdiction, o.occupancy_status, o.start_date
FROM fx_occupancies o JOIN fx_persons p ON p.person_id = o.person_id JOIN fx_seats s ON s.seat_id = o.seat_id JOIN fx_jurisdictions j ON j.jurisdiction_id = s.jurisdiction_id
WHERE o.occupancy_status IN ('current', 'acting') AND o.evidence_state IN ('verified', 'reviewed', 'authoritative') AND p.identity_status IN ('verified', 'resolved') AND s.baseline_status <> 'discovered'"""
COLUMNS = ["occupancy_id", "seat_id", "seat_name", "office_type", "branch", "person_id", "canonical_name", "jurisdiction", "occupancy_status", "start_date"]


@query(PROJECTION)
def public_projection(t):
    return projection(t).select(*COLUMNS)


@query(f"WITH p AS ({PROJECTION}) SELECT occupancy_id, seat_name, canonical_name, (SELECT count(*) FROM p) AS total FROM p ORDER BY canonical_name, occupancy_id LIMIT 100 OFFSET 50")
def projection_page(t):
    return tables.page(projection(t).select("occupancy_id", "seat_name", "canonical_name"), [F.col("canonical_name"), F.col("occupancy_id")], 100, 50)


@query("""
WITH holder AS (
  SELECT seat_id, person_id, start_date FROM (SELECT *, row_number() OVER (PARTITION BY seat_id ORDER BY start_date DESC, occupancy_id) AS r FROM fx_occupancies WHERE occupancy_status IN ('current', 'acting')) WHERE r = 1
), counted AS (SELECT subject_id, count(*) AS n FROM fx_claims WHERE verification_state = 'verified' GROUP BY subject_id)
SELECT s.seat_id, s.seat_name, h.person_id, p.canonical_name, h.start_date, coalesce(c.n, 0) AS verified_claims
FROM fx_seats s LEFT JOIN holder h ON h.seat_id = s.seat_id LEFT JOIN fx_persons p ON p.person_id = h.person_id LEFT JOIN counted c ON c.subject_id = s.seat_id""")
def official_for_seat(t):
    holder = relational.latest(t.occupancies.where(F.col("occupancy_status").isin(*CURRENT)), ["seat_id"], [F.col("start_date").desc(), F.col("occupancy_id")]).select("seat_id", "person_id", "start_date")
    counted = t.claims.where("verification_state = 'verified'").groupBy(F.col("subject_id").alias("seat_id")).agg(F.count(F.lit(1)).alias("n"))
    out = t.seats.join(holder, "seat_id", "left").join(t.persons.select("person_id", "canonical_name"), "person_id", "left").join(counted, "seat_id", "left")
    return out.select("seat_id", "seat_name", "person_id", "canonical_name", "start_date", F.coalesce("n", F.lit(0)).alias("verified_claims"))


@query(f"WITH p AS ({PROJECTION}) SELECT occupancy_id, canonical_name, seat_name FROM p WHERE contains(lower(concat_ws(' ', canonical_name, seat_name, office_type, jurisdiction)), 'person 12') AND branch = 'legislative'")
def directory_search(t):
    text = F.lower(F.concat_ws(" ", "canonical_name", "seat_name", "office_type", "jurisdiction"))
    return projection(t).where(text.contains("person 12") & (F.col("branch") == "legislative")).select("occupancy_id", "canonical_name", "seat_name")


@query(f"""WITH p AS ({PROJECTION}), d AS (SELECT DISTINCT branch, canonical_name, person_id, CASE branch WHEN 'executive' THEN 1 WHEN 'legislative' THEN 2 ELSE 3 END AS level_rank FROM p)
SELECT *, row_number() OVER (PARTITION BY branch ORDER BY canonical_name, person_id) AS position FROM d""")
def directory_order(t):
    rank = F.when(F.col("branch") == "executive", 1).when(F.col("branch") == "legislative", 2).otherwise(3)
    d = projection(t).select("branch", "canonical_name", "person_id").distinct().withColumn("level_rank", rank)
    return with_position(d, [F.col("canonical_name").asc(), F.col("person_id").asc()], within=["branch"])


@query("SELECT seat_id, count(*) AS n, min(occupancy_id) AS first_occupancy, max(occupancy_id) AS last_occupancy FROM fx_occupancies WHERE occupancy_status IN ('current', 'acting') GROUP BY seat_id HAVING count(*) > 1")
def one_current_per_seat(t):
    o = t.occupancies.where(F.col("occupancy_status").isin(*CURRENT))
    return o.groupBy("seat_id").agg(F.count(F.lit(1)).alias("n"), F.min("occupancy_id").alias("first_occupancy"), F.max("occupancy_id").alias("last_occupancy")).where("n > 1")


@query("""
WITH c AS (SELECT *, lead(start_date) OVER (PARTITION BY seat_id ORDER BY start_date, occupancy_id) AS next_start FROM fx_occupancies WHERE occupancy_status IN ('current', 'acting'))
SELECT occupancy_id, seat_id, person_id, start_date, next_start AS end_date, CASE WHEN next_start IS NULL THEN occupancy_status ELSE 'completed' END AS occupancy_status FROM c""")
def occupancy_timeline(t):
    w = Window.partitionBy("seat_id").orderBy("start_date", "occupancy_id")
    o = t.occupancies.where(F.col("occupancy_status").isin(*CURRENT)).withColumn("end_date", F.lead("start_date").over(w))
    return o.select("occupancy_id", "seat_id", "person_id", "start_date", "end_date", F.when(F.col("end_date").isNull(), F.col("occupancy_status")).otherwise("completed").alias("occupancy_status"))


RAW_STATUS = "CASE o_orderkey % 10 WHEN 0 THEN 'former' WHEN 1 THEN 'occupied' WHEN 2 THEN 'unknown' WHEN 3 THEN 'upcoming' WHEN 4 THEN 'vacant' WHEN 5 THEN 'disputed' WHEN 6 THEN 'pending' WHEN 7 THEN 'current' WHEN 8 THEN 'acting' END"


@query(f"""
SELECT occupancy_id, raw, vacant, CASE WHEN raw = 'former' THEN 'completed' WHEN raw IN ('occupied', 'unknown') THEN CASE WHEN vacant THEN 'vacant' ELSE 'current' END
  WHEN raw IN ('current', 'upcoming', 'completed', 'vacant', 'acting', 'disputed') THEN raw WHEN vacant THEN 'completed' ELSE 'current' END AS stored,
  CASE WHEN raw = 'acting' THEN 'acting' WHEN vacant THEN 'vacant' ELSE 'occupied' END AS seat_status
FROM (SELECT o_orderkey AS occupancy_id, {RAW_STATUS} AS raw, o_custkey % 2 = 0 AS vacant FROM orders)""")
def occupancy_status_stored(t):
    """What a collected term is stored as, in the term's table and in the seat's."""
    o = t.orders.select(F.col("o_orderkey").alias("occupancy_id"), F.expr(RAW_STATUS).alias("raw"), (F.col("o_custkey") % 2 == 0).alias("vacant"))
    acting = F.coalesce(F.col("raw") == "acting", F.lit(False))
    return o.withColumns({"stored": ladders.occupancy_row_status(F.col("raw"), F.col("vacant")), "seat_status": ladders.seat_table_status(~F.col("vacant"), acting)})


@query("""
SELECT j.jurisdiction_id, j.parent_jurisdiction_id AS ancestor, 1 AS distance, p.name AS ancestor_name
FROM fx_jurisdictions j JOIN fx_jurisdictions p ON p.jurisdiction_id = j.parent_jurisdiction_id""")
def jurisdiction_tree(t):
    j = t.jurisdictions
    up = graph.ancestors(j, "jurisdiction_id", "parent_jurisdiction_id")
    return up.join(j.select(F.col("jurisdiction_id").alias("ancestor"), F.col("name").alias("ancestor_name")), "ancestor").select("jurisdiction_id", "ancestor", "distance", "ancestor_name")


@query("""
SELECT canonical_name, count(*) AS candidates, CASE WHEN count(*) = 1 THEN 'matched' WHEN count(*) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN count(*) = 1 THEN min(person_id) END AS person_id
FROM fx_persons GROUP BY canonical_name""")
def match_cardinality(t):
    n = F.count(F.lit(1))
    return t.persons.groupBy("canonical_name").agg(n.alias("candidates"), F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unmatched").alias("status"), F.when(n == 1, F.min("person_id")).alias("person_id"))


@query("""
WITH base AS (SELECT * FROM fx_persons WHERE person_id % 2 = 0), delta AS (SELECT * FROM fx_persons WHERE person_id % 2 = 1),
i AS (SELECT bioguide, count(*) AS n, min(person_id) AS p FROM base WHERE bioguide IS NOT NULL GROUP BY bioguide),
m AS (SELECT canonical_name, party, count(*) AS n, min(person_id) AS p FROM base GROUP BY canonical_name, party),
r AS (SELECT d.person_id, i.n AS ni, i.p AS pi, m.n AS nm, m.p AS pm FROM delta d LEFT JOIN i ON i.bioguide = d.bioguide LEFT JOIN m ON m.canonical_name = d.canonical_name AND m.party = d.party),
h AS (SELECT *, CASE WHEN ni = 1 THEN 'external_id' WHEN ni > 1 THEN 'conflict' WHEN nm = 1 THEN 'name_in_scope' WHEN nm > 1 THEN 'conflict' ELSE 'new' END AS method FROM r)
SELECT person_id, method, CASE method WHEN 'external_id' THEN pi WHEN 'name_in_scope' THEN pm END AS resolved_id FROM h""")
def resolve_identity(t):
    p = t.persons
    delta = p.where("person_id % 2 = 1").withColumnRenamed("person_id", "delta_id")
    return relational.resolve_identity(p.where("person_id % 2 = 0"), delta, "bioguide", "canonical_name", "party").select(F.col("delta_id").alias("person_id"), "method", "resolved_id")


@query("""
SELECT coalesce(n.parent_jurisdiction_id, 'all') AS region, coalesce(s.jurisdiction_id, 'all') AS nation, CAST(grouping(n.parent_jurisdiction_id) + grouping(s.jurisdiction_id) AS INT) AS level,
  count(*) AS seats, CAST(sum(CASE WHEN s.baseline_status = 'verified' THEN 1 ELSE 0 END) AS BIGINT) AS verified, CAST(sum(CASE WHEN s.monitoring_active THEN 1 ELSE 0 END) AS BIGINT) AS monitored
FROM fx_seats s JOIN fx_jurisdictions n ON n.jurisdiction_id = s.jurisdiction_id GROUP BY ROLLUP (n.parent_jurisdiction_id, s.jurisdiction_id)""")
def coverage_atlas(t):
    s = t.seats.join(t.jurisdictions.select("jurisdiction_id", F.col("parent_jurisdiction_id").alias("r")), "jurisdiction_id")
    out = s.rollup("r", "jurisdiction_id").agg((F.grouping("r") + F.grouping("jurisdiction_id")).cast("int").alias("level"), F.count(F.lit(1)).alias("seats"), F.count_if(F.col("baseline_status") == "verified").alias("verified"), F.count_if("monitoring_active").alias("monitored"))
    return out.select(F.coalesce("r", F.lit("all")).alias("region"), F.coalesce("jurisdiction_id", F.lit("all")).alias("nation"), "level", "seats", "verified", "monitored")


@query("""
SELECT CAST(date_trunc('month', o.start_date) AS DATE) AS election, o.seat_id, o.person_id, p.canonical_name, o.occupancy_id FROM fx_occupancies o JOIN fx_persons p ON p.person_id = o.person_id""")
def candidates_for_election(t):
    return t.occupancies.join(t.persons, "person_id").select(F.trunc("start_date", "month").alias("election"), "seat_id", "person_id", "canonical_name", "occupancy_id")


@query("""
WITH base AS (SELECT seat_id, seat_name, baseline_status, jurisdiction_id FROM fx_seats WHERE seat_id % 3 <> 0),
delta AS (SELECT seat_id, CASE WHEN seat_id % 2 = 0 THEN NULL ELSE 'Renamed' END AS seat_name, 'verified' AS baseline_status, jurisdiction_id FROM fx_seats WHERE seat_id % 4 <> 1)
SELECT coalesce(b.seat_id, d.seat_id) AS seat_id, coalesce(b.seat_name, d.seat_name) AS seat_name, coalesce(d.baseline_status, b.baseline_status) AS baseline_status,
  CASE WHEN b.seat_id IS NULL THEN 'inserted' WHEN d.seat_id IS NULL THEN 'kept' ELSE 'updated' END AS outcome
FROM base b FULL JOIN delta d ON d.seat_id = b.seat_id""")
def upsert_latest(t):
    s = t.seats.select("seat_id", "seat_name", "baseline_status")
    delta = s.where("seat_id % 4 <> 1").select("seat_id", F.when(F.col("seat_id") % 2 != 0, "Renamed").alias("seat_name"), F.lit("verified").alias("baseline_status"))
    out = relational.upsert(s.where("seat_id % 3 <> 0"), delta, ["seat_id"], keep=["seat_name"])
    outcome = F.when(F.col("_only_delta") == 1, "inserted").when(F.col("_in_delta") == 0, "kept").otherwise("updated")
    return out.select("seat_id", "seat_name", "baseline_status", outcome.alias("outcome"))


@query("SELECT person_id, canonical_name FROM fx_persons p WHERE person_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM fx_persons c WHERE c.person_id % 3 = 0 AND lower(c.canonical_name) = lower(p.canonical_name))")
def staging_not_canonical(t):
    p = t.persons.withColumn("key", fn.normalize_person_name(F.col("canonical_name")))
    return p.where("person_id % 3 <> 0").join(p.where("person_id % 3 = 0").select("key").distinct(), "key", "left_anti").select("person_id", "canonical_name")


@query("""
SELECT canonical_name, person_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY canonical_name ORDER BY r, person_id) AS k FROM (
  SELECT canonical_name, min(person_id) AS person_id, 'canonical' AS origin, 0 AS r FROM fx_persons WHERE person_id % 3 = 0 GROUP BY canonical_name
  UNION ALL SELECT canonical_name, max(person_id), 'staging', 1 FROM fx_persons WHERE person_id % 3 <> 0 GROUP BY canonical_name)) WHERE k = 1""")
def merge_precedence(t):
    p = t.persons
    canonical = p.where("person_id % 3 = 0").groupBy("canonical_name").agg(F.min("person_id").alias("person_id")).withColumn("origin", F.lit("canonical"))
    staging = p.where("person_id % 3 <> 0").groupBy("canonical_name").agg(F.max("person_id").alias("person_id")).withColumn("origin", F.lit("staging"))
    return relational.merge_precedence([canonical, staging], ["canonical_name"]).select("canonical_name", "person_id", "origin")


@query("""
SELECT c_custkey AS person_id, lower(regexp_replace(c_name, '[^a-zA-Z0-9]+', ' ', 'g')) AS normalized FROM customer""")
def normalize_names(t):
    return t.customer.select(F.col("c_custkey").alias("person_id"), fn.normalize_person_name(F.col("c_name")).alias("normalized"))


@query("""
SELECT c_custkey AS person_id, split_part(n, ', ', 2) AS first, split_part(n, ', ', 1) AS last, concat_ws(' ', split_part(n, ', ', 2), split_part(n, ', ', 1)) AS display
FROM (SELECT c_custkey, concat(c_mktsegment, ', P', CAST(c_custkey AS STRING)) AS n FROM customer)""")
def name_parts(t):
    name = F.concat(F.col("c_mktsegment"), F.lit(", P"), F.col("c_custkey").cast("string"))
    return t.customer.select(F.col("c_custkey").alias("person_id"), fn.name_parts(name).alias("n")).select("person_id", "n.*")


@query("""
SELECT p_partkey AS part_id, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS dashed,
  regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS underscored, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 8) AS token FROM part""")
def slugs(t):
    return t.part.select(F.col("p_partkey").alias("part_id"), fn.slug(F.col("p_name")).alias("dashed"), fn.slug(F.col("p_name"), "underscore").alias("underscored"), fn.slug(F.col("p_name"), limit=8).alias("token"))


NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@query(f"""
SELECT seat_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], CASE WHEN h[17] IN ('0','4','8','c') THEN '8' WHEN h[17] IN ('1','5','9','d') THEN '9' WHEN h[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || h[18:20], h[21:32]) AS uuid
FROM (SELECT seat_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode('seat:' || CAST(seat_id AS STRING))) AS h FROM fx_seats)""")
def deterministic_ids(t):
    return t.seats.select("seat_id", fn.uuid5(NAMESPACE, F.concat(F.lit("seat:"), F.col("seat_id").cast("string"))).alias("uuid"))


@query("""
SELECT seat_id, 'need:v1:' || sha256('{"purpose":"missing_linked_evidence","scope_key":"' || office_type || '","subject_id":"' || CAST(seat_id AS STRING) || '"}') AS need_key FROM fx_seats""")
def work_identity(t):
    return t.seats.select("seat_id", fn.json_identity("need:v1:", purpose=F.lit("missing_linked_evidence"), scope_key=F.col("office_type"), subject_id=F.col("seat_id")).alias("need_key"))
