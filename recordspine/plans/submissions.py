"""Submissions of producers: one for each customer, whose orders are its evidence, candidates, claims and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspine.operators import submissions
from recordspine.plans.registry import query
from recordspine.sources.tables import written

VERSION = "research-1"

# What the fixture's orders hold, told from the orders themselves and not from the JSON: c customer, o order, p place in the list.
ORDERS = """x AS (SELECT o_custkey AS c, o_orderkey AS o, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS p, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM orders),
g AS (SELECT * FROM x WHERE c % 13 > 0 AND c % 17 > 0), bad AS (SELECT * FROM g WHERE c % 3 = 0), good AS (SELECT * FROM g WHERE c % 3 > 0)"""
SHAPE = """shape AS (
  SELECT c, '' AS path, 'not_an_object' AS rule FROM x WHERE c % 17 = 0 GROUP BY c
  UNION ALL SELECT c, 'contract_version', 'unsupported_contract' FROM x WHERE c % 13 = 0 AND c % 17 > 0 GROUP BY c
  UNION ALL SELECT c, 'capability', 'too_short' FROM bad WHERE c % 2 = 0 GROUP BY c
  UNION ALL SELECT c, 'warnings', 'required' FROM bad WHERE c % 9 = 0 GROUP BY c
  UNION ALL SELECT c, 'evidence[' || p || '].sha256', 'too_short' FROM bad WHERE o % 7 = 0
  UNION ALL SELECT c, 'evidence[' || p || '].source_url', 'bad_url' FROM bad WHERE o % 5 = 0
  UNION ALL SELECT c, 'evidence[' || p || '].note', 'not_allowed' FROM bad WHERE o % 4 = 0
  UNION ALL SELECT c, 'claims[' || p || '].evidence_keys', 'too_few' FROM bad WHERE o % 11 = 0
  UNION ALL SELECT c, 'entities.person_candidates[' || p || '].attributes', 'required' FROM bad WHERE o % 6 = 0)"""
REFERENCES = """refs AS (SELECT c, 'claims[' || p || '].subject_candidate_key' AS path, 'unknown_candidate' AS rule FROM clean WHERE o % 8 = 0
  UNION ALL SELECT c, 'relationships[' || p || '].object_candidate_key', 'unknown_candidate' FROM clean WHERE o % 14 = 0
  UNION ALL SELECT c, 'claims[' || p || '].evidence_keys[1]', 'unknown_evidence' FROM clean WHERE o % 10 = 0 AND o % 11 > 0)"""


def bodies(t):
    """(submission_id, body): the JSON texts, written once as a producer would."""
    c, lit = F.col("c"), F.lit
    r = {"o": F.col("o"), "day": F.col("day")}
    bad = c % 3 == 0
    name = lambda letter, r: F.concat(lit(letter), r["o"].cast("string"))
    web = lambda r: F.concat(F.when(bad & (r["o"] % 5 == 0), "ftp").otherwise("https"), lit("://h.gov/"), r["o"].cast("string"))
    # Made for each order after the one shuffle, which moves keys and days only, and before orders are gathered: so it is compiled.
    orders = t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), F.to_date("o_orderdate").cast("string").alias("day")).repartition("c")
    evidence = F.struct(
        name("e", r).alias("evidence_key"), web(r).alias("source_url"), F.concat(r["day"], lit("T08:00:00Z")).alias("retrieved_at"), lit("text/html").alias("mime_type"), (r["o"] % 100).alias("byte_length"),
        F.when(bad & (r["o"] % 7 == 0), "abc").otherwise(F.sha2(r["o"].cast("string"), 256)).alias("sha256"), lit("get").alias("method"), lit("1").alias("parser_version"),
        F.when((r["o"] % 2 == 0) | (c % 4 == 1), F.base64(r["o"].cast("string").cast("binary"))).alias("content_base64"), F.when(bad & (r["o"] % 4 == 0), "seen").alias("note"))
    claims = F.struct(
        name("c", r).alias("claim_key"), name(F.when(~bad & (r["o"] % 8 == 0), "q").otherwise("p"), r).alias("subject_candidate_key"), lit("contact").alias("field_key"), F.array(r["day"]).alias("value"),
        F.when(r["o"] % 11 == 0, F.when(bad, F.array().cast("array<string>")).otherwise(F.array(name("e", r)))).when(r["o"] % 10 == 0, F.array(name("e", r), lit("gone"))).otherwise(F.array(name("e", r))).alias("evidence_keys"))
    people = F.struct(
        name("p", r).alias("candidate_key"), F.when(~bad | (r["o"] % 6 > 0), F.struct(r["day"].alias("day"))).alias("attributes"), F.array(name("e", r)).alias("evidence_keys"),
        F.when(r["o"] % 15 == 0, True).alias("identity_resolution_required"))
    ties = F.struct(name("p", r).alias("subject_candidate_key"), name(F.when(~bad & (r["o"] % 14 == 0), "z").otherwise("p"), r).alias("object_candidate_key"), lit("knows").alias("relationship_type"), F.array(name("e", r)).alias("evidence_keys"))
    one = F.struct("o", evidence.alias("evidence"), claims.alias("claims"), people.alias("people"), ties.alias("ties"))
    rows = orders.select("c", one.alias("x")).groupBy("c").agg(F.sort_array(F.collect_list("x")).alias("x"))
    evidence, claims, people, ties = (F.col(f"x.{n}") for n in ("evidence", "claims", "people", "ties"))
    none = F.array().cast("array<string>")
    text = F.to_json(F.struct(
        F.when(c % 13 == 0, "research-0").otherwise(VERSION).alias("contract_version"), F.struct(lit("p").alias("producer_id"), lit("1").alias("producer_version")).alias("producer"),
        F.struct(c.cast("string").alias("job_id"), F.sha2(c.cast("string"), 256).alias("research_work_identity")).alias("job"), lit(submissions.UNREVIEWED).alias("extraction_status"),
        F.when(bad & (c % 2 == 0), "").otherwise("profile").alias("capability"), F.struct(lit("k").alias("cohort_key"), lit("FL").alias("state")).alias("cohort"), none.alias("sources"), none.alias("retrievals"), evidence.alias("evidence"),
        F.struct(*((people if s == "person_candidates" else none).alias(s) for s in submissions.OBJECTS["entities"])).alias("entities"), claims.alias("claims"), ties.alias("relationships"), none.alias("dataset_units"), none.alias("gis_boundaries"),
        F.when(~bad | (c % 9 > 0), none).alias("warnings"), F.when(c % 5 == 0, F.array(lit("no phone"))).otherwise(none).alias("gaps"), F.struct(lit("2024-01-02T00:00:00Z").alias("current_as_of")).alias("currentness"), none.alias("monitoring_recommendations")))
    return written(rows.select(c.alias("submission_id"), F.when(c % 17 == 0, F.substring(text, 2, 100000)).otherwise(text).alias("body")), "submissions")


@query(f"WITH {ORDERS}, {SHAPE} SELECT c AS submission_id, path, rule FROM shape")
def submission_shape(t):
    """Every field of a submission that breaks its contract, with its path."""
    return submissions.shape_violations(bodies(t), "submission_id", VERSION)


@query(f"WITH {ORDERS}, clean AS (SELECT * FROM x WHERE c % 3 > 0 AND c % 17 > 0), {REFERENCES} SELECT c AS submission_id, path, rule FROM refs UNION ALL SELECT c, 'claims[' || p || '].evidence_keys[1]', 'unknown_evidence' FROM x WHERE c % 3 = 0 AND c % 17 > 0 AND o % 10 = 0 AND o % 11 > 0")
def submission_references(t):
    """Names of evidence and candidates that a readable submission uses and does not hold."""
    return submissions.reference_violations(bodies(t), "submission_id")


@query(f"""WITH {ORDERS}, {SHAPE}, n AS (SELECT c, count(*) AS n, bool_or(rule = 'unsupported_contract') AS other FROM shape GROUP BY c), clean AS (SELECT * FROM g WHERE c NOT IN (SELECT c FROM n)), {REFERENCES},
r AS (SELECT c, count(*) AS n FROM refs GROUP BY c), b AS (SELECT c, bool_or(o % 2 > 0 AND c % 4 <> 1) OR c % 5 = 0 AS partial, bool_or(o % 15 = 0) AS needs FROM x GROUP BY c)
SELECT b.c AS submission_id, CASE WHEN n.other THEN 'unsupported_contract' WHEN n.n IS NULL AND r.n IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, coalesce(n.n, r.n, 0) AS n_violations, n.n IS NULL AND r.n IS NULL AND partial AS partial, n.n IS NULL AND r.n IS NULL AND needs AS needs_identity
FROM b LEFT JOIN n ON n.c = b.c LEFT JOIN r ON r.c = b.c""")
def submission_outcomes(t):
    """Submissions accepted, rejected or of another contract; which are partial or need an identity."""
    return submissions.outcomes(bodies(t), "submission_id", VERSION)


@query(f"""WITH {ORDERS}, r AS (SELECT * FROM x WHERE c % 17 > 0) SELECT c AS submission_id, 'evidence' AS part, p AS pos, 'e' || o AS name, o % 100 AS n FROM r
UNION ALL SELECT c, 'person_candidates', p, 'p' || o, 1 FROM r UNION ALL SELECT c, 'claims', p, 'c' || o, CASE WHEN o % 11 = 0 THEN CASE WHEN c % 3 = 0 THEN 0 ELSE 1 END WHEN o % 10 = 0 THEN 2 ELSE 1 END FROM r
UNION ALL SELECT c, 'relationships', p, CASE WHEN c % 3 > 0 AND o % 14 = 0 THEN 'z' ELSE 'p' END || o, 1 FROM r UNION ALL SELECT c, 'gaps', 0, 'no phone', 1 FROM r WHERE c % 5 = 0 GROUP BY c""")
def submission_parts(t):
    """Every row that submissions are taken apart into, with a name and a number."""
    names = {"evidence": "evidence_key", "claims": "claim_key", "relationships": "object_candidate_key", "sources": "source_key", "retrievals": "content_hash", "dataset_units": "unit_key", "gis_boundaries": "boundary_key", "monitoring_recommendations": "scope"}
    keyed = (*submissions.OBJECTS["entities"], "claims", "relationships")
    part = F.col("part")
    field = lambda name, kind: F.try_variant_get("item", f"$.{name}", kind)
    name = F.when(part.isin("warnings", "gaps"), F.try_variant_get("item", "$", "string"))
    for p, n in names.items():
        name = name.when(part == p, field(n, "string"))
    n = F.when(part == "evidence", field("byte_length", "bigint")).when(part.isin(*keyed), F.size(field("evidence_keys", "array<string>")).cast("long")).otherwise(F.lit(1).cast("long"))
    return submissions.item_rows(bodies(t), "submission_id").select("submission_id", "part", "pos", name.otherwise(field("candidate_key", "string")).alias("name"), n.alias("n"))
