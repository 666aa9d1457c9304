"""Queries for seats, persons, campaigns and elections by what is known of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspine import functions as fn
from recordspine.operators import matching
from recordspine.plans.records import rows_of
from recordspine.plans.registry import query

SEAT_QUERIES = """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 > 0 THEN concat('n-', CAST(o_custkey % 25 AS STRING)) END AS jurisdiction_id, CASE o_orderkey % 4 WHEN 0 THEN ' State  Senator' WHEN 1 THEN 'MAYOR!' WHEN 2 THEN '' END AS office_type,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('supplier ', CAST(o_custkey % 50 AS STRING)) END AS seat_name, CASE WHEN o_orderkey % 5 = 0 THEN 'legislative' END AS branch FROM orders"""
ELECTION_QUERIES = """SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 10 AS STRING) END AS seat_id, CASE WHEN c_custkey % 3 = 0 THEN concat('199', CAST(c_custkey % 9 AS STRING), '-03') END AS election_month, CASE c_custkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN '' END AS election_type FROM customer"""
ELECTIONS = "SELECT o_orderkey AS election_id, CAST(o_orderkey % 10 AS STRING) AS seat_id, substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS election_month, o_orderstatus AS election_type FROM orders"
RESULT = "CASE WHEN count({id}) = 1 THEN 'matched' WHEN count({id}) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, count({id}) AS candidates, CASE WHEN count({id}) = 1 THEN min({id}) END AS {name}"


def _given(*fields: str) -> str:
    return " AND ".join(f"(coalesce(q.{f}, '') = '' OR q.{f} = r.{f})" for f in fields)


_OFFICE = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"""
SELECT q.query_id, {RESULT.format(id='r.seat_id', name='seat_id')} FROM ({SEAT_QUERIES}) q LEFT JOIN fx_seats r ON {_given('jurisdiction_id', 'branch')} AND (coalesce(q.office_type, '') = '' OR {_OFFICE.format(c='q.office_type')} = {_OFFICE.format(c='r.office_type')})
  AND (coalesce(q.seat_name, '') = '' OR {_OFFICE.format(c='q.seat_name')} = {_OFFICE.format(c='r.seat_name')}) AND coalesce(q.jurisdiction_id, '') || coalesce(q.office_type, '') || coalesce(q.seat_name, '') <> '' GROUP BY q.query_id""")
def seat_matches(t):
    """The seats that a jurisdiction, office, name and level tell of, as far as given."""
    key = matching.office_key
    return matching.match(t.seats, "seat_id", rows_of(t, SEAT_QUERIES, "orders"), "query_id", ["jurisdiction_id", "office_type", "seat_name", "branch"], ["jurisdiction_id", "office_type", "seat_name"], {"office_type": key, "seat_name": key})


@query(f"""
SELECT q.query_id, {RESULT.format(id='r.person_id', name='person_id')} FROM (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 6 > 0 THEN 'pérson ' || CAST(o_custkey % 900 AS VARCHAR) || '.' END AS name FROM orders) q
LEFT JOIN fx_persons r ON trim(regexp_replace(lower(strip_accents(q.name)), '[^a-z0-9]+', ' ', 'g')) = lower(r.canonical_name) GROUP BY q.query_id""")
def person_matches(t):
    """The persons of a name; a name of no letters or digits tells of nobody."""
    q = t.orders.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 6 > 0, F.concat(F.lit("pérson "), (F.col("o_custkey") % 900).cast("string"), F.lit("."))).alias("canonical_name"))
    q = q.withColumn("canonical_name", fn.normalize_person_name(F.col("canonical_name")))
    return matching.match(t.persons, "person_id", q, "query_id", ["canonical_name"], keys={"canonical_name": fn.normalize_person_name})


@query(f"""
SELECT q.query_id, {RESULT.format(id='r.election_id', name='election_id')} FROM ({ELECTION_QUERIES}) q LEFT JOIN ({ELECTIONS}) r ON {_given('seat_id', 'election_month', 'election_type')} AND coalesce(q.seat_id, '') || coalesce(q.election_month, '') || coalesce(q.election_type, '') <> '' GROUP BY q.query_id""")
def election_matches(t):
    """The elections of a seat, month and type, as far as given."""
    return matching.match(rows_of(t, ELECTIONS, "orders"), "election_id", rows_of(t, ELECTION_QUERIES, "customer"), "query_id", ["seat_id", "election_month", "election_type"])
