"""Claims and terms by their intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspine.operators import intervals
from recordspine.plans.records import rows_of
from recordspine.plans.registry import query

TERMS = """SELECT o_orderkey AS term_id, o_orderkey % (SELECT count(*) FROM supplier) AS seat_id, CAST(o_custkey % 11 AS INT) AS field_no, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderdate AS DATE) END AS term_start,
  CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) END AS term_end FROM orders"""
CLAIMS = """SELECT l_orderkey AS claim_no, l_linenumber AS line, l_suppkey AS seat_id, CAST(l_partkey % 11 AS INT) AS field_no, CAST(l_shipdate AS DATE) AS valid_from, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 500 AS INT) END AS valid_to FROM lineitem"""


@query(f"""
SELECT c.seat_id, c.field_no, c.line, count(*) AS pairs, min(t.term_id) AS first_term, max(t.term_id) AS last_term, min(c.claim_no) AS first_claim FROM ({CLAIMS}) c JOIN ({TERMS}) t ON t.seat_id = c.seat_id AND t.field_no = c.field_no
  AND c.valid_from < coalesce(c.valid_to, DATE '9999-01-01') AND coalesce(t.term_start, DATE '0001-01-01') < coalesce(t.term_end, DATE '9999-01-01') AND c.valid_from < coalesce(t.term_end, DATE '9999-01-01') AND coalesce(t.term_start, DATE '0001-01-01') < coalesce(c.valid_to, DATE '9999-01-01') GROUP BY ALL""")
def claims_within_terms(t):
    """Claims and terms of a seat and field that are valid on a common day."""
    pairs = intervals.overlap_join(rows_of(t, CLAIMS, "lineitem"), rows_of(t, TERMS, "supplier", "orders"), ["seat_id", "field_no"], ("valid_from", "valid_to"), ("term_start", "term_end"))
    return pairs.groupBy("seat_id", "field_no", "line").agg(F.count(F.lit(1)).alias("pairs"), F.min("term_id").alias("first_term"), F.max("term_id").alias("last_term"), F.min("claim_no").alias("first_claim"))


@query(f"""
SELECT c.claim_no, c.line, count(*) AS terms, min(t.term_id) AS first_term FROM ({CLAIMS}) c JOIN ({TERMS}) t ON t.seat_id = c.seat_id AND t.field_no = c.field_no AND c.valid_from >= coalesce(t.term_start, DATE '0001-01-01') AND c.valid_from < coalesce(t.term_end, DATE '9999-01-01') GROUP BY ALL""")
def terms_at_claim(t):
    """The terms in force on the day on which each claim began."""
    found = intervals.stab_join(rows_of(t, CLAIMS, "lineitem"), rows_of(t, TERMS, "supplier", "orders"), ["seat_id", "field_no"], "valid_from", ("term_start", "term_end"))
    return found.groupBy("claim_no", "line").agg(F.count(F.lit(1)).alias("terms"), F.min("term_id").alias("first_term"))
