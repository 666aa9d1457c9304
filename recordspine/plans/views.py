"""Fixture views: public-record tables derived from the driver's tables. The SQL runs unchanged in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "jurisdictions": """
SELECT concat('r-', CAST(r_regionkey AS STRING)) AS jurisdiction_id, r_name AS name, 'region' AS jurisdiction_type, CAST(NULL AS STRING) AS parent_jurisdiction_id FROM region
UNION ALL
SELECT concat('n-', CAST(n_nationkey AS STRING)), n_name, 'nation', concat('r-', CAST(n_regionkey AS STRING)) FROM nation""",
    "seats": """
SELECT s_suppkey AS seat_id, s_name AS seat_name, concat('n-', CAST(s_nationkey AS STRING)) AS jurisdiction_id,
  CASE s_suppkey % 5 WHEN 0 THEN 'governor' WHEN 1 THEN 'state_senator' WHEN 2 THEN 'state_representative' WHEN 3 THEN 'mayor' ELSE 'sheriff' END AS office_type,
  CASE WHEN s_suppkey % 5 = 0 THEN 'executive' WHEN s_suppkey % 5 < 3 THEN 'legislative' ELSE 'local' END AS branch,
  CASE s_suppkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'officeholder_pending' ELSE 'discovered' END AS baseline_status,
  s_suppkey % 3 = 0 AS monitoring_active
FROM supplier""",
    "persons": """
SELECT c_custkey AS person_id, concat('Person ', CAST(c_custkey % 700 AS STRING)) AS canonical_name, c_mktsegment AS party,
  CASE WHEN c_custkey % 5 < 3 THEN 'verified' WHEN c_custkey % 5 = 3 THEN 'resolved' ELSE 'pending' END AS identity_status,
  CASE WHEN c_custkey % 3 = 0 THEN concat('B', CAST(c_custkey % 900 AS STRING)) END AS bioguide
FROM customer""",
    "occupancies": """
SELECT o_orderkey AS occupancy_id, o_orderkey % (SELECT count(*) FROM supplier) AS seat_id, o_custkey AS person_id,
  CAST(o_orderdate AS DATE) AS start_date,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'current' ELSE 'acting' END AS occupancy_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'verified' WHEN '2-HIGH' THEN 'reviewed' WHEN '3-MEDIUM' THEN 'authoritative' ELSE 'pending' END AS evidence_state
FROM orders""",
    "contract_fields": """
SELECT t.field_id, t.field_key, t.category, t.required_for_baseline FROM (VALUES
  (0,'current_occupant','occupancy',true),(1,'portrait','portrait',true),(2,'contact','contact',true),(3,'identity','identity',true),
  (4,'biography','biography',false),(5,'education','biography',false),(6,'election_history','elections',false),(7,'campaign_finance','finance',false),
  (8,'financial_disclosure','disclosures',false),(9,'promises_statements','media',false),(10,'evidence','evidence',true),(11,'monitoring','monitoring',true)
) AS t(field_id, field_key, category, required_for_baseline)""",
    "claims": """
SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))) AS claim_id,
  'seat' AS subject_type, l_suppkey AS subject_id, f.field_key,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN '' ELSE concat('v', CAST(l_partkey % 50 AS STRING)) END AS normalized_value,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'verified' WHEN l_returnflag = 'A' THEN 'collected_unreviewed' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'verification_pending'
       WHEN l_returnflag = 'N' THEN 'stale' WHEN l_linestatus = 'F' THEN 'conflict' ELSE 'checked_no_authoritative_result' END AS verification_state,
  CAST(l_shipdate AS DATE) AS valid_from,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + 365 END AS valid_to
FROM lineitem JOIN (SELECT t.k, t.field_key FROM (VALUES (0,'current_occupant'),(1,'portrait'),(2,'contact'),(3,'identity'),(4,'biography'),(5,'education'),(6,'election_history'),(7,'campaign_finance'),(8,'financial_disclosure'),(9,'promises_statements'),(10,'evidence')) AS t(k, field_key)) f
  ON f.k = l_partkey % 11""",
    "evidence": "SELECT doc_id AS evidence_id, source AS source_key, md5(text) AS content_hash, n_chars AS byte_length, CASE WHEN doc_id % 4 = 0 THEN 'verified' ELSE 'pending' END AS verification_state FROM documents",
    "claim_evidence": """
SELECT DISTINCT c.claim_id, e.evidence_id, CASE e.evidence_id % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'contextualizes' ELSE 'supports' END AS role
FROM (SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))) AS claim_id, l_partkey * 7 + l_linenumber AS k FROM lineitem WHERE l_linenumber < 4) c
CROSS JOIN (SELECT max(doc_id) + 1 AS docs FROM documents) n JOIN (SELECT doc_id AS evidence_id FROM documents) e ON e.evidence_id = c.k % n.docs""",
    "retrievals": """
SELECT page_id AS retrieval_id, parse_host.host AS source_key, md5(html) AS content_hash, length(html) AS n_chars, url AS source_url
FROM (SELECT page_id, html, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) parse_host""",
    "worker_runs": """
SELECT event_id AS worker_run_id, user_id AS job_id, event_type AS capability, ts AS started_at,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 17 = 0 THEN 'started' ELSE 'succeeded' END AS status,
  CAST(event_id % 4 AS INT) AS records_read, CAST(event_id % 3 AS INT) AS records_written, props
FROM events""",
    "jobs": """
SELECT user_id AS job_id, CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'queued' WHEN 1 THEN 'leased' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' ELSE 'dead_letter' END AS status,
  CAST(100 - user_id % 7 AS INT) AS priority, CAST(count(*) % 6 AS INT) AS attempt_count, 5 AS max_attempts, min(ts) AS scheduled_for, max(ts) AS lease_expires_at
FROM events GROUP BY user_id""",
    "job_deps": """
SELECT DISTINCT e.user_id AS job_id, (e.user_id * 7 + e.user_id % 4) % n.k AS prerequisite_job_id
FROM events e CROSS JOIN (SELECT max(user_id) + 1 AS k FROM events) n WHERE e.user_id <> (e.user_id * 7 + e.user_id % 4) % n.k""",
    "fingerprints": "SELECT user_id AS source_id, ts AS checked_at, CAST(floor(value / 10) AS INT) AS fingerprint FROM events WHERE event_type = 'view'",
}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The driver's tables and the views over them as DataFrames: t.orders, t.seats, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            sql = VIEWS[name]
            used = [b for b in BASE if re.search(rf"\bFROM {b}\b|\bJOIN {b}\b", sql)]
            for b in used:
                sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
            return self.spark.sql(sql, **{b: getattr(self, b) for b in used})
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)
