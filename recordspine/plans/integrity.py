"""Promotions that producers claim, provenance of sources, lineage over six tables, and leases that have run out."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspine.operators import json_walk, lineage, registry, work
from recordspine.plans.operations import ts
from recordspine.plans.records import rows_of
from recordspine.plans.registry import query

# Bodies whose states, lists, depths and escapes follow the events.
BODIES = """SELECT event_id, concat('{"extraction_status":"verified","', CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'verification_state' WHEN 1 THEN 'name' WHEN 2 THEN 'publicationStatus' ELSE 'note' END, '":',
  CASE CAST(user_id % 5 AS INT) WHEN 0 THEN '"Verified"' WHEN 1 THEN '["draft",["canonical","x",null]]' WHEN 2 THEN '{"deep":[{"record_status":"published","extraction_status":"canonical"},{"n":1.5}]}' WHEN 3 THEN concat('{"s', chr(92), 'u0074ate":"publication_eligible","type":"verified"}') ELSE '"approved"' END,
  ',"', event_type, '":{"state":', CASE WHEN event_id % 7 = 0 THEN '["verified","verified"]' WHEN event_id % 7 = 1 THEN 'true' ELSE '{"inner":"verified"}' END, '}}') AS body FROM events"""


@query(f"""
WITH RECURSIVE b AS ({BODIES}), w AS (
  SELECT event_id, '' AS path, '' AS name, CAST(body AS JSON) AS v FROM b UNION ALL
  SELECT w.event_id, CASE WHEN json_type(w.v) = 'ARRAY' THEN w.path || '[' || e.key || ']' WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END, CASE WHEN json_type(w.v) = 'ARRAY' THEN w.name ELSE e.key END, e.value
  FROM w, json_each(w.v) e WHERE json_type(w.v) IN ('ARRAY', 'OBJECT') AND NOT (w.path = '' AND e.key = 'extraction_status'))
SELECT event_id, path, lower(v ->> '$') AS term FROM w WHERE json_type(v) = 'VARCHAR' AND regexp_matches(name, '(?i)status|state|verification|publication') AND lower(v ->> '$') IN ('verified', 'canonical', 'published', 'publication_eligible')""")
def promoted_terms(t):
    """Producers' rows that claim a promotion of their own, with the path, at any depth."""
    return json_walk.promoted_terms(rows_of(t, BODIES, "events"), ["event_id"], "body")


# Two thirds of the hosts' pages are registered: as they are, twice, or at an address that has moved.
REGISTER = """SELECT page_id AS source_id, regexp_extract(url, '^https?://([^/]+)', 1) AS source_key, CASE WHEN page_id % 5 = 2 THEN concat(url, '/moved') ELSE url END AS source_url, page_id % 7 <> 3 AS active, CASE WHEN page_id % 2 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS authority_tier FROM pages WHERE page_id % 3 > 0
UNION ALL SELECT page_id + 10000000, regexp_extract(url, '^https?://([^/]+)', 1), url, true, 'SECONDARY' FROM pages WHERE page_id % 4 = 1"""
SOURCES = "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN concat('new-', CAST(page_id AS STRING)) ELSE regexp_extract(url, '^https?://([^/]+)', 1) END AS source_key, CASE WHEN page_id % 12 = 0 THEN concat(url, '#none') ELSE url END AS source_url FROM pages"


@query(f"""
WITH r AS (SELECT * FROM ({REGISTER}) WHERE active), s AS ({SOURCES}),
hits AS (SELECT s.page_id, s.source_key, r.source_id, r.authority_tier, r.source_key = s.source_key AND r.source_url = s.source_url AS exact FROM s LEFT JOIN r ON r.source_key = s.source_key OR r.source_url = s.source_url),
n AS (SELECT page_id, source_key, count(source_id) AS hits, count(*) FILTER (WHERE exact) AS exact, min(source_id) FILTER (WHERE exact) AS id, min_by(authority_tier, source_id) FILTER (WHERE exact) AS tier FROM hits GROUP BY ALL)
SELECT page_id, source_key, CASE WHEN exact = 1 THEN 'exact' WHEN exact > 1 THEN 'ambiguous' WHEN hits > 0 THEN 'mismatch' ELSE 'missing' END AS outcome, CASE WHEN exact = 1 THEN id END AS canonical_source_id, CASE WHEN exact = 1 THEN tier END AS canonical_authority_tier FROM n""")
def source_provenance(t):
    """Each page's source against the register, by key or address."""
    out = registry.source_provenance(rows_of(t, SOURCES, "pages"), rows_of(t, REGISTER, "pages"))
    return out.select("page_id", "source_key", "outcome", "canonical_source_id", "canonical_authority_tier")


@query(f"""
SELECT s.page_id, r.source_id, r.source_key = s.source_key AS same_key, r.source_url = s.source_url AS same_url FROM ({SOURCES}) s JOIN (SELECT * FROM ({REGISTER}) WHERE source_id % 10 = 1) r ON r.source_key = s.source_key OR r.source_url = s.source_url""")
def register_candidates(t):
    """Pages and the register's rows of a shard that share key or address, each pair once."""
    r = rows_of(t, REGISTER, "pages").where("source_id % 10 = 1").select("source_id", F.col("source_key").alias("k"), F.col("source_url").alias("u"))
    found = registry.any_key_join(rows_of(t, SOURCES, "pages"), r, [("source_url", "u"), ("source_key", "k")])
    return found.select("page_id", "source_id", (F.col("k") == F.col("source_key")).alias("same_key"), (F.col("u") == F.col("source_url")).alias("same_url"))


# job <- run <- retrieval <- document <- evidence <- link of a claim. changed: as the tables read some time later.
CHAIN = {
    "job": ("SELECT user_id AS job_id, concat(CAST(count(*) AS STRING), CASE WHEN {changed} AND user_id % 40 = 1 THEN '!' ELSE '' END) AS state FROM events GROUP BY user_id", "events", "job_id", ["state"], None),
    "run": ("SELECT event_id AS run_id, user_id AS job_id, event_type AS capability FROM events WHERE NOT ({changed} AND event_id % 97 = 5)", "events", "run_id", ["capability"], "job_id"),
    "retrieval": ("SELECT page_id AS retrieval_id, page_id * 3 AS run_id, concat(md5(html), CASE WHEN {changed} AND page_id % 31 = 3 THEN '!' ELSE '' END) AS content_hash FROM pages", "pages", "retrieval_id", ["content_hash"], "run_id"),
    "document": ("SELECT doc_id AS document_id, doc_id % 50 AS retrieval_id, n_chars FROM documents WHERE NOT ({changed} AND doc_id % 37 = 7)", "documents", "document_id", ["n_chars"], "retrieval_id"),
    "evidence": ("SELECT doc_id AS evidence_id, doc_id AS document_id, concat(md5(text), CASE WHEN {changed} AND doc_id % 29 = 2 THEN '!' ELSE '' END) AS content_hash FROM documents", "documents", "evidence_id", ["content_hash"], "document_id"),
    "link": ("SELECT event_id AS link_id, event_id * 7 % 150 AS evidence_id, concat(event_type, CASE WHEN {changed} AND event_id % 23 = 4 THEN '!' ELSE '' END) AS role FROM events WHERE NOT ({changed} AND event_id % 53 = 6)", "events", "link_id", ["role"], "evidence_id"),
}


def chain(t, changed: str):
    return [lineage.Hop(name, rows_of(t, sql.replace("{changed}", changed), table), key, facts, above) for name, (sql, table, key, facts, above) in CHAIN.items()]


@query("""
WITH l AS (SELECT event_id AS link_id, event_id * 7 % 150 AS doc_id, event_id * 7 % 150 % 50 AS page_id, event_id * 7 % 150 % 50 * 3 AS run_id FROM events),
j AS (SELECT l.*, e.user_id, d.doc_id AS doc, p.page_id AS page FROM l LEFT JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN pages p ON p.page_id = l.page_id LEFT JOIN events e ON e.event_id = l.run_id),
h AS (SELECT link_id, CASE WHEN link_id % 53 = 6 THEN 'link missing' WHEN doc IS NULL THEN NULL WHEN doc_id % 37 = 7 THEN 'document missing' WHEN run_id % 97 = 5 THEN 'run missing' WHEN user_id % 40 = 1 THEN 'job changed' WHEN page_id % 31 = 3 THEN 'retrieval changed'
  WHEN doc_id % 29 = 2 THEN 'evidence changed' WHEN link_id % 23 = 4 THEN 'link changed' END AS said FROM j)
SELECT link_id, split_part(said, ' ', 1) AS hop, split_part(said, ' ', 2) AS kind FROM h WHERE said IS NOT NULL""")
def lineage_breaks(t):
    """Links of claims whose chain up to the job is not what it was, with the first hop that differs."""
    was, later = lineage.chained(chain(t, "1 = 0")), lineage.chained(chain(t, "1 = 1"))
    return lineage.first_break(was, later, "link_id", list(CHAIN))


@query("""
SELECT job_id, CASE WHEN NOT late THEN status WHEN attempt_count >= max_attempts THEN 'dead_letter' ELSE 'queued' END AS status, CASE WHEN NOT late THEN NULL WHEN attempt_count >= max_attempts THEN 'lease_attempts_exhausted' ELSE 'lease_expired' END AS error_class,
  CASE WHEN late AND attempt_count < max_attempts THEN TIMESTAMP '2024-01-30 12:00:00' ELSE scheduled_for END AS scheduled_for, late AND attempt_count >= max_attempts AS completed
FROM (SELECT *, status = 'leased' AND lease_expires_at < TIMESTAMP '2024-01-30 12:00:00' AS late FROM fx_jobs)""")
def lease_recovery(t):
    """Jobs after expired leases are taken back."""
    at = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    jobs = t.jobs.withColumns({"scheduled_for": ts("scheduled_for"), "lease_expires_at": ts("lease_expires_at")})
    return work.recover_leases(jobs, at).select("job_id", "status", "error_class", "scheduled_for", F.col("completed_at").isNotNull().alias("completed"))


@query("""
SELECT r.worker_run_id, r.job_id, CASE WHEN stale THEN 'failed' ELSE r.status END AS status, CASE WHEN stale THEN 'lease_expired' END AS error_class
FROM (SELECT r.*, r.status = 'started' AND j.job_id IS NOT NULL AS stale FROM fx_worker_runs r LEFT JOIN (SELECT job_id FROM fx_jobs WHERE status = 'leased' AND lease_expires_at < TIMESTAMP '2024-01-30 12:00:00') j ON j.job_id = r.job_id) r""")
def stale_runs_closed(t):
    """Runs after expired leases are taken back."""
    at = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return work.close_stale_runs(t.worker_runs, t.jobs.withColumn("lease_expires_at", ts("lease_expires_at")), at).select("worker_run_id", "job_id", "status", "error_class")
