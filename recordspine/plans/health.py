"""Audits and health: nine dimensions of a seat, the control plane's counts, collection summaries and their signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspine import functions as fn
from recordspine.functions import ladders
from recordspine.functions import vocabularies as v
from recordspine.operators import quality
from recordspine.plans.claims import EVALUATED, evaluated
from recordspine.plans.officials import CURRENT
from recordspine.plans.operations import NOW, now, ts
from recordspine.plans.registry import query

CLOSED = ("PRESENT", "CHECKED_NO_AUTHORITATIVE_RESULT")


@query(f"""
WITH e AS (SELECT seat_id, count(*) FILTER (WHERE required_for_baseline) AS required, count(*) FILTER (WHERE required_for_baseline AND presence IN ('PRESENT', 'CHECKED_NO_AUTHORITATIVE_RESULT')) AS closed, count(*) FILTER (WHERE action = 'contradiction') AS contradictions FROM ({EVALUATED}) GROUP BY seat_id),
c AS (SELECT subject_id, count(*) AS n, count(*) FILTER (WHERE verification_state = 'verified') AS verified, count(*) FILTER (WHERE verification_state = 'stale') AS stale FROM fx_claims GROUP BY subject_id),
l AS (SELECT c.subject_id, count(DISTINCT c.claim_id) AS linked FROM fx_claims c JOIN fx_claim_evidence x ON x.claim_id = c.claim_id GROUP BY c.subject_id),
o AS (SELECT seat_id, max(occupancy_status) AS status FROM fx_occupancies WHERE occupancy_status IN ('current', 'acting') GROUP BY seat_id),
r AS (SELECT s.seat_id, s.monitoring_active, s.seat_id % 10 < 8 AS preferred, s.seat_id % 4 = 1 AS reconciled, e.required, e.closed, e.contradictions, coalesce(c.n, 0) AS n, coalesce(c.verified, 0) AS verified, coalesce(c.stale, 0) AS stale, coalesce(l.linked, 0) AS linked, o.status
  FROM fx_seats s JOIN e ON e.seat_id = s.seat_id LEFT JOIN c ON c.subject_id = s.seat_id LEFT JOIN l ON l.subject_id = s.seat_id LEFT JOIN o ON o.seat_id = s.seat_id)
SELECT seat_id, 'FIELD' AS dimension, CASE WHEN closed = required AND required > 0 THEN 'PRESENT' ELSE 'MISSING' END AS status, CAST(closed AS STRING) || '/' || CAST(required AS STRING) || ' required fields present or honestly closed' AS summary, closed AS n FROM r
UNION ALL SELECT seat_id, 'SOURCE', CASE WHEN preferred THEN 'PRESENT' ELSE 'MISSING' END, CASE WHEN preferred THEN 'preferred source registered' ELSE 'preferred source missing or failing' END, NULL FROM r
UNION ALL SELECT seat_id, 'TEMPORAL', CASE WHEN status IS NULL THEN 'MISSING' ELSE 'PRESENT' END, coalesce('occupancy ' || status, 'no current occupancy'), NULL FROM r
UNION ALL SELECT seat_id, 'EVIDENCE', CASE WHEN linked > 0 THEN 'PRESENT' ELSE 'MISSING' END, CAST(linked AS STRING) || ' claims with attached evidence', linked FROM r
UNION ALL SELECT seat_id, 'VERIFICATION', CASE WHEN verified > 0 THEN 'PRESENT' ELSE 'UNKNOWN' END, 'HTTP 200 / hash / parse count is not VERIFIED', verified FROM r
UNION ALL SELECT seat_id, 'FRESHNESS', CASE WHEN stale > 0 THEN 'UNKNOWN' WHEN n > 0 THEN 'PRESENT' ELSE 'MISSING' END, CAST(stale AS STRING) || ' stale claims', stale FROM r
UNION ALL SELECT seat_id, 'DATASET_RECONCILIATION', CASE WHEN reconciled THEN 'PRESENT' ELSE 'MISSING' END, CASE WHEN reconciled THEN 'elections:coverage_complete_for_defined_scope' ELSE 'elections:incomplete' END, NULL FROM r
UNION ALL SELECT seat_id, 'MONITORING', CASE WHEN monitoring_active THEN 'PRESENT' ELSE 'MISSING' END, CASE WHEN monitoring_active THEN 'monitoring_state active' ELSE 'monitoring not active' END, NULL FROM r
UNION ALL SELECT seat_id, 'UNRESOLVED_CONTRADICTIONS', CASE WHEN contradictions > 0 THEN 'UNKNOWN' ELSE 'PRESENT' END, CAST(contradictions AS STRING) || ' unresolved contradictions', contradictions FROM r""")
def audit_dimensions(t):
    """Nine rows for each seat: what stands, what is missing and how much of it."""
    e = evaluated(t).groupBy("seat_id").agg(
        F.count_if("required_for_baseline").alias("required"), F.count_if(F.col("required_for_baseline") & F.col("presence").isin(*CLOSED)).alias("closed"), F.count_if(F.col("action") == "contradiction").alias("contradictions"))
    linked_ids = t.claim_evidence.select("claim_id").distinct().withColumn("linked", F.lit(True))
    is_state = lambda s: F.count_if(F.col("verification_state") == s)
    c = t.claims.groupBy("subject_id", "claim_id").agg(F.count(F.lit(1)).alias("n"), is_state("verified").alias("verified"), is_state("stale").alias("stale")).join(linked_ids, "claim_id", "left")
    c = c.groupBy(F.col("subject_id").alias("seat_id")).agg(F.sum("n").alias("n"), F.sum("verified").alias("verified"), F.sum("stale").alias("stale"), F.count_if("linked").alias("linked"))
    o = t.occupancies.where(F.col("occupancy_status").isin(*CURRENT)).groupBy("seat_id").agg(F.max("occupancy_status").alias("status"))
    r = t.seats.select("seat_id", "monitoring_active").join(e, "seat_id").join(c, "seat_id", "left").join(o, "seat_id", "left").fillna(0, ["n", "verified", "stale", "linked"])
    count = lambda n, text: F.concat(F.col(n).cast("string"), F.lit(text))
    preferred, reconciled = F.col("seat_id") % 10 < 8, F.col("seat_id") % 4 == 1
    either = lambda test, yes, no: F.when(test, yes).otherwise(no)
    there = lambda test, no="MISSING": either(test, "PRESENT", no)
    none = F.lit(None).cast("long")
    dimensions = [
        ("FIELD", there((F.col("closed") == F.col("required")) & (F.col("required") > 0)), F.concat(count("closed", "/"), count("required", " required fields present or honestly closed")), F.col("closed")),
        ("SOURCE", there(preferred), either(preferred, "preferred source registered", "preferred source missing or failing"), none),
        ("TEMPORAL", there(F.col("status").isNotNull()), F.coalesce(F.concat(F.lit("occupancy "), F.col("status")), F.lit("no current occupancy")), none),
        ("EVIDENCE", there(F.col("linked") > 0), count("linked", " claims with attached evidence"), F.col("linked")),
        ("VERIFICATION", there(F.col("verified") > 0, "UNKNOWN"), F.lit("HTTP 200 / hash / parse count is not VERIFIED"), F.col("verified")),
        ("FRESHNESS", F.when(F.col("stale") > 0, "UNKNOWN").otherwise(there(F.col("n") > 0)), count("stale", " stale claims"), F.col("stale")),
        ("DATASET_RECONCILIATION", there(reconciled), either(reconciled, "elections:coverage_complete_for_defined_scope", "elections:incomplete"), none),
        ("MONITORING", there(F.col("monitoring_active")), either(F.col("monitoring_active"), "monitoring_state active", "monitoring not active"), none),
        ("UNRESOLVED_CONTRADICTIONS", there(F.col("contradictions") == 0, "UNKNOWN"), count("contradictions", " unresolved contradictions"), F.col("contradictions")),
    ]
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), s.alias("status"), x.alias("summary"), n.alias("n")) for d, s, x, n in dimensions))
    return r.select("seat_id", F.explode(rows).alias("d")).select("seat_id", "d.*")


PENDING = "'collected_unreviewed', 'extracted', 'entity_match_pending', 'evidence_pending', 'verification_pending'"
COUNTS = {
    "seats": {"seats_discovered": "true", "monitored": "monitoring_active", "monitoring_overdue": "monitoring_active AND seat_id % 2 = 0"},
    "occupancies": {"current_occupants": "occupancy_status IN ('current', 'acting')", "upcoming_terms": "start_date >= DATE '1998-01-01'", "candidates_discovered": "evidence_state = 'pending'"},
    "claims": {"verified_claims": "verification_state = 'verified'", "pending_claims": f"verification_state IN ({PENDING})", "stale_claims": "verification_state = 'stale'", "conflicts": "verification_state = 'conflict'", "claims": "true"},
    "claim_evidence": {"contradictions": "role = 'contradicts'", "evidence_links": "true"},
    "jobs": {"jobs_queued": "status = 'queued'", "jobs_running": "status IN ('running', 'leased')", "jobs_succeeded": "status = 'succeeded'", "jobs_failed": "status = 'failed'", "jobs_dead_letter": "status = 'dead_letter'"},
    "worker_runs": {"runs": "true", "failed_runs": "status = 'failed'", "recent_runs": "started_at >= TIMESTAMP '2024-01-29 00:00:00'"},
    "retrievals": {"retrievals": "true", "large_retrievals": "n_chars > 2000"},
}


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM fx_{view} WHERE {test}) AS {name}" for view, tests in COUNTS.items() for name, test in tests.items()) + """,
  (SELECT count(*) FROM fx_seats s WHERE EXISTS (SELECT 1 FROM fx_occupancies o WHERE o.seat_id = s.seat_id AND o.occupancy_status IN ('current', 'acting')) OR EXISTS (SELECT 1 FROM fx_claims c WHERE c.subject_id = s.seat_id AND c.field_key = 'current_occupant')) AS baseline_complete,
  (SELECT max(started_at) FROM fx_worker_runs WHERE status = 'succeeded') AS last_successful_run""")
def control_plane(t):
    """One row of all counts; each table is read once, and its one row of sums joins the others."""
    parts = [getattr(t, view).agg(*(F.count_if(F.expr(test)).alias(name) for name, test in tests.items())) for view, tests in COUNTS.items()]
    held = t.occupancies.where(F.col("occupancy_status").isin(*CURRENT)).select("seat_id").union(t.claims.where("field_key = 'current_occupant'").select("subject_id")).distinct()
    parts.append(t.seats.join(held, "seat_id", "left_semi").agg(F.count(F.lit(1)).alias("baseline_complete")))
    parts.append(t.worker_runs.where("status = 'succeeded'").agg(F.max("started_at").alias("last_successful_run")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query("""
SELECT coalesce(f.category, 'uncategorized') AS category, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fx_claims c WHERE c.field_key = f.field_key AND (c.verification_state IN ('verified', 'checked_no_authoritative_result') OR c.normalized_value <> ''))) AS present, count(*) AS total
FROM fx_contract_fields f GROUP BY 1""")
def category_presence(t):
    """Of each category, the fields for which anything is known or was looked for in vain."""
    return quality.presence_by_category(t.contract_fields, t.claims, ["verified", "checked_no_authoritative_result"])


@query(f"""
WITH r AS (SELECT source_key, count(*) AS pages, count(*) FILTER (WHERE n_chars < 1000) AS thin FROM fx_retrievals GROUP BY source_key)
SELECT count(*) FILTER (WHERE thin * 2 <= pages) AS sources_active, count(*) FILTER (WHERE thin * 2 > pages) AS sources_failing, (SELECT count(*) FROM (SELECT DISTINCT seat_id, date_trunc('month', start_date) FROM fx_occupancies WHERE start_date >= DATE '1998-01-01')) AS upcoming_elections FROM r""")
def control_plane_sources(t):
    """Active and failing sources (more than half of the pages thin), and elections still to come."""
    per = t.retrievals.groupBy("source_key").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("n_chars") < 1000).alias("thin"))
    failing = F.col("thin") * 2 > F.col("pages")
    ahead = t.occupancies.where("start_date >= DATE '1998-01-01'").select("seat_id", F.trunc("start_date", "month").alias("month")).distinct().agg(F.count(F.lit(1)).alias("upcoming_elections"))
    return per.agg(F.count_if(~failing).alias("sources_active"), F.count_if(failing).alias("sources_failing")).crossJoin(F.broadcast(ahead))  # one row each


MAIL, SITE, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", r"https?://[A-Za-z0-9./_-]+", r"\+[0-9][0-9 ()-]{8,}[0-9]"


@query(f"""
WITH d AS (SELECT lang, source, doc_id, len(regexp_extract_all(text, '{MAIL}')) AS mails, len(regexp_extract_all(text, '{SITE}')) AS sites, len(regexp_extract_all(text, '{PHONE.replace(chr(92), chr(92))}')) AS phones FROM documents)
SELECT lang, count(*) AS records, count(*) FILTER (WHERE mails > 0 OR phones > 0) AS with_contact, count(*) FILTER (WHERE sites > 0) AS with_website, count(*) FILTER (WHERE mails > 0) AS with_mail, count(DISTINCT source) AS statuses, max(doc_id) AS latest FROM d GROUP BY lang""")
def candidate_summary(t):
    """Candidate records with at least one contact, site or address, by language."""
    found = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))) > 0
    d = t.documents.select("lang", "source", "doc_id", found(MAIL).alias("mail"), found(SITE).alias("site"), found(PHONE).alias("phone"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("mail") | F.col("phone")).alias("with_contact"), F.count_if("site").alias("with_website"), F.count_if("mail").alias("with_mail"), F.count_distinct("source").alias("statuses"), F.max("doc_id").alias("latest"))


DISCOVERY = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN -1 ELSE s_nationkey END AS county, s_suppkey % 3 AS batch, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 13 END AS resolved, CASE WHEN s_suppkey % 5 > 0 THEN 13 + s_suppkey % 2 END AS required,
  CASE WHEN s_suppkey % 17 = 0 THEN 'failed' ELSE 'ok' END AS status, s_suppkey % 4 AS unresolved FROM supplier"""


@query(f"""
WITH d AS ({DISCOVERY}), k AS (SELECT batch, count(*) AS records, count(DISTINCT CASE WHEN n.n_nationkey IS NOT NULL THEN county END) AS counties, count(DISTINCT CASE WHEN n.n_nationkey IS NULL THEN county END) AS unknown, CAST(sum(coalesce(resolved, 0)) AS BIGINT) AS resolved,
  coalesce(max(required), 0) AS expected, CAST(coalesce(sum(required), 0) AS BIGINT) AS reported, CAST(sum(unresolved) AS BIGINT) AS unresolved, count(*) FILTER (WHERE status = 'failed') AS failed FROM d LEFT JOIN nation n ON n.n_nationkey = d.county GROUP BY batch)
SELECT batch, records, counties, unknown, resolved, expected, expected * records AS required, reported, unresolved,
  concat_ws(',', CASE WHEN counties < (SELECT count(*) FROM nation) THEN 'county_source_discovery_incomplete' END, CASE WHEN failed > 0 THEN 'county_source_discovery_failed' END, CASE WHEN unknown > 0 THEN 'county_source_discovery_unknown_county' END) AS signals FROM k""")
def local_coverage(t):
    """Source discovery by batch: the most categories that any record reports count for all of them; signals in order."""
    d = t.spark.sql(DISCOVERY.replace("FROM supplier", "FROM {supplier}"), supplier=t.supplier)
    known = t.nation.select(F.col("n_nationkey").alias("county"), F.lit(True).alias("known"))
    counties_of = t.nation.agg(F.count(F.lit(1)).alias("all_counties"))
    k = d.join(known, "county", "left").groupBy("batch").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(F.when(F.col("known"), F.col("county"))).alias("counties"), F.count_distinct(F.when(F.col("known").isNull(), F.col("county"))).alias("unknown"),
        F.sum(F.coalesce("resolved", F.lit(0))).alias("resolved"), F.coalesce(F.max("required"), F.lit(0)).alias("expected"), F.coalesce(F.sum("required"), F.lit(0)).alias("reported"), F.sum("unresolved").alias("unresolved"), F.count_if(F.col("status") == "failed").alias("failed"))
    k = k.crossJoin(F.broadcast(counties_of))  # one row
    signals = ladders.blockers(county_source_discovery_incomplete=F.col("counties") < F.col("all_counties"), county_source_discovery_failed=F.col("failed") > 0, county_source_discovery_unknown_county=F.col("unknown") > 0)
    return k.select("batch", "records", "counties", "unknown", "resolved", "expected", (F.col("expected") * F.col("records")).alias("required"), "reported", "unresolved", F.array_join(signals, ",").alias("signals"))


@query("""
WITH r AS (SELECT capability, CAST(started_at AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE status = 'succeeded') AS good FROM fx_worker_runs GROUP BY ALL),
m AS (SELECT capability, min(n) AS low, max(n) AS high FROM r WHERE day < DATE '2024-01-10' GROUP BY capability)
SELECT r.capability, r.day, r.n, round(r.good / r.n, 4) AS rate, r.good / r.n >= CASE r.capability WHEN 'view' THEN 0.9 WHEN 'click' THEN 0.5 ELSE 0.6 END AS passes,
  CASE WHEN m.low IS NULL THEN 'no_baseline' WHEN r.n < m.low THEN 'baseline_below_expected' WHEN r.n > m.high THEN 'baseline_above_expected' ELSE 'healthy' END AS drift FROM r LEFT JOIN m ON m.capability = r.capability WHERE r.day >= DATE '2024-01-10'""")
def baseline_drift(t):
    """Runs of each day against the range of the earlier days, and their success rate against the collector's minimum."""
    r = t.worker_runs.groupBy("capability", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "succeeded").alias("good"))
    m = r.where("day < DATE '2024-01-10'").groupBy("capability").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    least = F.when(F.col("capability") == "view", 0.9).when(F.col("capability") == "click", 0.5).otherwise(0.6)
    drift = F.when(F.col("low").isNull(), "no_baseline").when(F.col("n") < F.col("low"), "baseline_below_expected").when(F.col("n") > F.col("high"), "baseline_above_expected").otherwise("healthy")
    out = r.where("day >= DATE '2024-01-10'").join(m, "capability", "left")
    return out.select("capability", "day", "n", F.round(F.col("good") / F.col("n"), 4).alias("rate"), (F.col("good") / F.col("n") >= least).alias("passes"), drift.alias("drift"))


TIER_WORDS = ["official", " Official_Campaign ", "public_institutional", "secondary", "tier_4_secondary_review", "rumour", None]
WORD_SQL = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(TIER_WORDS) if w) + " END"


@query(f"""
WITH p AS (SELECT page_id, url, lower(trim({WORD_SQL})) AS w, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages),
k AS (SELECT *, CASE w WHEN 'official' THEN 'TIER_1_PRIMARY_OFFICIAL' WHEN 'official_campaign' THEN 'TIER_2_OFFICIAL_CAMPAIGN' WHEN 'public_institutional' THEN 'TIER_3_PUBLIC_INSTITUTIONAL' WHEN 'secondary' THEN 'TIER_4_SECONDARY_REVIEW' WHEN 'tier_4_secondary_review' THEN 'TIER_4_SECONDARY_REVIEW' ELSE 'TIER_5_DISCOVERY_ONLY' END AS tier FROM p)
SELECT page_id, tier, tier <> 'TIER_5_DISCOVERY_ONLY' AS may_verify, tier = 'TIER_1_PRIMARY_OFFICIAL' AS primary_source, CASE WHEN starts_with(url, 'https:') AND (host = 'gov' OR host LIKE '%.gov') THEN 'official_government_profile' ELSE 'rejected' END AS picture_class FROM k""")
def source_authority(t):
    word = F.get(F.array(*map(F.lit, TIER_WORDS)), (F.col("page_id") % 7).cast("int"))
    p = t.pages.select("page_id", "url", ladders.authority_tier(word).alias("tier"))
    return p.select("page_id", "tier", ladders.can_verify_alone(F.col("tier")).alias("may_verify"), ladders.is_government_primary(F.col("tier")).alias("primary_source"), ladders.url_class(ladders.url_authority(F.col("url"))).alias("picture_class"))


@query(f"""
WITH m AS (SELECT user_id AS target_id, user_id % 4 > 0 AS active, CASE WHEN user_id % 5 > 0 THEN max(ts) END AS next_check_at, min(ts) AS seen FROM events GROUP BY user_id)
SELECT target_id, active AND (next_check_at IS NULL OR next_check_at <= {NOW}) AS due, active AND coalesce(next_check_at <= {NOW}, false) AS overdue, seen < {NOW} - INTERVAL 30 DAY AS stale FROM m""")
def monitoring_states(t):
    """Due: active and no later check set; overdue: its check has passed; stale: seen over 30 days ago."""
    m = t.events.groupBy(F.col("user_id").alias("target_id")).agg(F.max("ts").alias("last"), F.min("ts").alias("seen"))
    active = F.col("target_id") % 4 > 0
    check = F.when(F.col("target_id") % 5 > 0, F.col("last").cast("timestamp_ntz"))
    late = F.coalesce(check <= now(), F.lit(False))
    return m.select("target_id", (active & (check.isNull() | late)).alias("due"), (active & late).alias("overdue"), (ts("seen") < now() - F.expr("INTERVAL 30 DAYS")).alias("stale"))


@query(f"""
WITH a AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'https?://([^\\s"''<>/]+)', 1))) AS host FROM pages)
SELECT a.page_id, p.platform, count(DISTINCT a.host) AS hosts FROM a JOIN (VALUES {", ".join(f"('{h}', '{x}')" for h, x in v.PLATFORM_OF_HOST.items())}, ('example.com', 'Example'), ('example.org', 'Example')) AS p(domain, platform) ON lower(a.host) = p.domain OR ends_with(lower(a.host), '.' || p.domain) GROUP BY a.page_id, p.platform""")
def social_links(t):
    """Social networks that a page links to, by the host or a host above it: each host meets its own endings by equality."""
    platforms = t.spark.createDataFrame([*v.PLATFORM_OF_HOST.items(), ("example.com", "Example"), ("example.org", "Example")], "domain string, platform string")
    hosts = t.pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""https?://([^\s"'<>/]+)"""), F.lit(1)))).alias("host"))
    parts = F.split(F.lower("host"), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return hosts.select("page_id", "host", F.explode(endings).alias("domain")).join(F.broadcast(platforms), "domain").groupBy("page_id", "platform").agg(F.count_distinct("host").alias("hosts"))  # fifteen literal rows


@query("""
WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN '--' ELSE concat(' ', p_name, ' ') END AS t FROM part), d AS (SELECT id, regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g') AS s FROM n)
SELECT id, regexp_replace(s, '^-+|-+$', '', 'g') AS by_letters, coalesce(nullif(regexp_replace(s, '^-+|-+$', '', 'g'), ''), 'unknown') AS or_unknown, regexp_replace(s, '^-|-$', '', 'g') AS one_dash FROM d""")
def slug_variants(t):
    """Slugs that may be empty, that fall back to a word, and that lose one dash at an end only."""
    n = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 == 0, "--").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("t"))
    dashed = F.regexp_replace(F.lower("t"), "[^a-z0-9]+", "-")
    return n.select("id", fn.slug(F.col("t")).alias("by_letters"), F.coalesce(F.nullif(fn.slug(F.col("t")), F.lit("")), F.lit("unknown")).alias("or_unknown"), F.regexp_replace(dashed, "^-|-$", "").alias("one_dash"))


@query("""
WITH h AS (SELECT s_suppkey AS id, concat('slug-', CAST(s_suppkey % 60 AS STRING)) AS slug, concat('seat-', CAST(s_suppkey % 80 AS STRING)) AS seat_key, concat(CAST(s_nationkey AS STRING), ':', CAST(s_suppkey % 9 AS STRING)) AS district FROM supplier),
k AS (SELECT 'slug' AS kind, slug AS value, id FROM h UNION ALL SELECT 'seat', seat_key, id FROM h UNION ALL SELECT 'district', district, id FROM h UNION ALL SELECT 'id', CAST(id AS STRING), id FROM h)
SELECT kind, value, count(*) AS n, min(id) AS first_id FROM k GROUP BY kind, value HAVING count(*) > 1""")
def duplicate_identities(t):
    """Slugs, official ids, seats and districts that several records have."""
    k = F.col("s_suppkey")
    kinds = {"slug": F.concat(F.lit("slug-"), (k % 60).cast("string")), "seat": F.concat(F.lit("seat-"), (k % 80).cast("string")), "district": F.concat_ws(":", F.col("s_nationkey").cast("string"), (k % 9).cast("string")), "id": k.cast("string")}
    rows = t.supplier.select(k.alias("id"), F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), c.alias("value")) for n, c in kinds.items()))).alias("x"))
    return rows.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")
