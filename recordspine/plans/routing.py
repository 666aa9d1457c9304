"""Classes, routes, links and orders: which contract, queue, parser or page a record belongs to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordspine import functions as fn
from recordspine.functions import vocabularies as v
from recordspine.operators.ordering import with_position
from recordspine.plans.registry import query


def values(table) -> str:
    """Rows of a literal table in SQL."""
    return ", ".join(f"('{k}', '{x}')" for k, x in table.items())


OFFICES = ["governor", "cfo", "State Senator", "school-board member", "JUDGE", "dog catcher", "county_mayor", None]
OFFICE_SQL = "CASE s_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OFFICES) if o) + " END"


@query(f"""
WITH o AS (SELECT s_suppkey AS seat_id, {OFFICE_SQL} AS office_type, CAST(s_suppkey % 6 AS INT) AS p FROM supplier),
c AS (SELECT o.*, regexp_replace(upper(office_type), '[\\s-]+', '_', 'g') AS spelled, t.class FROM o LEFT JOIN (VALUES {values(v.CLASS_OF_OFFICE)}) AS t(kind, class) ON t.kind = o.office_type)
SELECT seat_id, coalesce(class, CASE WHEN spelled IN ({", ".join(f"'{x}'" for x in v.OFFICE_CLASSES)}) THEN spelled END, 'STATE_EXECUTIVE') AS contract_key, 500 - 80 * p AS job_priority FROM c""")
def office_contract(t):
    kind = F.get(F.array(*(F.lit(o) for o in OFFICES)), (F.col("s_suppkey") % 8).cast("int"))
    return t.supplier.select(F.col("s_suppkey").alias("seat_id"), v.office_class(kind).alias("contract_key"), (500 - 80 * (F.col("s_suppkey") % 6).cast("int")).alias("job_priority"))


CAPABILITIES = [*v.QUEUE_OF_CAPABILITY, "unheard_of"]
SOURCES = [*v.FAMILY_OF_SOURCE, "database_and_filings", "pdf"]


@query(f"""
WITH j AS (SELECT user_id AS job_id, count(*) AS n, list_value({", ".join(f"'{c}'" for c in CAPABILITIES)})[user_id % {len(CAPABILITIES)} + 1] AS capability,
  list_value({", ".join(f"'{c}'" for c in SOURCES)})[user_id % {len(SOURCES)} + 1] AS source_type FROM events GROUP BY user_id)
SELECT job_id, capability, q.queue, CASE WHEN capability IN ({", ".join(f"'{c}'" for c in v.READY_CAPABILITIES)}) THEN 'READY' WHEN q.queue IS NOT NULL THEN 'NOT_IMPLEMENTED' ELSE 'UNKNOWN' END AS state,
  coalesce(f.family, 'PDF_DIRECTORY') AS parser_family, CASE WHEN job_id % 9 = 0 THEN 'heavy' WHEN n * 1000000 > 8388608 THEN 'heavy' WHEN source_type = 'database_and_filings' THEN 'heavy' ELSE 'ingest' END AS source_route
FROM j LEFT JOIN (VALUES {values(v.QUEUE_OF_CAPABILITY)}) AS q(c, queue) ON q.c = j.capability LEFT JOIN (VALUES {values(v.FAMILY_OF_SOURCE)}) AS f(s, family) ON f.s = j.source_type""")
def dispatch(t):
    """Queue, readiness, parser family and route of each job; a job that needs a browser or over 8 MiB is heavy."""
    at = lambda names: F.get(F.array(*(F.lit(c) for c in names)), (F.col("job_id") % len(names)).cast("int"))
    j = t.events.groupBy(F.col("user_id").alias("job_id")).agg(F.count(F.lit(1)).alias("n")).withColumns({"capability": at(CAPABILITIES), "source_type": at(SOURCES)})
    queue = v.look_up(F.col("capability"), v.QUEUE_OF_CAPABILITY)
    state = F.when(F.col("capability").isin(*v.READY_CAPABILITIES), "READY").when(queue.isNotNull(), "NOT_IMPLEMENTED").otherwise("UNKNOWN")
    heavy = (F.col("job_id") % 9 == 0) | (F.col("n") * 1000000 > 8 * 1024 * 1024) | (F.col("source_type") == "database_and_filings")
    family = v.look_up(F.col("source_type"), v.FAMILY_OF_SOURCE, "PDF_DIRECTORY")
    return j.select("job_id", "capability", queue.alias("queue"), state.alias("state"), family.alias("parser_family"), F.when(heavy, "heavy").otherwise("ingest").alias("source_route"))


SIGNALS = "CASE WHEN page_id % 6 <> 0 THEN md5(CAST(page_id % 4 AS STRING)) END AS content_hash, CASE WHEN page_id % 4 <> 0 THEN concat('e', CAST(page_id % 3 AS STRING)) END AS etag, CASE WHEN page_id % 5 <> 0 THEN CAST(page_id % 2 AS INT) END AS modified"


@query(f"""
WITH r AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, {SIGNALS} FROM pages),
p AS (SELECT *, row_number() OVER w AS k, lag(content_hash) OVER w AS h0, lag(etag) OVER w AS e0, lag(modified) OVER w AS m0 FROM r WINDOW w AS (PARTITION BY host ORDER BY page_id))
SELECT page_id, CASE WHEN k = 1 THEN false WHEN content_hash IS NOT NULL AND h0 IS NOT NULL THEN content_hash = h0 WHEN coalesce(etag = e0, false) THEN true WHEN content_hash IS NULL AND coalesce(modified = m0, false) THEN true ELSE false END AS unchanged FROM p""")
def retrieval_unchanged(t):
    """Against the retrieval before: bytes decide where both have a hash; then the etag; the date only without a hash."""
    r = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), *(F.expr(x) for x in SIGNALS.split(", CASE")[:1]), *(F.expr(f"CASE{x}") for x in SIGNALS.split(", CASE")[1:]))
    w = Window.partitionBy("host").orderBy("page_id")
    same = lambda c: F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False))
    both = F.col("content_hash").isNotNull() & F.lag("content_hash").over(w).isNotNull()
    return r.select("page_id", F.when(both, same("content_hash")).otherwise(same("etag") | (F.col("content_hash").isNull() & same("modified"))).alias("unchanged"))


@query("""
WITH done AS (SELECT evidence_id AS id FROM fx_evidence WHERE evidence_id % 3 = 0 UNION SELECT subject_id FROM fx_claims WHERE verification_state = 'stale' UNION SELECT seat_id FROM fx_seats WHERE monitoring_active)
SELECT r.retrieval_id, CASE WHEN r.retrieval_id % 4 = 0 THEN 'fetched' ELSE 'parsed' END AS retrieval_status, r.retrieval_id % 4 <> 0 AND d.id IS NOT NULL AS complete FROM fx_retrievals r LEFT JOIN done d ON d.id = r.retrieval_id""")
def retrieval_downstream(t):
    """A parsed retrieval is complete once evidence, a claim or a seat stands behind it."""
    parts = [t.evidence.where("evidence_id % 3 = 0").select(F.col("evidence_id").alias("retrieval_id")), t.claims.where("verification_state = 'stale'").select("subject_id"), t.seats.where("monitoring_active").select("seat_id")]
    done = parts[0].union(parts[1]).union(parts[2]).distinct().withColumn("done", F.lit(True))
    parsed = F.col("retrieval_id") % 4 != 0
    out = t.retrievals.select("retrieval_id").join(done, "retrieval_id", "left")
    return out.select("retrieval_id", F.when(parsed, "parsed").otherwise("fetched").alias("retrieval_status"), (parsed & F.col("done").isNotNull()).alias("complete"))


STAGED = """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN concat(c_mktsegment, ', Ann ', CAST(c_custkey AS STRING)) ELSE concat('Bob  Lee ', c_mktsegment) END AS display_name,
  CASE WHEN c_custkey % 11 = 0 THEN 'vacancy' ELSE 'holder' END AS record_kind, CASE WHEN c_nationkey % 3 = 0 THEN 'GA' ELSE 'FL' END AS state_code, CASE WHEN c_custkey % 7 = 0 THEN 'failed' ELSE 'extracted_unreviewed' END AS status,
  CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 40 AS STRING) END AS district, CASE WHEN c_custkey % 4 > 0 THEN concat('Senator, District ', CAST(c_custkey % 40 AS STRING)) ELSE 'Governor' END AS title,
  CASE WHEN c_custkey % 3 = 0 THEN '1/7/23' WHEN c_custkey % 3 = 1 THEN '11/05/2024' ELSE 'January' END AS started FROM customer"""


@query(f"""
WITH r AS ({STAGED}), n AS (SELECT *, contains(display_name, ',') AS comma, regexp_split_to_array(trim(display_name), '\\s+') AS w FROM r WHERE record_kind <> 'vacancy' AND state_code = 'FL' AND status = 'extracted_unreviewed'),
p AS (SELECT *, CASE WHEN comma THEN trim(split_part(display_name, ',', 2)) ELSE w[1] END AS first_name, CASE WHEN comma THEN trim(split_part(display_name, ',', 1)) ELSE array_to_string(w[2:], ' ') END AS last_name FROM n)
SELECT id, first_name, last_name, regexp_replace(regexp_replace(lower(CASE WHEN comma THEN concat(first_name, ' ', last_name) ELSE trim(display_name) END || '-' || title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN district IS NULL THEN title ELSE 'Senator, District ' || district END AS seat_name, CASE WHEN district IS NULL THEN 'Florida' ELSE 'District ' || district END AS district_name,
  CASE started WHEN '1/7/23' THEN '2023-01-07' WHEN '11/05/2024' THEN '2024-11-05' END AS start_date FROM p""")
def profile_projection(t):
    """Staged holders of one state that were extracted, as profiles; vacancies and failed extractions are left out."""
    r = t.spark.sql(STAGED.replace("FROM customer", "FROM {customer}"), customer=t.customer).where("record_kind <> 'vacancy' AND state_code = 'FL' AND status = 'extracted_unreviewed'")
    comma, w = F.col("display_name").contains(","), F.split(F.trim("display_name"), r"\s+")
    first = F.when(comma, F.trim(F.split_part("display_name", F.lit(","), F.lit(2)))).otherwise(F.get(w, F.lit(0)))
    last = F.when(comma, F.trim(F.split_part("display_name", F.lit(","), F.lit(1)))).otherwise(F.array_join(F.slice(w, F.lit(2), F.size(w)), " "))
    shown = F.when(comma, F.concat_ws(" ", first, last)).otherwise(F.trim("display_name"))
    has = F.col("district").isNotNull()
    seat = F.when(has, F.concat(F.regexp_replace("title", r"(?i),?\s*District\s*\d+$", ""), F.lit(", District "), F.col("district"))).otherwise(F.col("title"))
    d = lambda i: F.regexp_extract("started", r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$", i)
    year = F.when(F.length(d(3)) == 2, F.concat(F.lit("20"), d(3))).otherwise(d(3))
    started = F.when(d(3) != "", F.concat_ws("-", year, F.lpad(d(1), 2, "0"), F.lpad(d(2), 2, "0")))
    return r.select("id", first.alias("first_name"), last.alias("last_name"), fn.slug(F.concat_ws("-", shown, F.col("title"))).alias("slug"), seat.alias("seat_name"), F.when(has, F.concat(F.lit("District "), F.col("district"))).otherwise("Florida").alias("district_name"), started.alias("start_date"))


@query("""SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS headline, 'unreviewed' AS review_state, 'collected_unreviewed' AS verification_state, false AS may_verify, 'manual_review_required' AS threshold FROM pages""")
def news_drafts(t):
    """News never verifies anything: each row waits for a review by hand."""
    constant = {"review_state": "unreviewed", "verification_state": "collected_unreviewed", "may_verify": False, "threshold": "manual_review_required"}
    return t.pages.select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("headline"), *(F.lit(x).alias(k) for k, x in constant.items()))


POLICY = "SELECT page_id AS policy_id, concat(' ', regexp_extract(url, '^https?://([^/]+)', 1), ' , other-', CAST(page_id % 7 AS STRING)) AS policy FROM pages"


@query(f"""
WITH p AS ({POLICY}), s AS (SELECT source_key, min(retrieval_id) AS first_id FROM fx_retrievals GROUP BY source_key UNION ALL SELECT 'other-3', 0)
SELECT DISTINCT policy_id, s.source_key FROM p JOIN s ON list_contains(string_split(replace(policy, ' ', ''), ','), s.source_key) WHERE s.first_id % 2 = 0""")
def policy_members(t):
    """Sources that a comma list names: an equi-join on its parts."""
    sources = t.retrievals.groupBy("source_key").agg(F.min("retrieval_id").alias("first_id")).unionByName(t.spark.createDataFrame([("other-3", 0)], "source_key string, first_id long"))
    p = t.spark.sql(POLICY.replace("FROM pages", "FROM {pages}"), pages=t.pages)
    named = p.select("policy_id", F.explode(F.array_distinct(F.split(F.replace("policy", F.lit(" "), F.lit("")), ","))).alias("source_key"))
    return named.join(sources.where("first_id % 2 = 0").select("source_key"), "source_key").select("policy_id", "source_key")


@query("""
WITH h AS (SELECT s_suppkey AS seat_id, s_nationkey AS chamber, CAST(s_suppkey % 40 AS STRING) AS district, s_suppkey % 9 = 0 AS vacant FROM supplier)
SELECT seat_id, chamber, row_number() OVER (PARTITION BY chamber ORDER BY CAST(district AS INT), vacant, seat_id) AS position FROM h""")
def district_order(t):
    """By the number of the district, not its text; vacancies last in a district."""
    h = t.supplier.select(F.col("s_suppkey").alias("seat_id"), F.col("s_nationkey").alias("chamber"), (F.col("s_suppkey") % 40).cast("string").alias("district"), (F.col("s_suppkey") % 9 == 0).alias("vacant"))
    return with_position(h, [F.col("district").cast("int"), F.col("vacant"), F.col("seat_id")], within=["chamber"]).select("seat_id", "chamber", "position")


@query("""
SELECT person_id, row_number() OVER (ORDER BY coalesce(CASE WHEN person_id % 5 > 0 THEN party END, 'None'), coalesce(CASE WHEN person_id % 7 > 0 THEN identity_status END, 'None'), canonical_name, person_id) AS position FROM fx_persons""")
def queue_order(t):
    """By level, title and name; what is missing sorts as the text None."""
    p = t.persons.select("person_id", "canonical_name", F.coalesce(F.when(F.col("person_id") % 5 > 0, F.col("party")), F.lit("None")).alias("level"), F.coalesce(F.when(F.col("person_id") % 7 > 0, F.col("identity_status")), F.lit("None")).alias("title"))
    return with_position(p, [F.col(c).asc() for c in ("level", "title", "canonical_name", "person_id")]).select("person_id", "position")


@query("""
WITH h AS (SELECT DISTINCT seat_id, person_id FROM fx_occupancies WHERE occupancy_status = 'acting'), c AS (SELECT claim_id, subject_id, field_key, normalized_value FROM fx_claims WHERE verification_state = 'verified')
SELECT h.seat_id, h.person_id, 'seat' AS level, c.claim_id, c.field_key FROM h JOIN c ON c.subject_id = h.seat_id AND c.field_key <> 'biography'
UNION ALL SELECT h.seat_id, h.person_id, 'person', c.claim_id, c.field_key FROM h JOIN c ON c.subject_id = h.person_id AND c.field_key = 'biography'""")
def profile_claims(t):
    """Claims about a holder's seat and about the holder, one after the other; nothing is merged."""
    holder = t.occupancies.where("occupancy_status = 'acting'").select("seat_id", "person_id").distinct()
    c = t.claims.where("verification_state = 'verified'").select("claim_id", "subject_id", "field_key")
    of = lambda level, key, which: holder.join(c.where(which).withColumnRenamed("subject_id", key), key).select("seat_id", "person_id", F.lit(level).alias("level"), "claim_id", "field_key")
    return of("seat", "seat_id", "field_key <> 'biography'").unionAll(of("person", "person_id", "field_key = 'biography'"))


@query("""
WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'commission' WHEN 1 THEN 'state_senate' WHEN 2 THEN 'clerk_of_court' ELSE 'US Senate' END AS family, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 20 AS STRING) END AS district, CASE s_suppkey % 3 WHEN 0 THEN 'Class I' WHEN 1 THEN 'Class II' ELSE 'Class III' END AS seat_class FROM supplier)
SELECT id, CASE WHEN family = 'US Senate' THEN 'us-fl-senate-' || replace(lower(seat_class), ' ', '-') WHEN family = 'commission' AND district IS NOT NULL THEN 'us-fl-miami-dade-county-commissioner-district-' || district
  WHEN family IN ('commission', 'clerk_of_court') THEN 'us-fl-miami-dade-' || replace(family, '_', '-') WHEN district IS NOT NULL THEN 'us-fl-' || replace(family, '_', '-') || '-district-' || district ELSE 'us-fl-' || replace(family, '_', '-') END AS seat_key FROM s""")
def seat_keys(t):
    """Permanent keys of county, legislative and Senate seats; no person, party or contact is part of one."""
    n = F.col("s_suppkey")
    family = F.when(n % 4 == 0, "commission").when(n % 4 == 1, "state_senate").when(n % 4 == 2, "clerk_of_court").otherwise("US Senate")
    seat_class = F.when(n % 3 == 0, "Class I").when(n % 3 == 1, "Class II").otherwise("Class III")
    return t.supplier.select(n.alias("id"), fn.seat_key(family, F.when(n % 3 > 0, (n % 20).cast("string")), seat_class).alias("seat_key"))


LINK = r"https?://[^\s""" + "\"" + r"''<>]+"


@query(f"""
WITH u AS (SELECT page_id, url AS base, list_filter(regexp_extract_all(html, '{LINK}'), lambda x: starts_with(x, 'https:')) AS l FROM pages),
k AS (SELECT page_id, base, list_filter(list_transform(l, lambda x: 'https://' || lower(regexp_extract(x, '^https://([^/?#]+)', 1)) || coalesce(nullif(regexp_extract(x, '^https://[^/?#]+([^?#]*)', 1), ''), '/')),
  lambda x: regexp_matches(regexp_extract(x, '^https://([^/]+)', 1), '(\\.gov|\\.us)$|{"|".join(p.replace(".", "[.]") for p in v.OFFICIAL_HOST_PARTS)}')) AS l FROM u),
a AS (SELECT page_id, list_concat([base], l) AS l FROM k)
SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:20], ' ') AS links FROM a""")
def official_links(t):
    """The page and the https links of official hosts on it, without query and fragment: 20 at most, in order."""
    return t.pages.select("page_id", F.array_join(fn.official_links(F.col("html"), F.col("url")), " ").alias("links"))


@query(r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
j AS (SELECT page_id, href, CASE WHEN regexp_matches(href, '^(mailto:|tel:|javascript:|#)') OR href = '' THEN NULL WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-z]+:', 0) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || href ELSE regexp_extract(url, '^([a-z]+://.*/)', 1) || href END AS u FROM a)
SELECT DISTINCT page_id, href, CASE WHEN regexp_matches(u, '^https?://[^/?#]') THEN regexp_extract(u, '^https?://', 0) || lower(regexp_extract(u, '^https?://([^/?#]+)', 1)) || coalesce(nullif(regexp_replace(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '/{2,}', '/', 'g'), ''), '/') || regexp_extract(u, '(\?[^#]*)', 1) END AS canonical FROM j""")
def canonical_urls(t):
    """Links of a page joined to its address: lower-case host, single slashes, no fragment; null for what is no page."""
    a = t.pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return a.select("page_id", "href", fn.canonical_url(F.col("href"), F.col("url")).alias("canonical")).distinct()


TIMES = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN concat(s, 'Z') WHEN 1 THEN concat(s, '+02:00') WHEN 2 THEN s WHEN 3 THEN 'yesterday' ELSE concat(s, '-05:30') END"


@query(f"WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s FROM events), x AS (SELECT event_id, {TIMES} AS text FROM e) SELECT event_id, text, CASE WHEN regexp_matches(text, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN epoch_us(TRY_CAST(text AS TIMESTAMPTZ)) END AS micros FROM x")
def iso_times(t):
    """Times with a zone; without one, or no time at all, nothing."""
    e = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("s")).select("event_id", F.expr(TIMES).alias("text"))
    zoned = F.when(F.col("text").rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$"), F.col("text"))
    return e.select("event_id", "text", F.unix_micros(F.try_to_timestamp(zoned)).alias("micros"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), n AS (SELECT doc_id, list_filter(w, lambda x: x <> '') AS w FROM l), k AS (SELECT doc_id, w, list_transform(w, lambda x: lower(x)) AS k FROM n)
SELECT doc_id, CAST(len(list_filter(w, lambda x, i: list_position(k, lower(x)) = i)) AS BIGINT) AS kept, md5(coalesce(array_to_string(list_filter(w, lambda x, i: list_position(k, lower(x)) = i), ' '), '')) AS kept_md5 FROM k""")
def ordered_distinct(t):
    """Words of a text, the first spelling of each, in order."""
    w = t.documents.select("doc_id", F.inline(F.array(F.struct(fn.first_spellings(F.split("text", " ")).alias("w")))))
    return w.select("doc_id", F.size("w").cast("long").alias("kept"), F.md5(F.array_join("w", " ").cast("binary")).alias("kept_md5"))
