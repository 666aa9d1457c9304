"""Pages and documents: extraction, hashes, links, sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordspine import functions as fn
from recordspine.functions import ladders
from recordspine.operators.ordering import with_position
from recordspine.operators import relational
from recordspine.plans.registry import query
from recordspine.sources import tables

DAY = "2024-01-31"


@query("SELECT page_id, 'raw/' || regexp_extract(url, '^https?://([^/]+)', 1) || '/2024/01/31/' || sha256(html) || '.html' AS snapshot_key FROM pages")
def snapshot_keys(t):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t.pages.select("page_id", tables.snapshot_key(host, F.to_date(F.lit(DAY)), F.col("html"), F.lit("html")).alias("snapshot_key"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'html' WHEN 2 THEN 'html' ELSE 'xml' END AS kind FROM pages")
def document_kind(t):
    kind = F.when(F.col("page_id") % 4 == 0, "application/json; charset=utf-8").when(F.col("page_id") % 4 == 3, "text/xml").when(F.col("page_id") % 4 == 1, "Text/HTML")
    return t.pages.select("page_id", ladders.document_kind(F.col("html"), kind).alias("kind"))


ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]
HTML_SQL = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _char in ENTITIES:
    HTML_SQL = f"replace({HTML_SQL}, '{_entity}', '{_char}')"
HTML_SQL = f"trim(regexp_replace({HTML_SQL}, '[\\s]+', ' ', 'g'))"
HREFS_SQL = r"""list_filter(list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*>'), lambda x: trim(regexp_extract(x, '(?i)\shref\s*=\s*["'']?([^"''>]*)', 1))), lambda x: x <> '')"""


@query(f"SELECT page_id, md5(v) AS text_md5, length(v) AS n_chars FROM (SELECT page_id, {HTML_SQL} AS v FROM pages)")
def html_text(t):
    v = fn.html_text(F.col("html"))
    return t.pages.select("page_id", F.md5(v.cast("binary")).alias("text_md5"), F.char_length(v).cast("long").alias("n_chars"))


@query(f"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest({HREFS_SQL}) AS href FROM pages) GROUP BY ALL""")
def page_links(t):
    return t.pages.select("page_id", F.explode(fn.links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(html, '<meta property="og:title" content="([^"]*)"', 1), ''), nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '')) AS title FROM pages""")
def page_title_pick(t):
    found = [F.regexp_extract("html", '<meta property="og:title" content="([^"]*)"', 1), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1), F.regexp_extract("html", "<title>([^<]*)</title>", 1)]
    return t.pages.select("page_id", F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in found)).alias("title"))


HOSTED = "CASE page_id % 5 WHEN 0 THEN 'https://www.senate.gov/p/' || CAST(page_id AS STRING) WHEN 1 THEN 'https://images.google.com/x' WHEN 2 THEN 'no url' ELSE url END"


@query(f"""
SELECT page_id, CASE WHEN host = '' THEN 'invalid_url' WHEN NOT starts_with(u, 'https:') THEN 'insecure_url' WHEN host IN ('images.google.com') THEN 'search_engine_image_rejected' WHEN NOT (host = 'gov' OR ends_with(host, '.gov')) THEN 'not_official_gov_host' ELSE 'official_gov_host' END AS reason
FROM (SELECT page_id, u, lower(regexp_extract(u, '^[a-z]+://([^/?#]+)', 1)) AS host FROM (SELECT page_id, {HOSTED} AS u FROM pages))""")
def url_authority_decision(t):
    return t.pages.select("page_id", ladders.url_authority(F.expr(HOSTED)).alias("reason"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{EMAIL}'), lambda x: lower(x)))), ',') AS emails, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{PHONE}'))), ',') AS phones FROM documents WHERE regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{PHONE}')""")
def contact_candidates(t):
    d = t.documents.where(F.col("text").rlike(EMAIL) | F.col("text").rlike(PHONE))
    one = lambda p, f: F.array_join(F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), f))), ",")
    return d.select("doc_id", one(EMAIL, F.lower).alias("emails"), one(PHONE, lambda x: x).alias("phones"))


@query("""
SELECT doc_id, CASE WHEN p > 0 THEN CAST(strlen(left(text, CAST(p - 1 AS BIGINT))) AS INT) END AS byte_offset, CASE WHEN p > 0 THEN substring(text, CAST(greatest(p - 40, 1) AS BIGINT), CAST(p - greatest(p - 40, 1) + 5 + 40 AS BIGINT)) END AS excerpt
FROM (SELECT doc_id, text, instr(text, ' the ') AS p FROM documents)""")
def excerpt_locator(t):
    return t.documents.select("doc_id", fn.excerpt(F.col("text"), F.lit(" the "), 40).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS byte_length, doc_id % 13 <> 0 AS hash_ok, n_chars = length(text) AS length_ok FROM documents")
def integrity_check(t):
    packed = F.base64(F.encode("text", "UTF-8"))  # as evidence travels
    stated = F.when(F.col("doc_id") % 13 == 0, F.lit("0" * 64)).otherwise(F.sha2("text", 256))
    body = F.unbase64(packed)
    return t.documents.select("doc_id", F.sha2(body, 256).alias("content_hash"), F.octet_length(body).cast("long").alias("byte_length"), (F.sha2(body, 256) == stated).alias("hash_ok"), (F.col("n_chars") == F.char_length("text")).alias("length_ok"))


# What words in a link speak for which category.
CATEGORIES = {"the": "records", "that": "meetings", "and": "contacts", "que": "budget", "der": "elections", "les": "permits"}
CAT_SQL = ", ".join(f"('{w}', '{c}')" for w, c in CATEGORIES.items())


@query(f"""
WITH a AS (SELECT page_id, href FROM (SELECT page_id, unnest({HREFS_SQL}) AS href FROM pages)), c(word, category) AS (VALUES {CAT_SQL})
SELECT page_id, category, count(*) AS hits, CAST(sum(CASE WHEN lower(href) = '/' || word THEN 3 ELSE 1 END) AS BIGINT) AS score FROM a JOIN c ON contains(lower(href), word) GROUP BY page_id, category""")
def link_categories(t):
    return link_scores(t).groupBy("page_id", "category").agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("score"))


def link_scores(t):
    cats = F.broadcast(t.spark.createDataFrame(list(CATEGORIES.items()), "word string, category string"))
    a = t.pages.select("page_id", F.explode(fn.links(F.col("html"))).alias("href"))
    return a.join(cats, F.contains(F.lower("href"), F.col("word"))).withColumn("score", F.when(F.lower("href") == F.concat(F.lit("/"), "word"), 3).otherwise(1).cast("long"))


@query(f"""
WITH a AS (SELECT page_id, unnest({HREFS_SQL}) AS href FROM pages), c(word, category) AS (VALUES {CAT_SQL}),
s AS (SELECT category, href, max(CASE WHEN lower(href) = '/' || word THEN 3 ELSE 1 END) AS score, count(*) AS n FROM a JOIN c ON contains(lower(href), word) GROUP BY category, href)
SELECT category, href, CAST(score AS BIGINT) AS score, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, n DESC, href) AS INT) AS rank FROM s) WHERE rank <= 20""")
def topk_per_category(t):
    best = link_scores(t).groupBy("category", "href").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return relational.top_k(best, ["category"], [F.col("score").desc(), F.col("n").desc(), F.col("href")], 20)


@query(f"""
WITH a AS (SELECT page_id, unnest({HREFS_SQL}) AS href FROM pages), c(word, category) AS (VALUES {CAT_SQL}),
have AS (SELECT DISTINCT page_id, category FROM a JOIN c ON contains(lower(href), word)), cats AS (SELECT DISTINCT category FROM c)
SELECT p.page_id, count(*) AS n, string_agg(k.category, ',' ORDER BY k.category) AS unresolved FROM pages p CROSS JOIN cats k LEFT JOIN have h ON h.page_id = p.page_id AND h.category = k.category WHERE h.page_id IS NULL GROUP BY p.page_id""")
def unresolved_categories(t):
    have = link_scores(t).groupBy("page_id").agg(F.collect_set("category").alias("have"))
    every = F.array(*map(F.lit, sorted(set(CATEGORIES.values()))))
    out = t.pages.select("page_id").join(have, "page_id", "left").withColumn("u", F.array_except(every, F.coalesce("have", F.array().cast("array<string>"))))
    return out.where(F.size("u") > 0).select("page_id", F.size("u").cast("long").alias("n"), F.array_join("u", ",").alias("unresolved"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT *, CASE WHEN ends_with(line, '.') AND length(line) < 60 THEN line END AS marker FROM l),
s AS (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM m)
SELECT doc_id, coalesce(section, '') AS section, count(*) AS lines, CAST(min(pos) AS INT) AS first_line FROM s GROUP BY doc_id, coalesce(section, '')""")
def marker_sections(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marker = F.when(F.col("line").endswith(".") & (F.char_length("line") < 60), F.col("line"))
    out = relational.under_marker(lines, "doc_id", "pos", marker)
    return out.groupBy("doc_id", F.coalesce("section", F.lit("")).alias("section")).agg(F.count(F.lit(1)).alias("lines"), F.min("pos").alias("first_line"))


@query("SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_keys(t):
    return t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""
WITH a AS (SELECT page_id, h, strpos(html, '<h1') AS b FROM (SELECT page_id, html, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS h FROM pages))
SELECT page_id, CAST(len(h) AS INT) AS headings, coalesce(h[1], '') AS first_heading FROM a""")
def page_headings(t):
    h = F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))
    return t.pages.select("page_id", h.alias("h")).select("page_id", F.size("h").alias("headings"), F.coalesce(F.get("h", F.lit(0)), F.lit("")).alias("first_heading"))


@query("SELECT source_key, content_hash, retrieval_id FROM (SELECT *, row_number() OVER (PARTITION BY source_key, content_hash ORDER BY retrieval_id) AS r FROM fx_retrievals) WHERE r = 1")
def retrieval_register(t):
    return relational.latest(t.retrievals, ["source_key", "content_hash"], [F.col("retrieval_id")]).select("source_key", "content_hash", "retrieval_id")


@query("""
WITH pol AS (SELECT s.seat_id, k.pos, k.host FROM fx_seats s CROSS JOIN (SELECT host, CAST(row_number() OVER (ORDER BY host) AS INT) AS pos FROM (SELECT DISTINCT source_key AS host FROM fx_retrievals)) k WHERE k.pos % 10 = s.seat_id % 10),
ok AS (SELECT DISTINCT source_key AS host FROM fx_retrievals WHERE starts_with(source_url, 'https:'))
SELECT seat_id, min(pos) AS position, min_by(pol.host, pos) AS source_key FROM pol JOIN ok ON ok.host = pol.host GROUP BY seat_id""")
def first_eligible_source(t):
    hosts = t.retrievals.groupBy(F.col("source_key").alias("host")).agg(F.bool_or(F.col("source_url").startswith("https:")).alias("https"))
    ranked = with_position(hosts, [F.col("host").asc()], "pos").where("https").withColumn("k", F.col("pos") % 10)
    first = ranked.groupBy("k").agg(F.min("pos").cast("int").alias("position"), F.min_by("host", "pos").alias("source_key"))  # ten rows
    return t.seats.select("seat_id", (F.col("seat_id") % 10).alias("k")).join(F.broadcast(first), "k").select("seat_id", "position", "source_key")
