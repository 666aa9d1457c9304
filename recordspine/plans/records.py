"""The library's readers, extractors and column functions as plans over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspine import functions as fn
from recordspine.operators import envelopes, extract, places
from recordspine.plans.pages import HTML_SQL
from recordspine.plans.registry import query
from recordspine.sources import tables


def rows_of(t, sql: str, *names: str):
    """The rows of sql over the given tables; the same text stands in the query's SQL."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return t.spark.sql(sql, **{n: getattr(t, n) for n in names})


DATES = """SELECT o_orderkey AS order_id, CASE o_orderkey % 4 WHEN 0 THEN concat_ws('/', CAST(month(o_orderdate) AS STRING), CAST(day(o_orderdate) AS STRING), CAST(year(o_orderdate) AS STRING)) WHEN 1 THEN concat_ws('/', CAST(month(o_orderdate) AS STRING), CAST(day(o_orderdate) AS STRING), CAST(year(o_orderdate) % 100 AS STRING))
  WHEN 2 THEN concat('31/', CAST(day(o_orderdate) AS STRING), '/2020') ELSE 'soon' END AS text FROM orders"""


@query("SELECT o_orderkey AS order_id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CASE WHEN year(o_orderdate) % 100 >= 10 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) END END AS day FROM orders")
def us_dates(t):
    return rows_of(t, DATES, "orders").select("order_id", fn.iso_from_us_date(F.col("text")).alias("day"))


# Spellings and what they stand for.
PARTIES = [("Republican Party", "Republican"), ("Democrat", "Democratic"), ("NO PARTY affiliation", "No Party Affiliation"), ("Green  Party ", "Green Party"), ("", None), ("Representative", "Representative"), ("Independent", "Independent"), ("indigenous", "indigenous"), ("R", "Republican"), ("d", "Democratic"), ("I", "Independent")]
NAMES = [("Ann B. O''Neil-Roe", True), ("Contact us", False), ("Official Website", False), ("Vacant", False), ("Mary Ann Lee Van Der Berg", True), ("Ann O’Neil, ", True), ("Max Roe jr.", True), ("Welcome Home", False), ("To Be Determined", False), ("A B C D E F G", False), ("Jane", False), ("Jo  Li III", True)]
DISTRICTS = [("At-Large", "AL"), ("District 07", "07"), ("Delegate", "DEL"), ("Resident Commissioner", "RC"), ("north", None), ("12th ward", "12")]
INTERVALS = [("30s", 30), ("15m", 900), ("24h", 86400), ("7d", 604800), ("never", None)]


def pick(i: str, pairs, k: int) -> str:
    """A literal chosen by the remainder of i, in SQL of both engines."""
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, int) else f"'{x}'"
    return f"CASE CAST({i} % {len(pairs)} AS INT) " + " ".join(f"WHEN {n} THEN {lit(p[k])}" for n, p in enumerate(pairs)) + " END"


@query(f"""SELECT c_custkey AS id, {pick('c_custkey', PARTIES, 1)} AS party, {pick('c_custkey', DISTRICTS, 1)} AS district, CAST({pick('c_custkey', INTERVALS, 1)} AS BIGINT) AS seconds, concat(upper(left(c_mktsegment, 1)), lower(substring(c_mktsegment, 2)), ' Race') AS label, left(upper(c_mktsegment), 1) || 'R' AS initials, {pick('c_custkey', NAMES, 1)} AS person FROM customer""")
def spellings(t):
    """Parties, districts, intervals, labels and names as registries spell them."""
    d = rows_of(t, f"SELECT c_custkey AS id, {pick('c_custkey', PARTIES, 0)} AS p, {pick('c_custkey', DISTRICTS, 0)} AS d, {pick('c_custkey', INTERVALS, 0)} AS i, c_mktsegment AS m, {pick('c_custkey', NAMES, 0)} AS n FROM customer", "customer")
    key = F.concat(F.lower("m"), F.lit("_race"))
    return d.select("id", fn.party(F.col("p")).alias("party"), fn.district(F.col("d")).alias("district"), fn.interval_seconds(F.col("i")).alias("seconds"), fn.humanize(key).alias("label"), fn.initials(fn.humanize(key)).alias("initials"), fn.looks_like_person_name(F.col("n")).alias("person"))


@query("""SELECT c_custkey AS person_id, CASE WHEN c_custkey % 3 > 0 THEN 'new' ELSE 'old' END || CAST(c_custkey AS STRING) AS wikidata, 'b' || CAST(c_custkey % 9 AS STRING) AS bioguide, CASE WHEN c_custkey % 3 > 0 THEN 'f1' END AS fec, CASE WHEN c_custkey % 3 > 0 THEN 'f1' ELSE 'b' || CAST(c_custkey % 9 AS STRING) END AS first_id FROM customer""")
def external_ids(t):
    """Identifiers of a person after a merge, and the first by priority."""
    d = rows_of(t, """SELECT c_custkey AS person_id, map('bioguide', concat('b', CAST(c_custkey % 9 AS STRING)), 'wikidata', concat('old', CAST(c_custkey AS STRING))) AS old,
      CASE WHEN c_custkey % 3 > 0 THEN map('wikidata', concat('new', CAST(c_custkey AS STRING)), 'fec', 'f1') ELSE CAST(map() AS map<string, string>) END AS new FROM customer""", "customer")
    d = d.select("person_id", fn.merge_external_ids(F.col("old"), F.col("new")).alias("ids"))
    return d.select("person_id", *(F.try_element_at("ids", F.lit(k)).alias(k) for k in ("wikidata", "bioguide", "fec")), fn.first_external_id(F.col("ids"), ["icpsr", "fec", "bioguide"]).alias("first_id"))


IMAGES = "SELECT p_partkey % 40 AS page_id, concat('https://h.gov/', replace(p_name, ' ', '-'), '/', CAST(p_partkey AS STRING), CASE p_partkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.svg' ELSE '.PNG' END) AS url, CASE p_partkey % 4 WHEN 0 THEN 'og:image' WHEN 1 THEN 'twitter:image' ELSE 'img' END AS method, p_size % 5 = 0 AS portrait, p_size % 7 = 0 AS logo, lower(split_part(p_name, ' ', 1)) AS token FROM part"


@query(f"""WITH i AS ({IMAGES}), s AS (SELECT page_id, url, CASE method WHEN 'og:image' THEN 40 WHEN 'twitter:image' THEN 35 ELSE 20 END + CASE WHEN portrait THEN 9 ELSE 0 END - CASE WHEN logo THEN 35 ELSE 0 END + CASE WHEN contains(lower(url), token) THEN 12 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '[.](jpe?g|png|webp)$') THEN 4 ELSE 0 END AS score FROM i)
SELECT page_id, url, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS r FROM s) WHERE r <= 6""")
def picture_scores(t):
    i = rows_of(t, IMAGES, "part")
    return extract.image_scores(i, "page_id", "url", F.col("method"), F.col("portrait"), F.col("logo"), F.array("token")).select("page_id", "url", "score", "rank")


@query("""
WITH b AS (SELECT n_nationkey AS boundary_id, n_nationkey % 5 * 3 AS x0, n_nationkey % 4 * 3 AS y0, n_nationkey % 3 + 2 AS w, n_nationkey % 2 = 0 AS square FROM nation), p AS (SELECT c_custkey AS point_id, c_custkey % 20 + 0.25 AS x, c_custkey % 17 + 0.5 AS y FROM customer)
SELECT point_id, boundary_id FROM p JOIN b ON x > x0 AND y > y0 AND CASE WHEN square THEN x < x0 + w AND y < y0 + w ELSE (x - x0) + (y - y0) < w END""")
def boundary_points(t):
    """Points in squares and triangles."""
    b = t.nation.select(F.col("n_nationkey").alias("boundary_id"), (F.col("n_nationkey") % 5 * 3).cast("double").alias("x0"), (F.col("n_nationkey") % 4 * 3).cast("double").alias("y0"), (F.col("n_nationkey") % 3 + 2).cast("double").alias("w"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, w = F.col("x0"), F.col("y0"), F.col("w")
    corner = F.when(F.col("boundary_id") % 2 == 0, F.array(at(x0 + w, y0 + w))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    b = b.select("boundary_id", F.concat(F.array(at(x0, y0), at(x0 + w, y0)), corner, F.array(at(x0, y0 + w))).alias("ring"))
    p = t.customer.select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 20 + F.lit(0.25).cast("double")).alias("x"), (F.col("c_custkey") % 17 + F.lit(0.5).cast("double")).alias("y"))
    return places.locate(p, b)


@query("""
WITH b AS (SELECT s_suppkey AS boundary_id, s_suppkey * 13 % 97 AS x0, s_suppkey * 7 % 89 AS y0, s_suppkey % 6 + 2 AS w FROM supplier), p AS (SELECT c_custkey AS point_id, c_custkey * 37 % 1601 / 16.0 + 0.03125 AS x, c_custkey * 53 % 1499 / 16.0 + 0.015625 AS y FROM customer),
d AS (SELECT point_id, boundary_id, w, abs(x - x0) + abs(y - y0) AS d FROM p JOIN b ON x BETWEEN x0 - w AND x0 + w AND y BETWEEN y0 - w AND y0 + w)
SELECT point_id, boundary_id FROM d WHERE d < w AND d >= w / 2.0""")
def boundary_holes(t):
    """Points in diamonds of many corners, each with a hole of half its width."""
    n = lambda c: F.col(c).cast("double")
    b = t.supplier.select(F.col("s_suppkey").alias("boundary_id"), (n("s_suppkey") * 13 % 97).alias("x0"), (n("s_suppkey") * 7 % 89).alias("y0"), (n("s_suppkey") % 6 + 2).alias("w"))

    def diamond(w):
        side = lambda ax, ay, bx, by: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.col("x0") + w * (ax + (bx - ax) * i / 32)).alias("x"), (F.col("y0") + w * (ay + (by - ay) * i / 32)).alias("y")))
        return F.concat(side(1, 0, 0, 1), side(0, 1, -1, 0), side(-1, 0, 0, -1), side(0, -1, 1, 0))

    p = t.customer.select(F.col("c_custkey").alias("point_id"), (n("c_custkey") * 37 % 1601 / 16 + 0.03125).alias("x"), (n("c_custkey") * 53 % 1499 / 16 + 0.015625).alias("y"))
    return places.locate(p, b.select("boundary_id", F.array(diamond(F.col("w")), diamond(F.col("w") / 2)).alias("rings")))


@query("""SELECT o_orderkey AS order_id, o_orderstatus AS n, CAST(o_custkey AS BIGINT) AS v FROM orders UNION ALL SELECT o_orderkey, 'second', NULL FROM orders WHERE o_orderkey % 2 = 1""")
def payload_rows(t):
    """Rows of API payloads: a list, or an object with results."""
    one = """concat('{"n":"', o_orderstatus, '","v":', CAST(o_custkey AS STRING), '}')"""
    d = rows_of(t, f"""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN concat(' [', {one}, ']') ELSE concat('{{"count":2,"results":[', {one}, ',{{"n":"second"}}]}}') END AS payload FROM orders""", "orders")
    return tables.json_rows(d, "payload", "struct<n:string,v:bigint>").select("order_id", "row.n", "row.v")


ENVELOPES = """SELECT o_orderkey AS id, concat('{"envelope_id":"e', CAST(o_orderkey AS STRING), '","producer":"p","contract_key":"k","job_id":"j","received_at":"', CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-02' ELSE '2024-01-02T00:00:00Z' END, '","content_hash":"', CASE WHEN o_orderkey % 5 = 0 THEN 'abc' ELSE repeat('0', 64) END, '"', CASE WHEN o_orderkey % 7 = 0 THEN ',"secret":1' ELSE '' END,
  CASE WHEN o_orderkey % 4 > 0 THEN concat(',"claims":[{"k":"a","v":"', o_orderstatus, '"},{"k":"b"}]') ELSE '' END, '}') AS body FROM orders"""


@query("SELECT o_orderkey AS id, 'bad_time' AS rule FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'bad_hash' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'unknown_key' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'missing_claims' FROM orders WHERE o_orderkey % 4 = 0")
def envelope_rules(t):
    return envelopes.envelope_violations(rows_of(t, ENVELOPES, "orders"), "id")


@query("SELECT o_orderkey AS id, 'a' AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, 'b', NULL FROM orders WHERE o_orderkey % 4 > 0")
def envelope_claims(t):
    return tables.unpack_envelope(rows_of(t, ENVELOPES, "orders"), "claims", "struct<k:string,v:string>", keys=("id",))


@query("""SELECT c_custkey AS envelope_id, CASE c_custkey % 4 WHEN 3 THEN 'unknown_producer' WHEN 2 THEN 'inactive_producer' ELSE 'contract_not_allowed' END AS rule FROM customer WHERE c_custkey % 4 >= 2 OR c_nationkey % 4 <> 0""")
def envelope_policy(t):
    """Envelopes against a registry of producers; of an unknown one no other rule is asked."""
    d = rows_of(t, "SELECT c_custkey AS envelope_id, concat('p', CAST(c_custkey % 4 AS STRING)) AS producer, concat('k', CAST(c_nationkey % 4 AS STRING)) AS contract_key FROM customer", "customer")
    registry = F.broadcast(rows_of(t, "SELECT concat('p', CAST(r_regionkey AS STRING)) AS producer, r_regionkey < 2 AS active, array('k0') AS contracts FROM region WHERE r_regionkey < 3", "region"))  # three rows
    return envelopes.policy_violations(d, registry)


@query(f"""
WITH a AS (SELECT page_id, string_split(regexp_replace(html, '(<a [^>]*href="/)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM pages), b AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM a),
c AS (SELECT page_id, pos, regexp_extract(part, '<a [^>]*href="([^"]*)"', 1) AS href, regexp_extract(part, '(?is)<a [^>]*>(.*?)</a>', 1) AS inner_html, regexp_replace(part, '(?is)^<a .*?</a>', '') AS rest FROM b WHERE pos > 0)
SELECT page_id, CAST(pos AS INT) AS pos, href, {HTML_SQL.replace("(html,", "(inner_html,")} AS name, md5({HTML_SQL.replace("(html,", "(rest,")}) AS context_md5 FROM c""")
def page_anchors(t):
    """Anchors of a page, each with the text up to the next."""
    return extract.anchors(t.pages, "page_id", "html", "/").select("page_id", "pos", "href", "name", F.md5(F.col("context").cast("binary")).alias("context_md5"))


ROSTER = "SELECT s_nationkey AS doc_id, s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Mayor' WHEN 1 THEN 'Commissioner, District 4' ELSE 'Property Appraiser' END AS office, CASE s_suppkey % 4 WHEN 0 THEN 'Jane Q. Doe (Term: 2026)' WHEN 1 THEN 'Max Roe' WHEN 2 THEN 'vacant' ELSE 'Ann Lee Expires: 2028' END AS holder, concat('555 ', CAST(s_suppkey AS STRING)) AS phone FROM supplier"


@query(f"""SELECT doc_id, k * 3 + 1 AS pos, office, CASE k % 4 WHEN 0 THEN 'Jane Q. Doe' WHEN 1 THEN 'Max Roe' ELSE 'Ann Lee' END AS name, CASE k % 4 WHEN 0 THEN 2026 WHEN 3 THEN 2028 END AS term_end FROM ({ROSTER}) WHERE k % 4 <> 2""")
def roster_text(t):
    """Office, holder and term of printed rosters."""
    return extract.roster_lines(roster_lines(t))


def roster_lines(t):
    lines = F.posexplode(F.array("office", "holder", F.concat(F.lit("Office Phone: "), "phone")))
    return rows_of(t, ROSTER, "supplier").select("doc_id", "k", lines.alias("i", "line")).select("doc_id", (F.col("k") * 3 + F.col("i")).alias("pos"), "line")


@query("SELECT s_nationkey AS doc_id, 'office_phone' AS label, concat('555 ', CAST(s_suppkey AS STRING)) AS value FROM supplier UNION ALL SELECT s_nationkey, 'ann_lee_expires', '2028' FROM supplier WHERE s_suppkey % 4 = 3")
def label_rows(t):
    """Labelled values of a detail page's lines; terms inside brackets are none."""
    return extract.label_values(roster_lines(t), "doc_id", "line")


TABLE = """SELECT s_suppkey AS page_id, concat('<meta content="Official Website" property="og:title">', CASE WHEN s_suppkey % 7 = 0 THEN '<meta name="twitter:title" content="District 4 - Vacant Seat">' ELSE '' END, '<table><tr><th>Name</th><TH class="d">District</TH></tr><tr><td><b>', s_name, '</b></td><td> &#', CAST(65 + s_suppkey % 26 AS STRING), '; </td></tr></table><div class="card x">', CASE WHEN s_suppkey % 2 = 0 THEN 'Governor' ELSE 'Clerk' END, ' <a href="/g">G</a>', CASE WHEN s_suppkey % 3 = 0 THEN '<a href="/h">H</a>' ELSE '' END, '</div><h1>',
  CASE WHEN s_suppkey % 5 > 0 THEN 'Jane Doe | Office' ELSE '404' END, '</h1><a href="/Senators/S1">Doe, Jane</a> District: ', CAST(s_suppkey % 40 AS STRING), ' Democrat <a href="/Senators/S2">Vacant</a>') AS html FROM supplier"""


@query("SELECT s_suppkey AS page_id, 0 AS row, 'Name|District' AS cells FROM supplier UNION ALL SELECT s_suppkey, 1, s_name || '|' || chr(CAST(65 + s_suppkey % 26 AS INT)) FROM supplier")
def table_cells(t):
    rows = extract.table_rows(rows_of(t, TABLE, "supplier"), "page_id", "html")
    return rows.select("page_id", "row", F.array_join("cells", "|").alias("cells"))


@query("SELECT s_suppkey AS page_id, '/g' AS href FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 > 0")
def card_people(t):
    return extract.single_card(rows_of(t, TABLE, "supplier"), "page_id", "html", "Governor")


@query("SELECT s_suppkey AS page_id, '/Senators/S1' AS href, 'Doe, Jane' AS name, CAST(s_suppkey % 40 AS INT) AS district, 'Democratic' AS party, false AS vacant FROM supplier UNION ALL SELECT s_suppkey, '/Senators/S2', 'Vacant', NULL, NULL, true FROM supplier")
def directory_rows(t):
    return extract.directory_members(rows_of(t, TABLE, "supplier"), "page_id", "html", "/Senators/")


@query("SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 7 = 0 THEN 'Vacant' WHEN s_suppkey % 5 > 0 THEN 'Jane Doe' END AS name FROM supplier")
def profile_names(t):
    return rows_of(t, TABLE, "supplier").select("page_id", extract.profile_name(F.col("html")).alias("name"))


@query("SELECT seat_id, seat_name, jurisdiction_id, office_type, branch FROM fx_seats")
def public_seats(t):
    """Only what may be shown of a table."""
    return tables.public("seats", t.seats)


@query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 40 AS STRING) END AS district, CAST(NULL AS STRING) AS party FROM supplier")
def csv_directory(t):
    """A directory written with other headers and read by their aliases."""
    path = tables.shared_folder(t.spark, "directory")
    t.supplier.select(F.col("s_suppkey").alias("Id"), F.col("s_name").alias("Full Name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 40).alias("Dist")).write.option("header", True).csv(path)
    got = tables.read_csv_directory(t.spark, path, {"id": ["id"], "name": ["name", "full_name"], "district": ["district", "dist"], "party": ["party"]})
    return got.withColumn("id", F.col("id").cast("long"))


@query("SELECT s_suppkey AS id, s_name AS last_name, CASE WHEN s_suppkey % 2 = 0 THEN 'FL' END AS state FROM supplier")
def xml_roster(t):
    path = tables.shared_folder(t.spark, "roster")
    t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("last_name"), F.when(F.col("s_suppkey") % 2 == 0, "FL").alias("state")).write.format("xml").option("rowTag", "member").option("rootTag", "contact_information").save(path)
    return tables.read_xml_roster(t.spark, path, "member", T.StructType([T.StructField("id", T.LongType()), T.StructField("last_name", T.StringType()), T.StructField("state", T.StringType())]))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'second' ELSE 'first' END AS run FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey % 2 = 0")
def replaced_sets(t):
    """Record sets after a second run replaced one of them."""
    path = tables.shared_folder(t.spark, "sets")
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    tables.replace_records(rows.withColumn("run", F.lit("first")), path, "segment")
    tables.replace_records(rows.where("segment = 'BUILDING' AND id % 2 = 0").withColumn("run", F.lit("second")), path, "segment")
    return t.spark.read.schema("id long, run string, segment string").json(path).select("id", "segment", "run")


COMBINED = "SELECT s_suppkey AS doc_id, CASE s_suppkey % 5 WHEN 0 THEN 'Mayor: Jane Doe' WHEN 1 THEN concat('Commissioner, District ', CAST(s_suppkey % 13 AS STRING), ' - Max Q. Roe') WHEN 2 THEN 'Sheriff | Ann Lee-Smith' WHEN 3 THEN 'Phone: 555 1234' ELSE 'See the page' END AS line, CASE WHEN s_suppkey % 2 = 0 THEN concat(' B.A., Uni  ', CAST(s_suppkey AS STRING), ' ; ;J.D.') END AS education FROM supplier"


@query("SELECT s_suppkey AS doc_id, CASE s_suppkey % 5 WHEN 0 THEN 'Mayor' WHEN 1 THEN 'Commissioner' ELSE 'Sheriff' END AS office, CASE WHEN s_suppkey % 5 = 1 THEN CAST(s_suppkey % 13 AS INT) END AS district, CASE s_suppkey % 5 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'Max Q. Roe' ELSE 'Ann Lee-Smith' END AS name FROM supplier WHERE s_suppkey % 5 < 3")
def combined_roster(t):
    """Rosters whose rows hold office, district and holder at once."""
    d = rows_of(t, COMBINED, "supplier").withColumn("pos", F.lit(0))
    return extract.combined_lines(d, "doc_id", "pos", "line").select("doc_id", "office", "district", "name")


@query("SELECT s_suppkey AS doc_id, 'B.A., Uni ' || CAST(s_suppkey AS STRING) AS entry, 'unreviewed' AS review_status FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'J.D.', 'unreviewed' FROM supplier WHERE s_suppkey % 2 = 0")
def education_rows(t):
    return extract.education_entries(rows_of(t, COMBINED, "supplier"), "doc_id", "education").select("doc_id", "entry", "review_status")


DETAIL = """SELECT s_suppkey AS page_id, 'https://H.gov/m/x.html' AS url, concat('<h2>Capitol Office</h2><p>Room ', CAST(s_suppkey AS STRING), '</p><ul><li>Second &amp; Main</li><li>Second &amp; Main</li></ul><H2 class="b">Bio</H2><p>none</p><a href="/bills/', CAST(s_suppkey % 9 AS STRING), '">Bills</a><a href="/bills/', CAST(s_suppkey % 9 AS STRING), '">Again</a><a href="mailto:bill@x">bill</a><a href="/z">Other</a>',
  '<table><caption>', CASE WHEN s_suppkey % 2 = 0 THEN 'Florida' ELSE 'Ohio' END, '</caption><tr><th>District</th></tr><tr><td>1st</td><td><a href="/m">', s_name, '</a></td></tr></table>') AS html FROM supplier"""


@query("SELECT s_suppkey AS page_id, 'Capitol Office' AS label, 0 AS n, 'Room ' || CAST(s_suppkey AS STRING) AS line FROM supplier UNION ALL SELECT s_suppkey, 'Capitol Office', 1, 'Second & Main' FROM supplier")
def office_block_lines(t):
    return extract.office_blocks(rows_of(t, DETAIL, "supplier"), "page_id", "html").select("page_id", "label", "n", "line")


@query("SELECT s_suppkey AS page_id, 'Bills' AS label, 'https://h.gov/bills/' || CAST(s_suppkey % 9 AS STRING) AS url FROM supplier")
def named_page_links(t):
    return extract.named_links(rows_of(t, DETAIL, "supplier"), "page_id", "html", "url", ("bill",))


@query("SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Florida' ELSE 'Ohio' END AS state, '1st|' || s_name AS cells FROM supplier")
def state_table_members(t):
    rows = extract.state_tables(rows_of(t, DETAIL, "supplier"), "page_id", "html")
    return rows.select("page_id", "state", F.array_join("cells", "|").alias("cells"))
