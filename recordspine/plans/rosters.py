"""Directory pages of nations, whose customers are the members; the SQL tells the rosters from the customers themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspine.operators import rosters
from recordspine.plans.registry import query

CODES = {f"State {i}": f"S{i}" for i in range(25)}
MANIFEST = "SELECT n_nationkey AS page_id, n_nationkey % 3 * 25 AS expected_minimum, 66 AS expected_maximum FROM nation"
MEMBERS = """m AS (SELECT c_nationkey AS page_id, c_custkey AS c, CASE WHEN c_nationkey % 4 = 0 THEN c_custkey % 10 ELSE c_custkey % 1000 END AS d, c_name, c_mktsegment FROM customer)"""
HOUSE = f"""{MEMBERS}, h AS (SELECT page_id, 'S' || page_id || '|' || d AS unit, CASE WHEN c % 7 > 0 THEN c_name END AS name, CASE WHEN c % 7 = 0 THEN c_name END AS former_name, CASE WHEN c % 7 > 0 THEN '/m/' || c END AS href, CASE WHEN c % 2 = 0 THEN 'R' ELSE 'D' END AS party,
  c_mktsegment AS phone, CASE WHEN c % 3 = 0 THEN 'Budget,Ways' ELSE '' END AS committees, c % 7 = 0 AS vacant FROM m WHERE c % 11 > 0 OR c % 7 = 0)"""
GATE = """g AS (SELECT n_nationkey AS page_id, n_nationkey % 3 * 25 AS lo, coalesce(sum(k), 0) AS n, count(*) FILTER (WHERE k > 1) AS twice, coalesce(sum(odd), 0) AS odd FROM nation LEFT JOIN (SELECT page_id, unit, count(*) AS k, count(*) FILTER (WHERE NOT matches) AS odd FROM r GROUP BY ALL) u ON page_id = n_nationkey GROUP BY ALL),
s AS (SELECT page_id, CAST(n AS BIGINT) AS n, twice AS repeated_units, concat_ws(',', CASE WHEN twice > 0 THEN 'repeated_unit' END, CASE WHEN odd > 0 THEN 'mismatch' END, CASE WHEN n < lo THEN 'too_few' END, CASE WHEN n > 66 THEN 'too_many' END) AS reasons FROM g)"""


def pages(t, one, head="", foot=""):
    """(page_id, html): a nation's page, one piece for each customer by number."""
    c = F.col("c_custkey")
    number = F.when(F.col("c_nationkey") % 4 == 0, c % 10).otherwise(c % 1000)
    rows = t.customer.select(F.col("c_nationkey").alias("page_id"), F.struct(c.alias("c"), one(c, number.cast("string"), F.col("c_nationkey")).alias("x")).alias("x"))
    rows = rows.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["x"]), "\n").alias("rows"))
    return rows.select("page_id", F.concat(F.lit(head), "rows", F.lit(foot)).alias("html"))


def house(t):
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))

    def one(c, d, n):
        member = F.when(c % 7 == 0, text(F.col("c_name"), " - Vacancy")).when(c % 11 == 0, F.col("c_name")).otherwise(text('<a class="p" href="/m/', c.cast("string"), '">', F.col("c_name"), "</a>"))
        return text("<tr><td>District ", d, "</td><td>", member, "</td><td>", F.when(c % 2 == 0, "R").otherwise("D"), "</td><td>", (c % 1000).cast("string"), "</td><td>", F.col("c_mktsegment"), "</td><td>", F.when(c % 3 == 0, "Budget | Ways|").otherwise(""), "</td></tr>")

    state = text("State ", F.col("page_id").cast("string"))
    columns = "<tr><th>District</th><th>Name</th><th>Party</th></tr>"
    head = F.when(F.col("page_id") % 2 == 0, text("<table><caption>", state, "</caption>", columns)).otherwise(text('<table><tr><th colspan="6">', state, "</th></tr>", columns))
    return rosters.seat_tables(pages(t, one, head, "</table>"), "page_id", "html", CODES)


def manifest(t):
    return t.nation.select(F.col("n_nationkey").alias("page_id"), (F.col("n_nationkey") % 3 * 25).alias("expected_minimum"), F.lit(66).alias("expected_maximum"))


def outcome(gates):
    return gates.select("page_id", "n", "repeated_units", "status", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {HOUSE} SELECT page_id, unit, name, former_name, href, party, phone, committees, vacant FROM h")
def seat_rosters(t):
    """Members and vacancies of tables by state."""
    return house(t).select("page_id", "unit", "name", "former_name", "href", "party", "phone", F.array_join("committees", ",").alias("committees"), "vacant")


@query(f"WITH {HOUSE}, r AS (SELECT page_id, unit, true AS matches FROM h), {GATE} SELECT page_id, n, repeated_units, CASE WHEN reasons = '' THEN 'accepted' ELSE 'refused' END AS status, reasons FROM s")
def seat_roster_gates(t):
    """Pages whose roster gives a seat twice, or too few or too many."""
    return outcome(rosters.gate(house(t), manifest(t), "page_id"))


@query(f"WITH {HOUSE}, r AS (SELECT page_id, unit, true AS matches FROM h), {GATE} SELECT h.page_id, unit, coalesce(name, 'Vacant') AS holder FROM h JOIN s ON s.page_id = h.page_id WHERE reasons = ''")
def accepted_rosters(t):
    """Records of the pages that passed whole."""
    rows = house(t)
    return rosters.accepted(rows, rosters.gate(rows, manifest(t), "page_id"), "page_id").select("page_id", "unit", F.coalesce("name", F.lit("Vacant")).alias("holder"))


@query(f"""WITH {MEMBERS}, e AS (SELECT page_id, CAST(d AS VARCHAR) AS unit, c_name AS name, CASE WHEN c % 2 = 0 THEN 'Republican' ELSE 'No Party Affiliation' END AS party, CASE WHEN c % 4 > 0 THEN 'Lake, Polk' END AS counties, CASE WHEN c % 5 = 0 THEN 'Resigned 1/2/25' WHEN c % 5 = 1 THEN 'Leader' END AS status, c % 5 > 0 AS active, CAST(c AS VARCHAR) AS member_id
  FROM m WHERE c % 9 > 0) SELECT * FROM e UNION ALL SELECT * FROM e WHERE NOT active AND CAST(member_id AS INT) % 3 = 0""")
def term_rosters(t):
    """Entries with party, district, counties and term in one link's text; of those in office each address counts once."""
    def one(c, d, n):
        said = F.concat_ws(" ", "c_name", F.when(c % 2 == 0, "Republican").otherwise("No Party Affiliation"), F.concat(F.lit("&mdash; District: "), d), F.when(c % 4 > 0, "Lake, Polk"), F.when(c % 9 > 0, "11/05/24 - 11/03/26"), F.when(c % 5 == 0, "(Resigned 1/2/25)").when(c % 5 == 1, "(Leader)"))
        link = F.concat(F.lit('<a href="/d.aspx?MemberId='), c.cast("string"), F.lit('&amp;S=1">'), said, F.lit("</a>"))
        return F.when(c % 3 == 0, F.concat(link, link)).otherwise(link)

    return rosters.term_entries(pages(t, one), "page_id", "html", r"/d\.aspx\?.*").select("page_id", "unit", "name", "party", "counties", "status", "active", "member_id")


@query(f"""WITH {MEMBERS}, r AS (SELECT page_id, CAST(d AS VARCHAR) AS unit, min_by(c % 101 > 0 OR page_id % 5 = 0 OR page_id % 4 = 0, c) AS matches FROM m WHERE c % 9 > 0 AND c % 8 > 0 GROUP BY ALL),
{GATE} SELECT page_id, n, repeated_units, CASE WHEN reasons = '' THEN 'accepted' ELSE 'refused' END AS status, reasons FROM s""")
def district_roster_gates(t):
    """Entries whose address and text name different districts refuse their page; one address twice on a page counts once."""
    def one(c, d, n):
        shown = F.when((c % 101 == 0) & (n % 5 > 0) & (n % 4 > 0), "999").otherwise(d)
        return F.concat(F.lit('<li><a id="x" href="/Senators/S'), d, F.lit('">'), "c_name", F.lit("</a> District "), shown, F.when(c % 9 > 0, " Democrat ").otherwise(" none "), F.when(c % 8 > 0, "Consists of Lake County").otherwise("1999-2001"), F.lit(" Tracker</li>"))

    rows = rosters.district_entries(pages(t, one), "page_id", "html", "/Senators/S")
    return outcome(rosters.gate(rows, manifest(t), "page_id", matches=F.col("matches")))
