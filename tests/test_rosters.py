from pyspark.sql import functions as F

from recordspine.operators import extract, rosters

CODES = {"Ohio": "OH", "Guam": "GU", "Iowa": "IA"}


def frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "id int, html string")


def row(district, member, *more):
    return "<tr>" + "".join(f"<td>{x}</td>" for x in (district, member, *(more or ("R",)))) + "</tr>"


def test_seats_by_caption_heading_and_vacancy(spark):
    head = "<tr><th>District</th><th>Name</th><th>Party</th></tr>"
    html = (
        f"<table><caption> Ohio </caption>{head}{row('1st', '<a id=x></a><a class=y href=\"/m/1?a=1&amp;b=2\">Roe, Jane</a>', 'D', '12', '555', ' Ways | Means |')}{row('07', 'Poe, Max - Vacancy')}{row('2nd', 'No Link')}<tr><td>3rd</td><td><a href='/s'>Short</a></td></tr></table>"
        f"<table><tr><th colspan=3>Guam</th></tr>{head}{row('Delegate', '<a href=\"/m/2\">Li, Jo</a>')}<tr><th colspan=3>Iowa</th></tr>{row('At Large', '<a href=\"/m/3\">Ng, Al</a>')}</table>"
        f"<table><caption>Nowhere</caption>{row('1st', '<a href=\"/m/4\">Lost</a>')}</table>"
    )
    got = rosters.seat_tables(frame(spark, html, None, ""), "id", "html", CODES).orderBy("table", "row").collect()
    assert [(r.unit, r.name, r.former_name, r.href, r.vacant) for r in got] == [
        ("OH|1", "Roe, Jane", None, "/m/1?a=1&b=2", False), ("OH|7", None, "Poe, Max", None, True), ("GU|DEL", "Li, Jo", None, "/m/2", False), ("IA|AL", "Ng, Al", None, "/m/3", False)]
    assert (got[0].party, got[0].room, got[0].phone, got[0].committees) == ("D", "12", "555", ["Ways", "Means"])


def test_term_entries(spark):
    a = lambda href, text: f'<a class="m" href="{href}">{text}</a>'
    whole = "Ann Roe Republican — District: 007 Lake, Polk 11/05/24 - 11/03/26"
    html = a("/d?MemberId=5", whole) + a("/d?MemberId=5", whole) + a("/d?MemberId=6", "Al Li Democrat - District: 8 11/05/24 - 11/03/26 (Resigned 2025)") + a("/e", whole) + a("/d?x=1", "See all") + a("/d?MemberId=7", "Jo Ng Democratic - District: 1234 Lake 11/05/24 - 11/03/26")
    got = rosters.term_entries(frame(spark, html, None), "id", "html", r"/d\?.*").orderBy("pos").collect()
    assert [(r.unit, r.name, r.party, r.counties, r.start, r.status, r.active, r.member_id) for r in got] == [
        ("7", "Ann Roe", "Republican", "Lake, Polk", "11/05/24", None, True, "5"), ("8", "Al Li", "Democratic", None, "11/05/24", "Resigned 2025", False, "6")]


def test_district_entries(spark):
    html = ('<a href="/S/S1">Ann Roe</a> 1 Republican Consists of Lake County <a id="2" href="/S/S02">Al Li</a> District 3 Democrat Consists of Polk <a href="/S/S1">Ann Roe</a> 1 Republican Consists of Lake '
            '<a href="/S/S4">Old Member</a> 4 Democrat 1999 <a href="/S/S5"></a> Democrat Consists of X <a href="/S/S6">Jo Ng</a> Democrat Consists of Bay Former Senators')
    got = rosters.district_entries(frame(spark, html, None), "id", "html", "/S/S").orderBy("pos").collect()
    assert [(r.unit, r.name, r.counties, r.matches) for r in got] == [("1", "Ann Roe", "Consists of Lake County", True), ("2", "Al Li", "Consists of Polk", False), ("6", "Jo Ng", "Consists of Bay", True)]


def test_gate_refuses_whole_sets(spark):
    rows = [("a", "1", True), ("a", "2", True), ("b", "1", True), ("b", "1", True), ("c", "1", False), ("d", "1", True), ("d", "2", True), ("d", "3", True)]
    records = spark.createDataFrame(rows, "key string, unit string, ok boolean")
    manifest = spark.createDataFrame([(k, 1, 2) for k in "abcde"], "key string, expected_minimum int, expected_maximum int")
    gates = rosters.gate(records, manifest, "key", matches=F.col("ok"))
    assert {r.key: (r.n, r.status, r.reasons) for r in gates.collect()} == {
        "a": (2, "accepted", []), "b": (2, "refused", ["repeated_unit"]), "c": (1, "refused", ["mismatch"]), "d": (3, "refused", ["too_many"]), "e": (0, "refused", ["too_few"])}
    assert sorted((r.key, r.unit) for r in rosters.accepted(records, gates, "key").collect()) == [("a", "1"), ("a", "2")]
    assert rosters.gate(records.limit(0), manifest, "key").where("status = 'refused'").count() == 5


def test_page_that_begins_with_an_anchor(spark):
    got = extract.anchors(frame(spark, '<a href="/x">A</a> one <a href="/y">B</a> two', "none", None), "id", "html", "/").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, 1, "/x", "A", "one"), (0, 2, "/y", "B", "two")]


def test_rows_of_a_long_table_do_not_carry_its_text(spark):
    html = "<table><caption>Ohio</caption>" + "".join(row(f"{i % 900}", f'<a href="/m/{i}">Roe {i}</a>') for i in range(3000)) + "</table>"
    got = rosters.seat_tables(frame(spark, html), "id", "html", CODES)
    assert got.where("state = 'OH' AND name IS NOT NULL").count() == 3000
    made = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line and "[row#" in line]
    assert len(made) == 1
    body = got._jdf.queryExecution().optimizedPlan().toString().split(made[0])
    assert "html_text" not in body[0] and "caption[^>]" not in body[0]  # nothing above it reads a caption out of the text
