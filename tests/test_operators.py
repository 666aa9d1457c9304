import json
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspine import functions as fn
from recordspine.operators import extract, graph, places, quality, relational
from recordspine.operators.ordering import with_position
from recordspine.sources import tables


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_overlays_non_null_and_keeps_first(spark):
    base = spark.createDataFrame([(1, None, "a", "x"), (2, "k", "b", "y")], "id int, sub string, name string, state string")
    delta = spark.createDataFrame([(1, None, "n", None), (3, "k", "c", "z")], "id int, sub string, name string, state string")
    out = relational.upsert(base, delta, ["id", "sub"], keep=["name"]).select("id", "sub", "name", "state")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None, "a", "x"), (2, "k", "b", "y"), (3, "k", "c", "z")]


def test_valid_at_open_bounds_and_diff(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 5, 9), (3, 9, None), (4, None, 5)], "id int, valid_from int, valid_to int")
    assert sorted(r.id for r in relational.valid_at(rows, F.lit(5)).collect()) == [1, 2]
    old, new = (spark.createDataFrame(x, "k int, v string, w string") for x in ([(1, "a", None), (2, "b", "c")], [(2, "b", "d"), (3, "n", None)]))
    got = {(r.k, r.field): (r.change, r.old_value, r.new_value) for r in relational.full_diff(old, new, ["k"], ["v", "w"]).collect()}
    assert got == {(1, "v"): ("removed", "a", None), (2, "w"): ("changed", "c", "d"), (3, "v"): ("created", None, "n")}


def test_identity_needs_a_unique_hit_and_namesakes_conflict(spark):
    base = spark.createDataFrame([(1, "x", "Ann", "p"), (2, None, "Bob", "p"), (3, None, "Bob", "p"), (4, "y", "Cy", "q"), (5, "y", "Di", "q")], "person_id int, ext string, name string, party string")
    delta = spark.createDataFrame([(10, "x", "Other", "z"), (11, None, "Bob", "p"), (12, None, "Ann", "p"), (13, None, "Ann", "q"), (14, "y", "Cy", "q")], "d int, ext string, name string, party string")
    got = {r.d: (r.method, r.resolved_id) for r in relational.resolve_identity(base, delta, "ext", "name", "party").collect()}
    assert got == {10: ("external_id", 1), 11: ("conflict", None), 12: ("name_in_scope", 1), 13: ("new", None), 14: ("conflict", None)}


def test_cycles_chain_and_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 8), (7, 9), (8, 10), (9, 10)], "job int, pre int")
    assert pairs(graph.cyclic_edges(edges, "job", "pre")) == [(1, 2), (2, 3), (3, 1)]
    assert graph.cyclic_edges(edges.where("job > 4"), "job", "pre").count() == 0


def test_ancestors(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string")
    assert pairs(graph.ancestors(nodes, "id", "parent")) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1)]


def test_streaks_and_change_points(spark):
    runs = spark.createDataFrame([(1, i, s) for i, s in enumerate("fsffsfff")], "job int, n int, s string")
    assert [r.failures for r in relational.streaks(runs, "job", ["n"], F.col("s") == "f").orderBy("n").collect()] == [1, 0, 1, 2, 0, 1, 2, 3]
    checks = spark.createDataFrame([(1, t, v) for t, v in enumerate([5, 5, 6, 6, 5])], "src int, t int, v int")
    assert [(r.changed, r.last_changed_at) for r in relational.change_points(checks, "src", "t", "v").orderBy("t").collect()] == [(True, 0), (False, 0), (True, 2), (False, 2), (True, 4)]


def test_violations_and_first(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a", -1), (3, "", -2)], "id int, name string, n int")
    rules = {"name_missing": F.coalesce("name", F.lit("")) == "", "negative": F.col("n") < 0}
    assert pairs(quality.violations(df, ["id"], rules)) == [(1, "name_missing"), (2, "negative"), (3, "name_missing"), (3, "negative")]
    assert [r[0] for r in df.orderBy("id").select(quality.first_violation(rules)).collect()] == ["name_missing", "negative", "name_missing"]


def test_points_in_polygons(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    shapes = spark.createDataFrame([("square", ring((0, 0), (4, 0), (4, 4), (0, 4))), ("ell", ring((2, 2), (9, 2), (9, 3), (3, 3), (3, 9), (2, 9))), ("line", ring((0, 0), (9, 9)))], "boundary_id string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.5, 2.5), (3, 8.0, 2.5), (4, 8.0, 8.0), (5, 2.5, 8.5), (6, -3.0, 1.0)], "point_id int, x double, y double")
    assert pairs(places.locate(points, shapes, 2.0)) == [(1, "square"), (2, "ell"), (2, "square"), (3, "ell"), (5, "ell")]


def test_names_slugs_and_ids(spark):
    lit = F.lit
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    row = spark.range(1).select(
        fn.normalize_person_name(lit("José  “Pepe” Peña-O'Neil")), fn.normalize_person_name(lit("Peña"), strict=True), fn.slug(lit(" Át Large! ")), fn.uuid5(ns, lit("seat:1")), fn.uuid5(ns, lit("ü")), fn.name_parts(lit("Doe, Jane A.")), fn.name_parts(lit("Jane Doe")),
        fn.iso_from_us_date(lit("1/5/24")), fn.iso_from_us_date(lit("13/45/2024")), fn.party(lit("R")), fn.district(lit("At Large")), fn.district(lit("District 07")), fn.interval_seconds(lit("7d")), fn.interval_seconds(lit("x")), fn.initials(lit("ada b lovelace")), fn.humanize(lit("campaign_finance"))).first()
    assert list(row)[:5] == ["jose pepe pena oneil", "pen a", "at-large", str(uuid.uuid5(uuid.UUID(ns), "seat:1")), str(uuid.uuid5(uuid.UUID(ns), "ü"))]
    assert tuple(row[5]) == ("Jane A.", "Doe", "Jane A. Doe") and tuple(row[6]) == ("Jane", "Doe", "Jane Doe")
    assert [str(x) for x in list(row)[7:]] == ["2024-01-05", "None", "Republican", "AL", "07", "604800", "None", "AB", "Campaign Finance"]


def test_maps_and_excerpts(spark):
    m = spark.sql("SELECT map('a', '1', 'b', '2') AS old, map('b', '3') AS new").select(fn.merge_external_ids(F.col("old"), F.col("new")).alias("m"), fn.first_external_id(F.col("old"), ["z", "b"]).alias("f")).first()
    assert m.m == {"a": "1", "b": "3"} and m.f == "2"
    x = spark.range(1).select(fn.excerpt(F.lit("äß the end"), F.lit("the"), 3).alias("x"), fn.excerpt(F.lit("none"), F.lit("zzz")).alias("y")).first()
    assert tuple(x.x) == (5, "äß the en") and tuple(x.y) == (None, None)


def test_json_sources(spark, tmp_path):
    (tmp_path / "a" / "source-discovery").mkdir(parents=True)
    (tmp_path / "a" / "one.json").write_text(json.dumps({"stagingRecordId": "1", "displayName": "Ann", "committeeAssignments": ["x"]}, indent=1))
    (tmp_path / "a" / "source-discovery" / "two.json").write_text(json.dumps({"stagingRecordId": "2"}))
    (tmp_path / "a" / "bad.json").write_text("{not json")
    got = tables.read_staging(spark, str(tmp_path)).cache()
    assert {(r.stagingRecordId, r.is_discovery) for r in got.collect()} == {("1", False), ("2", True), (None, False)}
    assert got.where("_corrupt_record IS NOT NULL").count() == 1
    api = spark.createDataFrame([('[{"n":"a"}]',), ('{"results":[{"n":"b"},{"n":"c"}]}',)], "payload string")
    assert sorted(r.n for r in tables.json_rows(api, "payload", "struct<n:string>").select("row.n").collect()) == ["a", "b", "c"]
    env = spark.createDataFrame([("e1", '{"claims":[{"k":"a","v":"1"},{"k":"b","v":null}]}')], "envelope_id string, body string")
    assert pairs(tables.unpack_envelope(env, "claims", "struct<k:string,v:string>").fillna("-")) == [("e1", "a", "1"), ("e1", "b", "-")]


def test_csv_and_xml_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Full Name,Office,Dist\nAnn,Mayor,3\n,Clerk,\n")
    got = tables.read_csv_directory(spark, str(tmp_path / "d.csv"), {"name": ["name", "full_name"], "office": ["office"], "district": ["district", "dist"], "party": ["party"]})
    assert [tuple(r) for r in got.collect()] == [("Ann", "Mayor", "3", None), (None, "Clerk", None, None)]
    (tmp_path / "r.xml").write_text("<contact_information><member><first_name>A</first_name><state>FL</state></member><member><first_name>B</first_name></member></contact_information>")
    schema = T.StructType([T.StructField("first_name", T.StringType()), T.StructField("state", T.StringType())])
    assert sorted(map(str, (tuple(r) for r in tables.read_xml_roster(spark, str(tmp_path / "r.xml"), "member", schema).collect()))) == ["('A', 'FL')", "('B', None)"]


def test_snapshot_sink_appends_new_contents_once(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = lambda *x: spark.createDataFrame([(s, c) for s, c in x], "source_key string, content string").withColumn("retrieved_at", F.to_timestamp(F.lit("2024-02-03 10:00:00")))
    assert tables.append_snapshots(rows(("s", "a"), ("s", "a"), ("t", "a")), path).count() == 2
    assert tables.append_snapshots(rows(("s", "a"), ("s", "b")), path).count() == 1
    assert spark.read.parquet(path).count() == 3


def test_record_sets_and_guards(spark, tmp_path):
    path = str(tmp_path / "sets")
    tables.replace_records(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int"), path, "k")
    tables.replace_records(spark.createDataFrame([("a", 9)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.json(path).collect()) == [("a", 9), ("b", 3)]
    df = spark.createDataFrame([(1, "n", "secret")], "person_id int, canonical_name string, notes string")
    assert tables.public("persons", df).columns == ["person_id", "canonical_name"]
    with pytest.raises(PermissionError):
        tables.public("jobs", df)
    with pytest.raises(ValueError, match="notes"):
        tables.assert_columns(df, T.StructType([T.StructField("person_id", T.IntegerType()), T.StructField("canonical_name", T.StringType())]))
    with pytest.raises(ValueError, match="another type: person_id"):
        tables.assert_columns(df.select("person_id"), T.StructType([T.StructField("person_id", T.LongType())]))
    with pytest.raises(ValueError, match="forbidden columns: route"):
        tables.assert_columns(df.select(F.col("notes").alias("route")), T.StructType([T.StructField("route", T.StringType())]))


def test_entities(spark):
    text = ["a &amp; b", "&amp;lt;", "&#233;&#x1F600;!", "&#0;&#x110000;&#xD800;", "&MDASH;&unknown;&nbsp;x", "AT&T; &", None, ""]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(text)], "i int, x string").select("i", fn.decode_entities(F.col("x")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == ["a & b", "&lt;", "é😀!", "&#0;&#x110000;&#xD800;", "—&unknown; x", "AT&T; &", None, ""]
    assert spark.range(1).select(fn.html_text(F.lit("<p>A&#160;&rsquo;s</p><script>x</script> B"))).first()[0] == "A ’s B"


def test_extraction(spark):
    html = '<h1>Members</h1><a href="/Senators/S1">Doe, Jane</a> District: 4 Republican <a href="/Senators/S2">Vacant</a> District: 9 <table><tr><th>A</th><td>x &amp; y</td></tr><tr><td>2</td></tr></table>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    assert pairs(extract.directory_members(pages, "page_id", "html", "/Senators/").fillna("-")) == [(1, "/Senators/S1", "Doe, Jane", 4, "Republican", False), (1, "/Senators/S2", "Vacant", 9, "-", True)]
    assert [(r.row, list(r.cells)) for r in extract.table_rows(pages, "page_id", "html").orderBy("row").collect()] == [(0, ["A", "x & y"]), (1, ["2"])]
    cards = spark.createDataFrame([(1, '<div class="card">Governor <a href="/g">G</a><a href="/g">G</a></div><div class="card">Clerk</div>'), (2, '<div class="card">Governor <a href="/g">G</a><a href="/h">H</a></div>')], "page_id int, html string")
    assert pairs(extract.single_card(cards, "page_id", "html", "Governor")) == [(1, "/g")]
    named = spark.range(1).select(extract.profile_name(F.lit("<title>News</title><h1>Jane Q. Doe</h1>")), extract.profile_name(F.lit("<p>x</p>"))).first()
    assert tuple(named) == ("Jane Q. Doe", None)


def test_roster_lines_and_labels(spark):
    text = ["Directory", "Mayor", "Jane Doe (Term: 2026)", "noise 12", "Sheriff", "Max Roe", "Phone: 555 1234"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id int, pos int, line string")
    assert [(r.office, r.name, r.term_end) for r in extract.roster_lines(lines).orderBy("pos").collect()] == [("Mayor", "Jane Doe", 2026), ("Sheriff", "Max Roe", None)]
    assert pairs(extract.label_values(lines, "doc_id", "line")) == [(1, "phone", "555 1234")]


def test_edges_between_cycles_are_not_cyclic(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 9), *((i, i + 1) for i in range(20, 60)), (60, 20), (30, 4)], "job long, pre long")
    want = [(1, 2), (2, 1), (4, 5), (5, 4), (6, 6), *((i, i + 1) for i in range(20, 60)), (60, 20)]
    assert pairs(graph.cyclic_edges(edges, "job", "pre")) == sorted(want)


def test_ancestors_of_a_long_chain_and_of_a_ring(spark):
    chain = spark.createDataFrame([(i, i + 1 if i < 12 else None) for i in range(13)], "id long, parent long")
    assert pairs(graph.ancestors(chain, "id", "parent")) == sorted((i, j, j - i) for i in range(13) for j in range(i + 1, 13))
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"), "id", "parent")


def test_positions_are_one_order(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "x long, g long")
    got = {r.x: r.position for r in with_position(df, [F.desc("x")]).collect()}
    assert got == {x: 1000 - x for x, _ in rows}
    inside = with_position(df, [F.asc("x")], "p", within=["g"]).collect()
    for g in range(3):
        assert [r.p for r in sorted((r for r in inside if r.g == g), key=lambda r: r.x)] == list(range(1, sum(g == y for _, y in rows) + 1))
    assert with_position(df.limit(0), [F.asc("x")]).count() == 0


def test_presence_by_category(spark):
    fields = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "y")], "field_key string, category string")
    claims = spark.createDataFrame([("a", None, "verified"), ("a", "v", "stale"), ("b", "", "stale"), ("c", "v", None), ("z", "v", "verified")], "field_key string, normalized_value string, verification_state string")
    assert pairs(quality.presence_by_category(fields, claims, ["verified"])) == [("uncategorized", 1, 1), ("x", 1, 2), ("y", 0, 1)]
    assert pairs(quality.presence_by_category(fields, claims.limit(0), ["verified"])) == [("uncategorized", 0, 1), ("x", 0, 2), ("y", 0, 1)]


def test_first_spellings_in_the_row(spark):
    rows = [(1, "b A  a B c"), (2, ""), (3, None), (4, " x X x "), (5, " ".join(f"W{i % 7000} w{i % 7000}" for i in range(20000)))]
    out = spark.createDataFrame(rows, "id int, text string").select("id", fn.first_spellings(F.split("text", " ")).alias("w"))
    got = {r.id: r.w for r in out.collect()}
    assert got == {1: ["b", "A", "c"], 2: [], 3: [], 4: ["x"], 5: [f"W{i}" for i in range(7000)]}
    from recordspine.plans import catalog
    assert "Exchange" not in catalog.queries()["ordered_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
