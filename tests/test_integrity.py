"""JSON walks, lineage, provenance, work, identities and terms on rows of their own."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from recordspine import functions as fn
from recordspine.operators import extract, identity, json_walk, lineage, registry, terms, work


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def walk(v, path="", name=""):
    if isinstance(v, list):
        return [x for i, e in enumerate(v) for x in walk(e, f"{path}[{i}]", name)]
    if isinstance(v, dict):
        return [x for k, e in v.items() for x in walk(e, f"{path}.{k}" if path else k, k)]
    return [(path, name, None if v is None else str(v).lower() if isinstance(v, bool) else str(v))]


def test_leaves_of_any_depth(spark):
    deep = "x"
    for i in range(14):
        deep = [deep, i] if i % 2 else {f"k{i}": deep, "n": None}
    bodies = [{"a": [1, True, {"b": ["x", [], {}]}], "ä.b": {"c": None}}, [["p"], "q"], "text", 3, {}, [], deep]
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(90, None), (91, "{broken"), (92, '{"a":1,"a":2}')], "id int, body string")
    got = sorted(map(tuple, json_walk.leaves(rows, ["id"], "body").collect()), key=str)
    want = [(i, *x) for i, b in enumerate(bodies) for x in walk(b)] + [(91, None, "", None), (92, None, "", None)]
    assert got == sorted(want, key=str)
    assert json_walk.leaves(rows.limit(0), ["id"], "body").count() == 0


def test_promotions_are_found_wherever_they_stand(spark):
    bodies = ['{"extraction_status":"verified"}', '{"a":{"extraction_status":"verified"}}', '{"status":["x",["VERIFIED"]]}', '{"status":{"name":"verified"}}', '{"st\\u0061te":"\\u0076erified"}', '[{"publication":"published"}]', '{"state":"approved"}', "{verified", '{"reviewState":"publication_eligible","x":"canonical"}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    assert pairs(json_walk.promoted_terms(rows, ["id"], "body")) == sorted([(1, "a.extraction_status", "verified"), (2, "status[1][0]", "verified"), (4, "state", "verified"), (5, "[0].publication", "published"), (7, None, None), (8, "reviewState", "publication_eligible")], key=str)


def test_lineage_names_the_first_break(spark):
    top = spark.createDataFrame([(i, "s") for i in range(6)], "job int, state string")
    mid = spark.createDataFrame([(i, i, f"c{i}") for i in range(6)], "run int, job int, cap string")
    low = spark.createDataFrame([(i, i % 6, "r") for i in range(12)] + [(20, 99, "r"), (21, None, "r")], "link int, run int, role string")
    hops = lambda a, b, c: [lineage.Hop("job", a, "job", ["state"]), lineage.Hop("run", b, "run", ["cap"], "job"), lineage.Hop("link", c, "link", ["role"], "run")]
    was = lineage.chained(hops(top, mid, low))
    assert lineage.first_break(was, lineage.chained(hops(top, mid, low)), "link", ["job", "run", "link"]).count() == 0
    top2 = top.withColumn("state", F.when(F.col("job") == 1, None).otherwise(F.col("state"))).where("job <> 2")
    mid2 = mid.withColumn("cap", F.when(F.col("run") == 3, "other").otherwise(F.col("cap"))).where("run <> 4")
    low2 = low.withColumn("role", F.when(F.col("link").isin(0, 1), "new").otherwise(F.col("role"))).where("link <> 5")
    got = {r.link: (r.hop, r.kind) for r in lineage.first_break(was, lineage.chained(hops(top2, mid2, low2)), "link", ["job", "run", "link"]).collect()}
    assert got == {0: ("link", "changed"), 1: ("job", "changed"), 2: ("job", "missing"), 3: ("run", "changed"), 4: ("run", "missing"), 5: ("link", "missing"), 7: ("job", "changed"), 8: ("job", "missing"), 9: ("run", "changed"), 10: ("run", "missing")}


def test_provenance_and_join_on_any_key(spark):
    register = spark.createDataFrame([(1, "k", "u", True, "P"), (2, "k", "v", True, "S"), (3, "z", "w", True, "P"), (4, "z", "w", True, "S"), (5, "off", "off", False, "P"), (6, None, "n", True, "P"), (7, "k", None, True, "P")], "source_id int, source_key string, source_url string, active boolean, authority_tier string")
    sources = spark.createDataFrame([(1, "k", "u"), (2, "k", "x"), (3, "x", "v"), (4, "z", "w"), (5, "off", "off"), (6, None, "n"), (7, None, None), (1, "k", "u")], "n int, source_key string, source_url string")
    got = pairs(registry.source_provenance(sources, register).select("n", "outcome", "canonical_source_id", "canonical_authority_tier"))
    assert got == sorted([(1, "exact", 1, "P"), (1, "exact", 1, "P"), (2, "mismatch", None, None), (3, "mismatch", None, None), (4, "ambiguous", None, None), (5, "missing", None, None), (6, "mismatch", None, None), (7, "missing", None, None)], key=str)
    right = register.select("source_id", F.col("source_key").alias("k"), F.col("source_url").alias("u"))
    both = pairs(registry.any_key_join(sources.where("n < 7").dropDuplicates(["n"]), right, [("source_key", "k"), ("source_url", "u")]).select("n", "source_id"))
    assert both == [(1, 1), (1, 2), (1, 7), (2, 1), (2, 2), (2, 7), (3, 2), (4, 3), (4, 4), (5, 5), (6, 6)]


def test_ready_work_and_recovery(spark):
    at, late, soon = datetime(2024, 1, 5), datetime(2024, 1, 1), datetime(2024, 1, 9)
    jobs = spark.createDataFrame([(1, "queued", 0, 3, late, None), (2, "queued", 3, 3, late, None), (3, "queued", 0, 3, soon, None), (4, "queued", 0, 3, None, None), (5, "leased", 1, 3, late, late), (6, "leased", 1, 3, late, soon), (7, "leased", 3, 3, late, late), (8, "queued", 0, 3, late, None), (9, "failed", 3, 3, late, None), (10, "succeeded", 1, 3, late, None)],
                                 "job_id int, status string, attempt_count int, max_attempts int, scheduled_for timestamp_ntz, lease_expires_at timestamp_ntz")
    deps = spark.createDataFrame([(8, 9), (1, 10), (4, 10), (4, 77)], "job_id int, prerequisite_job_id int")
    now = F.lit(at).cast("timestamp_ntz")
    assert sorted(r.job_id for r in work.ready(jobs, deps, now).collect()) == [1, 4, 5]
    got = {r.job_id: (r.status, r.error_class, r.scheduled_for, r.completed_at) for r in work.recover_leases(jobs, now).where("job_id IN (5, 6, 7)").collect()}
    assert got == {5: ("queued", "lease_expired", at, None), 6: ("leased", None, late, None), 7: ("dead_letter", "lease_attempts_exhausted", late, at)}
    runs = spark.createDataFrame([(1, 5, "started"), (2, 5, "succeeded"), (3, 6, "started"), (4, 7, "started")], "worker_run_id int, job_id int, status string")
    assert [r.status for r in work.close_stale_runs(runs, jobs, now).orderBy("worker_run_id").collect()] == ["failed", "succeeded", "started", "failed"]


def test_person_resolution(spark):
    people = spark.createDataFrame([(1, "José Peña", " A1 ", None), (2, "Jose Pena", None, "W2"), (3, "Max Roe", None, " "), (4, "MAX  ROE", None, None), (5, "Ann Lee", None, None)], "person_id int, canonical_name string, bioguide string, wikidata string")
    held = spark.createDataFrame([(10, 1), (11, 3), (11, 4), (12, 4), (12, 4), (12, 5)], "seat_id int, person_id int")
    seats = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "seat_id int, jurisdiction_id string")
    rows = [(1, "?", 3, None, None, None, None), (2, "?", 99, None, None, "a1", None), (3, "Nobody", None, None, None, "a1", "w2"), (4, "jose pena", None, 10, None, " ", None), (5, "max roe", None, 11, "z", None, None), (6, "max roe", None, 11, None, None, None), (7, "Max Roe", None, None, None, None, None), (8, "ann lee", None, None, None, None, None), (9, "“”", None, 12, "z", None, None)]
    c = spark.createDataFrame(rows, "candidate_id int, canonical_name string, given_id int, seat_id int, jurisdiction_id string, bioguide string, wikidata string")
    out = identity.resolve_persons(people, held, seats, c, ["bioguide", "wikidata"])
    got = {r.candidate_id: (r.resolved_id, r.status, r.method) for r in out.collect()}
    assert got == {1: (3, "matched", "person_id"), 2: (None, "unmatched", "none"), 3: (1, "matched", "external_identifier"), 4: (1, "matched", "normalized_name_seat"), 5: (4, "matched", "normalized_name_seat"), 6: (None, "unmatched", "none"), 7: (None, "conflict", "name_only"), 8: (None, "unmatched", "none"), 9: (None, "unmatched", "none")}
    after = {r.person_id: r for r in identity.upsert_persons(people, out, ["bioguide", "wikidata"]).collect()}
    assert (after[1].bioguide, after[1].wikidata, after[1].canonical_name, after[1].written) == ("a1", "w2", "José Peña", 2)
    assert 7 not in after and after[8].canonical_name == "ann lee" and after[5].written == 0


def test_terms_end_when_another_runs(spark):
    kind = "seat_id int, person_id int, start_date date, end_date date, status string"
    d = lambda y: date(y, 1, 1)
    stored = spark.createDataFrame([(1, 1, d(2000), None, "current"), (1, 2, None, d(2001), "acting"), (2, 1, d(2000), None, "completed"), (3, 1, None, None, "current")], kind)
    delta = spark.createDataFrame([(1, 3, d(2004), None, "current"), (3, 1, None, None, "acting")], kind)
    got = {(r.seat_id, r.person_id): (r.end_date, r.status, r.inserted, r.demoted) for r in terms.upsert_terms(stored, delta, F.lit(d(2005))).collect()}
    assert got == {(1, 1): (d(2005), "completed", False, True), (1, 2): (d(2001), "completed", False, True), (1, 3): (None, "current", True, False), (2, 1): (None, "completed", False, False), (3, 1): (None, "acting", False, False)}


def test_names_parties_and_links(spark):
    names = {"Jane Doe": True, "Official Website": False, "Welcome Home": False, "Vacant": False, "Tbd": False, "Vacant Seat": True, "Mary Ann Lee Van Der Berg": True, "Ann O’Neil": True, "Max Roe III,": True, "jane doe": False, "State of Florida": False, "A B C D E F G": False, "": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", fn.looks_like_person_name(F.col("n")).alias("is")).collect()
    assert {r.n: r["is"] for r in got} == names
    parties = {"Representative": "Representative", "Repeal Party": "Repeal Party", "Independent": "Independent", "indigenous": "indigenous", "R": "Republican", "d": "Democratic", "I": "Independent", "Democrat": "Democratic", "No Party": "No Party Affiliation", "": None}
    assert {r.p: r.x for r in spark.createDataFrame([(p,) for p in parties], "p string").select("p", fn.party(F.col("p")).alias("x")).collect()} == parties
    html = """<a class="x" href="/a">A</a><A HREF = '/b&amp;c'>B</A><a href=/d id=1>D</a><a name="n">N</a><a data-href="/no">x</a><a href="">e</a>"""
    assert spark.range(1).select(fn.links(F.lit(html)).alias("l")).first().l == ["/a", "/b&c", "/d"]
    pages = ["""<meta property="og:title" content="Official Website"><h1>Jane Doe | Office</h1>""", """<meta content='Max Roe' name='twitter:title'><h1>Other Name</h1>""", "<title>District 3 - Vacant</title>", "<h1>News</h1>"]
    assert [r.n for r in spark.createDataFrame(list(enumerate(pages)), "i int, h string").orderBy("i").select(extract.profile_name(F.col("h")).alias("n")).collect()] == ["Jane Doe", "Max Roe", "Vacant", None]
