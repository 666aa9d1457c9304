import copy
import json

import pytest
from pyspark.sql import functions as F

from recordspine.operators import submissions as s

NONE = {p: [] for p in ("sources", "retrievals", "dataset_units", "gis_boundaries", "relationships", "warnings", "gaps", "monitoring_recommendations")}
EVIDENCE = {"evidence_key": "e1", "source_url": "https://h.gov/a", "retrieved_at": "2024-01-02T00:00:00Z", "mime_type": "text/html", "byte_length": 3, "sha256": "0" * 64, "method": "get", "parser_version": "1", "content_base64": "YWJj"}
GOOD = NONE | {
    "contract_version": "v1", "extraction_status": "extracted_unreviewed", "capability": "profile", "evidence": [EVIDENCE],
    "producer": {"producer_id": "p", "producer_version": "1"}, "job": {"job_id": "j", "research_work_identity": "w" * 16}, "cohort": {"cohort_key": "k", "state": "FL"},
    "entities": {k: [] for k in s.OBJECTS["entities"]} | {"person_candidates": [{"candidate_key": "p1", "attributes": {"a": [1]}, "evidence_keys": ["e1"]}]},
    "claims": [{"claim_key": "c1", "subject_candidate_key": "p1", "field_key": "contact", "value": None, "evidence_keys": ["e1"]}],
    "currentness": {"current_as_of": "2024-01-02T00:00:00Z"},
}


def changed(path, value):
    """GOOD with another value at a path; the value del takes the field away."""
    out = copy.deepcopy(GOOD)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is del_:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


del_ = object()
CASES = [
    (("evidence", 0, "sha256"), "g" * 64, "evidence[0].sha256", "bad_hash"),
    (("evidence", 0, "sha256"), "0" * 63, "evidence[0].sha256", "too_short"),
    (("evidence", 0, "source_url"), "mailto:a@b", "evidence[0].source_url", "bad_url"),
    (("evidence", 0, "retrieved_at"), "yesterday", "evidence[0].retrieved_at", "bad_time"),
    (("evidence", 0, "byte_length"), 1.5, "evidence[0].byte_length", "not_a_count"),
    (("evidence", 0, "byte_length"), -1, "evidence[0].byte_length", "not_a_count"),
    (("evidence", 0, "byte_length"), "3", "evidence[0].byte_length", "not_a_count"),
    (("evidence", 0, "content_base64"), "YWJ=", "evidence[0].content_base64", "bad_base64"),
    (("evidence", 0, "content_base64"), None, "evidence[0].content_base64", "not_text"),
    (("evidence", 0, "mime_type"), "m" * 513, "evidence[0].mime_type", "too_long"),
    (("evidence", 0, "more"), 1, "evidence[0].more", "not_allowed"),
    (("evidence", 0, "method"), del_, "evidence[0].method", "required"),
    (("evidence", 0), 7, "evidence[0]", "not_an_object"),
    (("sources",), {}, "sources", "not_a_list"),
    (("claims", 0, "evidence_keys"), [], "claims[0].evidence_keys", "too_few"),
    (("claims", 0, "evidence_keys"), ["e1", 2], "claims[0].evidence_keys", "not_texts"),
    (("claims", 0, "value"), del_, "claims[0].value", "required"),
    (("entities", "person_candidates", 0, "identity_resolution_required"), "yes", "entities.person_candidates[0].identity_resolution_required", "not_boolean"),
    (("entities", "person_candidates", 0, "attributes"), [], "entities.person_candidates[0].attributes", "not_an_object"),
    (("entities", "seat_candidates"), del_, "entities.seat_candidates", "required"),
    (("relationships",), [{"subject_candidate_key": "p1", "object_candidate_key": "p1", "relationship_type": "t", "amount": "1", "evidence_keys": ["e1"]}], "relationships[0].amount", "not_a_number"),
    (("job", "research_reservation"), {"reservation_id": "r", "lease_expires_at": ""}, "job.research_reservation.lease_expires_at", "too_short"),
    (("extraction_status",), "verified", "extraction_status", "bad_status"),
    (("contract_version",), "v0", "contract_version", "unsupported_contract"),
    (("contract_version",), del_, "contract_version", "unsupported_contract"),
    (("gis_boundaries",), [{"boundary_key": "b", "source_url": "http://h", "effective_status": "s", "effective_from": "2024-1-1"}], "gis_boundaries[0].effective_from", "too_short"),
]


def frame(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id int, body string")


def test_each_rule(spark):
    got = s.shape_violations(frame(spark, [json.dumps(GOOD), *(changed(p, v) for p, v, _, _ in CASES)]), "id", "v1").collect()
    assert sorted(map(tuple, got)) == sorted((i + 1, path, rule) for i, (_, _, path, rule) in enumerate(CASES))


def test_no_objects_and_repeated_keys(spark):
    got = s.shape_violations(frame(spark, ["", None, "[1]", '"a"', '{"a": 1, "a": 2}', "{}"]), "id", "v1").collect()
    assert sorted(map(tuple, got)) == [(i, "", "not_an_object") for i in range(5)] + [(5, "contract_version", "unsupported_contract")]


def test_many_items(spark):
    """Every item of a long list is judged, not a first part of it."""
    items = [EVIDENCE | {"evidence_key": f"e{i}", "sha256": "0" * 63 if i % 1000 == 999 else "0" * 64} for i in range(5000)]
    got = s.shape_violations(frame(spark, [changed(("evidence",), items)]), "id", "v1").collect()
    assert sorted(r.path for r in got) == sorted(f"evidence[{i}].sha256" for i in range(999, 5000, 1000))


def test_references_and_outcomes(spark):
    tie = {"subject_candidate_key": "p1", "object_candidate_key": "p9", "relationship_type": "t", "evidence_keys": ["e1", "e9"]}
    asks = copy.deepcopy(GOOD)
    asks["entities"]["person_candidates"][0]["identity_resolution_required"] = True
    bodies = [json.dumps(GOOD), changed(("claims", 0, "subject_candidate_key"), "e1"), changed(("relationships",), [tie]), changed(("entities", "person_candidates", 0, "evidence_keys"), ["e7"]),
              changed(("evidence", 0, "content_base64"), del_), changed(("gaps",), ["none"]), json.dumps(asks), changed(("contract_version",), "v2"), "x", changed(("capability",), "")]
    df = frame(spark, bodies)
    refs = sorted(map(tuple, s.reference_violations(df, "id").collect()))
    assert refs == [(1, "claims[0].subject_candidate_key", "unknown_candidate"), (2, "relationships[0].evidence_keys[1]", "unknown_evidence"), (2, "relationships[0].object_candidate_key", "unknown_candidate"),
                    (3, "entities.person_candidates[0].evidence_keys[0]", "unknown_evidence")]
    got = sorted(map(tuple, s.outcomes(df, "id", "v1").collect()))
    assert got == [(0, "accepted", 0, False, False), (1, "rejected", 1, False, False), (2, "rejected", 2, False, False), (3, "rejected", 1, False, False), (4, "accepted", 0, True, False), (5, "accepted", 0, True, False),
                   (6, "accepted", 0, False, True), (7, "unsupported_contract", 1, False, False), (8, "rejected", 1, False, False), (9, "rejected", 1, False, False)]
    assert s.outcomes(df.limit(0), "id", "v1").count() == 0


def test_tables(spark):
    t = s.submission_tables(frame(spark, [json.dumps(GOOD), "x", None]), "id")
    assert t["evidence"].select("id", "pos", "evidence_key", "byte_length").collect() == [(0, 0, "e1", 3)]
    assert t["entities"].select("entity_set", "candidate_key", "attributes", "evidence_keys").collect() == [("person_candidates", "p1", '{"a":[1]}', ["e1"])]
    assert t["claims"].select("value").collect() == [(None,)]
    assert {p: d.count() for p, d in t.items() if p not in ("evidence", "entities", "claims")} == {p: 0 for p in NONE}


@pytest.mark.parametrize("part", [*s.LISTS, "entities"])
def test_columns_follow_the_contract(spark, part):
    fields = s.CANDIDATE if part == "entities" else s.LISTS[part]
    assert s.part_rows(frame(spark, []), "id", part).columns == ["id", *(["entity_set"] if part == "entities" else []), "pos", *fields]


def test_items_of_all_parts_from_one_reading(spark):
    df = frame(spark, [json.dumps(GOOD), "x", None])
    got = s.item_rows(df, "id")
    assert sorted((r.id, r.part, r.pos) for r in got.collect()) == [(0, p, 0) for p in ("claims", "evidence", "person_candidates")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") + got._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_right_items_are_not_read_field_by_field(spark):
    """The pattern takes right items of each part and no wrong one; what it leaves is judged in full."""
    x = lambda body: spark.createDataFrame([(body,)], "body string").select(F.explode(s._parts(F.try_parse_json("body"))).alias("x")).select("x.*", F.concat("x.part", F.to_json("x.item")).rlike(s._right()).alias("right"))
    assert {r.part for r in x(json.dumps(GOOD)).collect() if not r.right} <= {"", "entities", "entities.person_candidates"}
    wrong = [(p, path.rpartition(".")[0]) for p, _, path, rule in CASES if "." in path and rule not in ("unsupported_contract",)]
    bodies = [changed(p, v) for p, v, path, _ in CASES if "." in path]
    df = frame(spark, bodies).select("id", F.explode(s._parts(F.try_parse_json("body"))).alias("x")).select("id", "x.*")
    right = {(r.id, r.path) for r in df.where(F.concat("part", F.to_json("item")).rlike(s._right())).collect()}
    assert right and not right & {(i, path) for i, (_, path) in enumerate(wrong)}
    odd = EVIDENCE | {"locator": 'a "b" \\\\ \u00e9\U0001f600', "retrieved_at": "2024-02-30T00:00:00Z"}
    assert [tuple(r) for r in s.shape_violations(frame(spark, [changed(("evidence",), [EVIDENCE, odd])]), "id", "v1").collect()] == [(0, "evidence[1].retrieved_at", "bad_time")]
    plan = s.shape_violations(frame(spark, [json.dumps(GOOD)]), "id", "v1")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan


def test_references_read_texts_once(spark):
    """Items of a wrong kind, fields of a wrong kind and nulls have no references."""
    mixed = [7, None, {"candidate_key": {"a": 1}, "evidence_keys": ["e1", 5, None]}, {"candidate_key": "p1", "evidence_keys": "e9"}]
    people = lambda x: changed(("entities", "person_candidates"), x)
    df = frame(spark, [people(mixed), people({}), changed(("evidence",), [None, 3, EVIDENCE])])
    found = s.reference_violations(df, "id")
    assert sorted(map(tuple, found.collect())) == [(0, "entities.person_candidates[2].evidence_keys[1]", "unknown_evidence"), (1, "claims[0].subject_candidate_key", "unknown_candidate")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "parseJson" not in plan  # texts were read once, not for each side of the join
