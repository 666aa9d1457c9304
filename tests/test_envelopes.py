import json

from pyspark.sql import functions as F

from recordspine.operators import envelopes

GOOD = {"envelope_id": "e", "producer": "p", "contract_key": "c", "job_id": "j", "received_at": "2024-01-02T03:04:05Z", "content_hash": "0" * 64, "claims": []}


def test_rules(spark):
    late = GOOD | {"evidence": [{"seen_at": "2024-01-03T00:00:00Z"}]}
    rows = [(1, json.dumps(GOOD)), (2, "nonsense"), (3, json.dumps(GOOD | {"x": 1})), (4, json.dumps({k: v for k, v in GOOD.items() if k != "producer"})), (5, json.dumps(GOOD | {"content_hash": "abc"})), (6, json.dumps(GOOD | {"received_at": "2024-01-02"})), (7, json.dumps(late)), (8, None)]
    got = envelopes.envelope_violations(spark.createDataFrame(rows, "id int, body string"), "id").collect()
    assert sorted(map(tuple, got)) == [(2, "not_an_object"), (3, "unknown_key"), (4, "missing_producer"), (5, "bad_hash"), (6, "bad_time"), (7, "time_after_receipt"), (8, "not_an_object")]


def test_policies(spark):
    e = spark.createDataFrame([("e1", "p", "c"), ("e2", "p", "d"), ("e3", "q", "c"), ("e4", "r", "c")], "envelope_id string, producer string, contract_key string")
    policies = spark.createDataFrame([("p", True, ["c"]), ("q", False, ["c"])], "producer string, active boolean, contracts array<string>")
    assert sorted(map(tuple, envelopes.policy_violations(e, policies).select("envelope_id", "rule").collect())) == [("e2", "contract_not_allowed"), ("e3", "inactive_producer"), ("e4", "unknown_producer")]
    assert envelopes.policy_violations(e.limit(0), policies).where(F.lit(True)).count() == 0
