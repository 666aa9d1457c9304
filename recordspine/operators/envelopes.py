"""Checks of producer envelopes: exact keys, required values, shapes, order of times, policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspine.operators.quality import violations

# The keys of an envelope.
REQUIRED = ["envelope_id", "producer", "contract_key", "job_id", "received_at", "content_hash", "claims"]
OPTIONAL = ["sources", "retrievals", "evidence", "entities", "relationships", "units", "boundaries"]
LIMITS = {"envelope_id": 128, "producer": 64, "contract_key": 128}


def keys_of(body: Column) -> Column:
    return F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))


def envelope_violations(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, rule): one row for each rule an envelope breaks; text that is no JSON object breaks not_an_object alone."""
    b = F.col(body)
    keys = keys_of(b)
    got = lambda k: F.get_json_object(b, f"$.{k}")
    is_object = F.json_object_keys(b).isNotNull()
    rules = {"not_an_object": ~is_object, "unknown_key": is_object & (F.size(F.array_except(keys, F.array(*map(F.lit, REQUIRED + OPTIONAL)))) > 0)}
    rules |= {f"missing_{k}": is_object & got(k).isNull() for k in REQUIRED}
    rules |= {f"long_{k}": F.length(got(k)) > n for k, n in LIMITS.items()}
    rules |= {
        "bad_hash": ~got("content_hash").rlike("^[0-9a-f]{64}$"),
        "bad_time": is_object & got("received_at").isNotNull() & ~got("received_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"),
        "time_after_receipt": F.exists(F.from_json(got("evidence"), "array<struct<seen_at:string>>"), lambda e: F.try_to_timestamp(e["seen_at"]) > F.try_to_timestamp(got("received_at"))),
    }
    return violations(df, [key], rules)


def policy_violations(df: DataFrame, policies: DataFrame) -> DataFrame:
    """(envelope_id, rule) against a table of producers: active, allowed contracts. The table is a short registry."""
    j = df.join(policies, "producer", "left")
    rules = {"unknown_producer": F.col("active").isNull(), "inactive_producer": ~F.col("active"), "contract_not_allowed": F.col("active") & ~F.array_contains("contracts", F.col("contract_key"))}
    return violations(j, ["envelope_id"], rules)
