"""Queries with optional fields against records: matched, ambiguous or unmatched.

A field that a query doesn't give is no condition. Which fields are given is a mask; records are counted once for each mask that
occurs and each value of its fields, and a query then meets one row by an equi-join. No query meets the records themselves,
so a query that fits a third of all records costs no more than one that fits a single record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def office_key(value: Column) -> Column:
    """Lower-case words of an office or seat joined by underscores."""
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", F.lit("_")), F.lit("_"))


def match(records: DataFrame, record_id: str, queries: DataFrame, query_id: str, fields: list[str], needs: list[str] | None = None, keys: dict | None = None) -> DataFrame:
    """(query_id, status, candidates, record_id): one row for each query row. fields: columns of both sides.

    needs: fields of which a query must give one (default: any); other queries are unmatched. keys: field -> function that
    makes the compared form of a column. Null and empty fields of a query aren't given; a null field of a record fits no query that
    gives it. record_id is set only where exactly one record fits; repeated records count each.
    """
    keys, needs = keys or {}, needs or fields
    text = lambda f: keys.get(f, lambda c: c)(F.col(f).cast("string"))
    bit = {f: 1 << i for i, f in enumerate(fields)}
    given = {f: F.coalesce(F.col(f).cast("string") != "", F.lit(False)) for f in fields}
    mask = sum((F.when(given[f], bit[f]).otherwise(0) for f in fields), F.lit(0))
    able = given[needs[0]]
    for f in needs[1:]:
        able = able | given[f]
    q = queries.select(query_id, F.when(able, mask).alias("_mask"), F.array(*(F.when(given[f], text(f)) for f in fields)).alias("_want"))
    masks = [r["_mask"] for r in q.select("_mask").where("_mask IS NOT NULL").distinct().collect()]  # at most 2^fields
    known = records.select(record_id, F.array(*(text(f) for f in fields)).alias("_have"))
    chosen = F.transform("_have", lambda v, i: F.when(F.col("_mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0, v))
    whole = F.forall(F.sequence(F.lit(0), F.lit(len(fields) - 1)), lambda i: (F.col("_mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) == 0) | F.get("_have", i).isNotNull())
    seen = known.withColumn("_mask", F.explode(F.array(*map(F.lit, masks)) if masks else F.array().cast("array<int>"))).where(whole).select(record_id, "_mask", chosen.alias("_want"))
    counted = seen.groupBy("_mask", "_want").agg(F.count(F.lit(1)).alias("candidates"), F.min(record_id).alias("_one"))
    # Join on text: parts that aren't given are told from empty ones.
    as_text = F.to_json("_want", {"ignoreNullFields": "false"})
    out = q.withColumn("_want", as_text).join(counted.withColumn("_want", as_text), ["_mask", "_want"], "left")
    n = F.coalesce("candidates", F.lit(0).cast("long"))
    status = F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unmatched")
    return out.select(query_id, status.alias("status"), n.alias("candidates"), F.when(n == 1, F.col("_one")).alias(record_id))
