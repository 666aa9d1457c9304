"""JSON texts of any depth as rows, one level of nesting a round; no depth and no key is fixed beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspine.sources.tables import written

# States that only a review may give.
PROMOTION_TERMS = ["verified", "canonical", "published", "publication_eligible"]
STATE_KEYS = "(?i)(status|state|verification|publication)"


def leaves(df: DataFrame, keys: list[str], body: str, skip: Column | None = None) -> DataFrame:
    """(keys, path, name, value): every value of a JSON text that is no list and no object, as text; JSON nulls have none.

    path is like a.b[0].c; name is the nearest key around the value: elements of a list have that of the list. skip: a
    condition on path and name, whose values are left out with all below them. Keys read as they are meant, escapes included.
    A text that is no JSON, or that repeats a key in an object, gives one row with a null path. Null texts give none.

    Each round takes the lists and objects that are left one level apart and writes them out, so that the rows shrink
    with the depth and a lost executor costs one round.
    """
    spark = df.sparkSession
    read = df.where(F.col(body).isNotNull()).select(*keys, F.try_parse_json(body).alias("v"))
    level = written(read.select(*keys, F.lit("").alias("path"), F.lit("").alias("name"), "v"), "json")
    value = F.try_variant_get("v", "$", "string")
    nested = F.coalesce(F.schema_of_variant("v").rlike("^(ARRAY|OBJECT)<"), F.lit(False))
    out = level.where(F.col("v").isNull() | ~nested).select(*keys, F.when(F.col("v").isNotNull(), F.col("path")).alias("path"), "name", value.alias("value"))
    while True:
        level = level.where(nested)
        if level.isEmpty():
            return out
        parts = level.withColumnRenamed("v", "whole").lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        own = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat_ws(".", F.nullif("path", F.lit("")), "key"))
        parts = parts.select(*keys, own.alias("path"), F.coalesce("key", "name").alias("name"), F.col("value").alias("v"))
        level = written(parts if skip is None else parts.where(~skip), "json")
        out = out.unionByName(level.where(~nested).select(*keys, "path", "name", value.alias("value")))


def promoted_terms(rows: DataFrame, keys: list[str], body: str, terms: list[str] = PROMOTION_TERMS) -> DataFrame:
    """(keys, path, term): texts under a key of a state, at any depth, that claim a promotion of their own.

    The key extraction_status of the outermost object may say anything. Unreadable texts that have one of the words give a
    row of nulls. Texts without any of the words and without escaped letters are never taken apart.
    """
    likely = rows.where(F.col(body).rlike("(?i)" + "|".join([*terms, r"\\u"])))
    found = leaves(likely, keys, body, skip=F.col("path") == "extraction_status")
    claims = F.col("name").rlike(STATE_KEYS) & F.lower("value").isin(terms)
    return found.where(F.col("path").isNull() | claims).select(*keys, "path", F.when(F.col("path").isNotNull(), F.lower("value")).alias("term"))
