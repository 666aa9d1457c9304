"""Data-quality operators: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule): one row for each rule that a row breaks; a rule that is null counts as kept."""
    broken = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())), lambda x: x.isNotNull())
    return df.select(*key, F.explode(broken).alias("rule"))


def first_violation(rules: dict[str, Column]) -> Column:
    """The name of the first rule that is broken, or null."""
    return F.coalesce(*(F.when(v, F.lit(k)) for k, v in rules.items()))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(refs: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    return refs.join(targets.select(F.col(target_key).alias(key)).distinct(), key, "left_anti")


def count_gate(manifest: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """manifest (key, expected_minimum, expected_maximum) with n, status and message: a count outside the bounds is rejected."""
    out = manifest.join(records.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = (F.col("n") < F.col("expected_minimum")) | (F.col("n") > F.col("expected_maximum"))
    said = F.concat(F.lit("wrote "), F.col("n").cast("string"), F.lit(" records; expected "), F.col("expected_minimum").cast("string"), F.lit("-"), F.col("expected_maximum").cast("string"))
    return out.withColumns({"status": F.when(bad, "rejected").otherwise("success"), "message": F.when(bad, said)})


def presence_by_category(fields: DataFrame, claims: DataFrame, states: list[str]) -> DataFrame:
    """(category, present, total): fields (field_key, category) of each category and those with a claim that has a value or a state of
    `states`. Claims (field_key, normalized_value, verification_state) shrink to their fields before the shuffle. A null category
    is 'uncategorized'; empty values are none; repeated fields count each.
    """
    told = F.col("verification_state").isin(states) | (F.coalesce("normalized_value", F.lit("")) != "")
    seen = claims.where(told).select("field_key").distinct().withColumn("_seen", F.lit(1))
    return fields.join(seen, "field_key", "left").groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.count("_seen").alias("present"), F.count(F.lit(1)).alias("total"))
