"""Joins, keyed upserts and window operators used across the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], keep: list[str] = (), order: list[str] = ()) -> DataFrame:
    """Base rebuilt with delta: delta's non-null values win, columns of keep stay as first seen. Null keys are equal.

    Among several delta rows of a key the first under order counts; a key that is only in one side comes through.
    """
    value = [c for c in base.columns if c not in keys]
    one = latest(delta, keys, [F.col(c) for c in order] or [F.lit(1)]).select(*keys, *value) if order else delta.select(*keys, *value)
    rows = base.select(*keys, *value).withColumn("_side", F.lit(0)).unionByName(one.withColumn("_side", F.lit(1)))
    pick = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_side"))), F.lit(None)) if c in keep else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_side")))
    return rows.groupBy(*keys).agg(*(pick(c).alias(c) for c in value), F.max("_side").alias("_in_delta"), F.min("_side").alias("_only_delta"))


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of delta whose key base lacks, one for each key."""
    return delta.dropDuplicates(keys).join(base.select(*keys).distinct(), keys, "left_anti")


def merge_precedence(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which an earlier frame overrides later ones on equal keys."""
    ranked = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    out = ranked[0]
    for f in ranked[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return latest(out, keys, [F.col("_p")]).drop("_p")


def valid_at(df: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows valid at a time; null bounds are open, the end is exclusive."""
    return df.where((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at)))


def change_points(df: DataFrame, key: str, time: str, value: str, tie: list[str] = ()) -> DataFrame:
    """Adds previous value, changed and the time of the last change so far."""
    w = Window.partitionBy(key).orderBy(time, *tie)
    changed = F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))
    out = df.withColumn("previous", F.lag(value).over(w)).withColumn("changed", changed)
    return out.withColumn("last_changed_at", F.max(F.when(F.col("changed"), F.col(time))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def streaks(df: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds the number of failures in a row up to each row."""
    w = Window.partitionBy(key).orderBy(*order)
    island = df.withColumn("_failed", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_failed")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("failures", F.sum("_failed").over(run)).drop("_failed", "_island")


def under_marker(lines: DataFrame, doc: str, pos: str, marker: Column) -> DataFrame:
    """Adds section: the last marker at or before each line of a document."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(marker, ignorenulls=True).over(w))


def full_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each changed value: created, removed or changed, null-safe."""
    o = old.select(*keys, *(F.col(c).cast("string").alias(f"o_{c}") for c in columns), F.lit(True).alias("_o"))
    n = new.select(*keys, *(F.col(c).cast("string").alias(f"n_{c}") for c in columns), F.lit(True).alias("_n"))
    both = o.join(n, keys, "full_outer")
    kind = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "removed").otherwise("changed")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value")) for c in columns))
    rows = both.select(*keys, kind.alias("change"), F.explode(pairs).alias("v")).select(*keys, "change", "v.*")
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def resolve_identity(base: DataFrame, delta: DataFrame, external: str, name: str, scope: str) -> DataFrame:
    """Each delta row against the base: by external id, else by name within a scope; only a unique hit counts."""
    by_id = base.where(F.col(external).isNotNull()).groupBy(external).agg(F.count(F.lit(1)).alias("id_hits"), F.min("person_id").alias("id_person"))
    by_name = base.groupBy(name, scope).agg(F.count(F.lit(1)).alias("name_hits"), F.min("person_id").alias("name_person"))
    out = delta.join(by_id, external, "left").join(by_name, [name, scope], "left")
    how = F.when(F.col("id_hits") == 1, "external_id").when(F.col("id_hits") > 1, "conflict").when(F.col("name_hits") == 1, "name_in_scope").when(F.col("name_hits") > 1, "conflict").otherwise("new")
    return out.withColumn("method", how).withColumn("resolved_id", F.when(how == "external_id", F.col("id_person")).when(how == "name_in_scope", F.col("name_person")))
