"""Who a candidate is: resolution against known persons, and the persons as they stand afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspine import functions as fn


def entries(df: DataFrame, ids: list[str]) -> Column:
    """The external identifiers of a row as texts 'key=value', trimmed and in lower case; empty ones are none."""
    spelled = [F.concat_ws("=", F.lit(k), F.lower(F.nullif(F.trim(k), F.lit("")))) for k in ids if k in df.columns]
    held = [F.nullif(F.trim(k), F.lit("")).isNotNull() for k in ids if k in df.columns]
    return F.filter(F.array(*(F.when(h, s) for h, s in zip(held, spelled, strict=True))), lambda x: x.isNotNull())


def resolve_persons(people: DataFrame, terms: DataFrame, seats: DataFrame, candidates: DataFrame, ids: list[str]) -> DataFrame:
    """candidates with resolved_id, status, method.

    people: person_id, canonical_name, identifiers; terms: seat_id, person_id; seats: seat_id, jurisdiction_id; candidates:
    candidate_id, canonical_name, given_id, seat_id, jurisdiction_id, identifiers. A given id decides alone. Else the first
    person (by id) that shares an identifier; else the one person of that normalised name among the seat's holders; else
    the one among holders of the jurisdiction's seats. Names that normalise to nothing match nobody. Without any of it, several
    namesakes of a candidate without seat and jurisdiction are a conflict.

    People are summed by identifier, by seat and name, and by jurisdiction and name before they meet the candidates, so
    each join has one row for a key and a common name makes no pairs.
    """
    name = lambda df: F.nullif(fn.normalize_person_name(F.col("canonical_name")), F.lit(""))
    people = people.withColumn("_name", name(people))
    c = candidates.withColumns({"_name": name(candidates), "_entries": entries(candidates, ids)})
    firsts = people.select("person_id", F.explode(entries(people, ids)).alias("_entry")).groupBy("_entry").agg(F.min("person_id").alias("hit"))
    by_id = c.select("candidate_id", F.explode("_entries").alias("_entry")).join(firsts, "_entry").groupBy("candidate_id").agg(F.min("hit").alias("_by_id"))
    held = terms.select("seat_id", "person_id").distinct().join(people.select("person_id", "_name"), "person_id").join(seats.select("seat_id", "jurisdiction_id"), "seat_id")

    def unique(key: str, out: str) -> DataFrame:
        return held.groupBy(key, "_name").agg(F.min("person_id").alias(out), F.max("person_id").alias("_last")).where(F.col(out) == F.col("_last")).drop("_last")

    same = people.groupBy("_name").agg(F.count(F.lit(1)).alias("_namesakes"))
    given = people.select(F.col("person_id").alias("given_id"), F.col("person_id").alias("_given"))
    out = c.join(by_id, "candidate_id", "left").join(unique("seat_id", "_in_seat"), ["seat_id", "_name"], "left")
    out = out.join(unique("jurisdiction_id", "_in_area"), ["jurisdiction_id", "_name"], "left").join(same, "_name", "left").join(given, "given_id", "left")
    out = out.withColumn("resolved_id", F.when(F.col("given_id").isNotNull(), F.col("_given")).otherwise(F.coalesce("_by_id", "_in_seat", "_in_area")))
    how = (
        F.when(F.col("given_id").isNotNull(), "person_id").when(F.size("_entries") > 0, "external_identifier")
        .when(F.col("seat_id").isNotNull(), "normalized_name_seat").otherwise("normalized_name_jurisdiction")
    )
    found = F.col("resolved_id").isNotNull()
    named_only = (F.col("_namesakes") > 1) & F.col("seat_id").isNull() & F.col("jurisdiction_id").isNull()
    status = F.when(found, "matched").when(named_only, "conflict").otherwise("unmatched")
    method = F.when(found, how).when(named_only, "name_only").otherwise("none")
    return out.select(*candidates.columns, "resolved_id", status.alias("status"), method.alias("method"))


def upsert_persons(people: DataFrame, resolved: DataFrame, ids: list[str]) -> DataFrame:
    """people after resolved candidates are written, with written (rows): identifiers merge and the last candidate's win, a known
    canonical name stays; unmatched candidates become persons of their own id; conflicts wait."""
    held = lambda k: F.nullif(F.trim(k), F.lit(""))
    w = resolved.where("status <> 'conflict'").groupBy(F.coalesce("resolved_id", "candidate_id").alias("person_id")).agg(
        *(F.max_by(held(k), F.when(held(k).isNotNull(), F.col("candidate_id"))).alias(f"_new_{k}") for k in ids), F.min_by("canonical_name", "candidate_id").alias("_new_name"), F.count(F.lit(1)).alias("_written"))
    out = people.join(w, "person_id", "full")
    return out.select("person_id", F.coalesce("canonical_name", "_new_name").alias("canonical_name"), *(F.coalesce(f"_new_{k}", k).alias(k) for k in ids), F.coalesce("_written", F.lit(0)).alias("written"))
