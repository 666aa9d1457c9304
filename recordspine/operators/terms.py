"""Terms of office: one running term for a seat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["seat_id", "person_id", "start_date"]
# States of a running term, and of one that another has ended.
RUNNING, ENDED = ("current", "acting"), "completed"


def upsert_terms(stored: DataFrame, delta: DataFrame, end: Column) -> DataFrame:
    """stored (seat_id, person_id, start_date, end_date, status) after delta, with inserted, demoted.

    A term is known by seat, person and start (null starts are equal); delta's values win where they are there, repeated rows
    of a key give the largest. Of a seat's running terms the one with the latest start stays (no start comes last, then
    the larger person); the others are completed, and end at `end` unless they have an end.
    """
    side = lambda df, name: df.groupBy(*KEY).agg(F.max("status").alias(f"{name}_status"), F.max("end_date").alias(f"{name}_end"))
    old, new = side(stored, "old"), side(delta, "new").withColumnsRenamed({k: f"_{k}" for k in KEY})
    on = (F.col("seat_id") == F.col("_seat_id")) & (F.col("person_id") == F.col("_person_id")) & F.col("start_date").eqNullSafe(F.col("_start_date"))
    both = old.join(new, on, "full").withColumn("_new", F.col("old_status").isNull())
    both = both.select(*(F.coalesce(k, f"_{k}").alias(k) for k in KEY), F.coalesce("new_status", "old_status").alias("status"), F.coalesce("new_end", "old_end").alias("end_date"), F.col("_new").alias("inserted"))
    runs = F.col("status").isin(*RUNNING)
    last = both.where(runs).groupBy("seat_id").agg(F.max(F.struct("start_date", "person_id")).alias("_last"))
    out = both.join(last, "seat_id", "left").withColumn("demoted", runs & ~F.struct("start_date", "person_id").eqNullSafe(F.col("_last")))
    return out.select(*KEY, F.when(F.col("demoted"), F.coalesce("end_date", end)).otherwise(F.col("end_date")).alias("end_date"), F.when(F.col("demoted"), ENDED).otherwise(F.col("status")).alias("status"), "inserted", "demoted")
