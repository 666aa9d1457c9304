"""Positions in one total order without one task for all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspine.sources.tables import written


def with_position(df: DataFrame, order: list[Column], name: str = "position", within: list[str] = ()) -> DataFrame:
    """df with each row's place (from 1) under order, which must be total; with within, in each group of those columns.

    Rows are dealt by ranges of the order and written once, numbered inside each range, and moved by the number of rows in
    the ranges before it: the only row list that one task sees has one row for each range. Groups may span ranges.
    """
    whole = [*(F.col(c).asc() for c in within), *order]
    dealt = written(df.repartitionByRange(*whole).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    out = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*whole)))
    out = out.join(F.broadcast(starts), "_range").withColumn(name, F.col("_own") + F.col("_before"))  # a row for each range
    if within:
        firsts = out.groupBy(*(F.col(c).alias(f"_g_{c}") for c in within)).agg(F.min(name).alias("_first"))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in within))
        out = out.join(firsts, same).withColumn(name, F.col(name) - F.col("_first") + 1)
    return out.select(*df.columns, name)
