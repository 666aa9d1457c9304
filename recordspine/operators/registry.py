"""Sources against the register of sources: by key or address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def any_key_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Inner join on any of several pairs of columns (left's, right's), which have different names; each pair of rows once.

    One equi-join for each pair of columns, which leaves out what an earlier one has found; so nothing has to be made
    distinct afterwards, and no join has an OR.
    """
    parts = []
    for i, (a, b) in enumerate(keys):
        new = reduce(lambda x, y: x & y, (F.coalesce(F.col(c) != F.col(d), F.lit(True)) for c, d in keys[:i]), F.lit(True))
        parts.append(left.join(right, F.col(a) == F.col(b)).where(new))
    return reduce(DataFrame.unionByName, parts)


def source_provenance(sources: DataFrame, register: DataFrame, key: str = "source_key", url: str = "source_url") -> DataFrame:
    """sources with outcome, canonical_source_id, canonical_authority_tier.

    register: source_id, source_key, source_url, active, authority_tier; only active rows count. exact: one row has both key
    and address; ambiguous: several have; mismatch: rows have one of the two only; missing: none. The register is summed by
    pair, key and address first, so that a key with many addresses is one row in each of the three joins.
    """
    known = register.where("active").select(F.col("source_key").alias("_k"), F.col("source_url").alias("_u"), "source_id", "authority_tier")
    both = known.groupBy("_k", "_u").agg(F.count(F.lit(1)).alias("_n"), F.min("source_id").alias("_id"), F.min_by("authority_tier", "source_id").alias("_tier"))
    by = lambda c: known.where(F.col(c).isNotNull()).select(c).distinct()
    out = sources.join(both, (F.col(key) == F.col("_k")) & (F.col(url) == F.col("_u")), "left").drop("_k", "_u")
    out = out.join(by("_k").withColumn("_has_key", F.lit(True)), F.col(key) == F.col("_k"), "left").drop("_k")
    out = out.join(by("_u").withColumn("_has_url", F.lit(True)), F.col(url) == F.col("_u"), "left").drop("_u")
    outcome = F.when(F.col("_n") == 1, "exact").when(F.col("_n") > 1, "ambiguous").when(F.col("_has_key") | F.col("_has_url"), "mismatch").otherwise("missing")
    one = F.col("_n") == 1
    return out.select(*sources.columns, outcome.alias("outcome"), F.when(one, F.col("_id")).alias("canonical_source_id"), F.when(one, F.col("_tier")).alias("canonical_authority_tier"))
