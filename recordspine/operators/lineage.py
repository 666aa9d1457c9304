"""Chained hashes over tables that descend from each other: one comparison tells whether anything above a row has changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hop:
    """A table of the chain: its unique key, the column that names the row above it (none for the first), and its facts."""

    name: str
    rows: DataFrame
    key: str
    facts: list[str]
    above: str | None = None


def chained(hops: list[Hop]) -> DataFrame:
    """(key of the last hop, hashes): for each of its rows the hashes from the first hop to its own.

    A hop's hash covers its key and facts and the hash above it. Where the row above is missing, its place says 'missing'
    and what lies further up is null. Each hop is one equi-join of the hashes above with the next table, so that a row
    with many descendants is a skewed join that Spark can split; nothing is collected.
    """
    sealed: DataFrame | None = None
    for i, hop in enumerate(hops):
        own = F.to_json(F.struct(F.col(hop.key).alias("key"), *(F.col(c).cast("string").alias(f"f{n}") for n, c in enumerate(hop.facts))))
        rows = hop.rows.select(F.col(hop.key).alias("_key"), *([F.col(hop.above).alias("_above")] if hop.above else []), own.alias("_own"))
        if sealed is None:
            sealed = rows.select("_key", F.array(F.sha2("_own", 256)).alias("hashes"))
            continue
        lost = F.array(*[F.lit(None).cast("string")] * (i - 1), F.lit("missing"))
        up = sealed.select(F.col("_key").alias("_above"), F.col("hashes").alias("_up"))
        rows = rows.join(up, "_above", "left").withColumn("_up", F.coalesce("_up", lost))
        sealed = rows.select("_key", F.array_append("_up", F.sha2(F.concat_ws("|", F.element_at("_up", -1), "_own"), 256)).alias("hashes"))
    return sealed.select(F.col("_key").alias(hops[-1].key), "hashes")


def first_break(recorded: DataFrame, now: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, hop, kind): rows of recorded whose chain is another one now, with the first hop, from the top, that differs.

    kind: missing or changed; a row that is gone itself is missing at its own hop. Chains with equal last hashes are
    equal throughout, so the hops are looked through only where those differ.
    """
    both = recorded.select(key, F.col("hashes").alias("was")).join(now.select(key, F.col("hashes").alias("is")), key, "left")
    broken = both.where(~F.element_at("was", -1).eqNullSafe(F.element_at("is", -1)))
    differs: Column = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.col("is")[i].isNotNull() & (F.col("was")[i] != F.col("is")[i]))
    at = F.when(F.col("is").isNull(), F.lit(len(names))).otherwise(F.array_position(differs, True)).cast("int")
    kind = F.when(F.col("is").isNull() | (F.col("is")[at - 1] == "missing"), "missing").otherwise("changed")
    return broken.select(key, F.element_at(F.array(*map(F.lit, names)), at).alias("hop"), kind.alias("kind"))
