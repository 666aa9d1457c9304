"""Comparing two versions of a keyed table by a tree of digests, so that only what differs is read.

A stored version is cut into ranges of the key's hash (folders by its first hexadecimal digits) and holds a tree of digests beside
its rows: one for each range, and one for each shorter prefix over its at most 16 parts. Two versions are compared from the
top: the parts of a node are looked at only if the node differs, and rows are read only of ranges that differ, by
partition pruning.

A range's digest is its number of rows and four sums of 60 bits each of its rows' SHA-256. Sums are made before the shuffle and
in any order, so no task holds the rows of a range. They tell accidental changes apart, not ones made to collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES = 4


def row_text(df: DataFrame) -> Column:
    """A row as JSON with its columns by name; nulls are written out."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def range_of(keys: list[str], digits: int) -> Column:
    """First hexadecimal digits of the SHA-256 of the key's JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys)), {"ignoreNullFields": "false"}), 256), 1, digits)


def tree(df: DataFrame, node: Column, text: Column, digits: int) -> DataFrame:
    """(prefix, n, digest) of all nodes, the root with an empty prefix; node: text of as many hexadecimal digits."""
    lane = lambda i: F.conv(F.substring(F.col("_sha"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    rows = df.select(node.alias("prefix"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("_sha"))
    sums = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), *(F.sum(lane(i)).alias(f"_{i}") for i in range(LANES)))
    level = sums.select("prefix", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(f"_{i}").cast("string") for i in range(LANES))), 256).alias("digest"))
    out = level
    for length in range(digits - 1, -1, -1):
        parts = F.array_sort(F.collect_list(F.concat("prefix", F.lit("="), "digest")))  # at most 16
        level = level.groupBy(F.substring("prefix", 1, length).alias("_p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(parts, ","), 256).alias("digest")).withColumnRenamed("_p", "prefix")
        out = out.unionByName(level)
    return out


def store(df: DataFrame, path: str, keys: list[str], digits: int = 2) -> None:
    """Rows in 16^digits ranges below path/rows and the tree in path/tree, which is written last: without it there is no version.

    The rows are read back for the tree, so that it tells of what is stored. A column named _range is not allowed.
    """
    if "_range" in df.columns:
        raise ValueError("_range is the name of the ranges")
    spark = df.sparkSession
    df.withColumn("_range", range_of(keys, digits)).hint("rebalance", F.col("_range")).write.partitionBy("_range").parquet(f"{path}/rows")
    kept = _rows(spark, path, df.schema)
    tree(kept, F.col("_range"), row_text(kept.drop("_range")), digits).withColumn("level", F.length("prefix")).repartition(1).write.partitionBy("level").parquet(f"{path}/tree")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A version's rows of these columns, with _range."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_range", T.StringType())])).parquet(f"{path}/rows")


def differing_ranges(spark: SparkSession, before: str, after: str, digits: int = 2) -> list[str]:
    """Ranges that differ between two stored versions, found from the root down; at most 16^digits, a bound the caller sets."""
    found = [""]
    for level in range(digits + 1):
        parts = (F.col("level") == level) & (F.substring("prefix", 1, level - 1).isin(found) if level else F.lit(True))
        old, new = (spark.read.schema("prefix string, n bigint, digest string, level int").parquet(f"{p}/tree").where(parts).select("prefix", "digest") for p in (before, after))
        both = old.withColumnRenamed("digest", "_old").join(new, "prefix", "full")
        found = sorted(r["prefix"] for r in both.where(~F.col("_old").eqNullSafe(F.col("digest"))).select("prefix").collect())
        if not found:
            break
    return found


def changed_keys(spark: SparkSession, before: str, after: str, schema: T.StructType, keys: list[str], digits: int = 2) -> DataFrame:
    """(keys, change): 'added', 'removed' or 'changed' of two stored versions with these columns; equal ranges are not scanned.

    Keys are unique in a version; of a repeated key, versions with the same rows in another order are equal, and any other change is told once.
    """
    ranges = differing_ranges(spark, before, after, digits)

    def side(path: str, name: str) -> DataFrame:
        rows = _rows(spark, path, schema).where(F.col("_range").isin(ranges) if ranges else F.lit(False))
        sums = F.sum(F.conv(F.substring(F.sha2(row_text(rows.drop("_range")), 256), 1, 15), 16, 10).cast("decimal(20,0)"))
        return rows.groupBy(*keys).agg(F.struct(F.count(F.lit(1)), sums).alias(name))

    old, new = side(before, "_old"), side(after, "_new")
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    both = old.join(new, [*same], "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return both.select(*(F.when(F.col("_old").isNull(), new[k]).otherwise(old[k]).alias(k) for k in keys), change.alias("change"))
