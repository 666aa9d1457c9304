"""Keyed tables in versions: an upsert moves the new rows to the stored ones, never the stored ones.

A version is a bucketed and sorted Parquet table in a folder of its own. A manifest of numbered files names the versions; the
highest number is the current one. A writer makes its folder first and then puts the next manifest file in place by one
rename that fails if the file is there. So a writer that fails leaves the table as it was, and of two writers that start
from one version the second gets an error.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the current version; 0 and None where there is none."""
    fs, folder = _fs(spark, f"{path}/_manifest")
    if not fs.exists(folder):
        return 0, None
    numbers = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if re.fullmatch(r"\d{12}\.json", s.getPath().getName())]
    if not numbers:
        return 0, None
    n = max(numbers)
    return n, json.loads(spark.read.option("wholetext", True).text(f"{path}/_manifest/{n:012d}.json").first()[0])


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Put a manifest file in place; an error if that number is taken."""
    fs, target = _fs(spark, f"{path}/_manifest/{number:012d}.json")
    fs.mkdirs(target.getParent())
    _, draft = _fs(spark, f"{path}/_manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {path} was written by another writer")


def _table(spark: SparkSession, content: dict) -> DataFrame:
    """The version as a table whose buckets Spark knows; the catalog entry is made where this session lacks it."""
    keys = ", ".join(f"`{k}`" for k in content["keys"])
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{content['table']}` ({content['schema']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {content['buckets']} BUCKETS LOCATION '{content['folder']}'")
    return spark.table(f"`{content['table']}`")


def _write(df: DataFrame, path: str, keys: list[str], buckets: int) -> dict:
    name = f"versioned_{uuid.uuid4().hex}"
    folder = f"{path}/data/{name}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", folder).saveAsTable(name)
    return {"table": name, "folder": folder, "keys": keys, "buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version, or one of an older number."""
    n, content = _manifest(spark, path)
    if version is not None and version != n:
        content = json.loads(spark.read.option("wholetext", True).text(f"{path}/_manifest/{version:012d}.json").first()[0])
    if content is None:
        raise FileNotFoundError(f"{path} has no version")
    return _table(spark, content)


def create(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """The first version. Keys are unique and not null."""
    spark = df.sparkSession
    n, _ = _manifest(spark, path)
    if n:
        raise RuntimeError(f"{path} has versions already")
    publish(spark, path, 1, _write(df.repartition(buckets, *keys), path, keys, buckets))


def merged(base: DataFrame, delta: DataFrame, keys: list[str], buckets: int, keep: list[str] = (), order: list[str] = ()) -> DataFrame:
    """base after delta: delta's non-null values win, columns of keep stay as first stored. Of several delta rows of a key the last
    under order counts (all columns decide where order is empty). A full outer join on the keys: the base's buckets are the join's
    partitions, so only delta is shuffled."""
    value = [c for c in base.columns if c not in keys]
    by = F.struct(*(order or value))
    new = delta.repartition(buckets, *keys).groupBy(*keys).agg(F.max_by(F.struct(*value), by).alias("_new"))
    both = base.join(new, keys, "full")
    pick = lambda c: F.coalesce(c, f"_new.{c}") if c in keep else F.coalesce(f"_new.{c}", c)
    return both.select(*(F.col(c) if c in keys else pick(c).alias(c) for c in base.columns))


def upsert(delta: DataFrame, path: str, keep: list[str] = (), order: list[str] = ()) -> int:
    """The next version: the stored rows after delta (all columns of the table). Gives its number; rows with a null key raise."""
    spark = delta.sparkSession
    n, content = _manifest(spark, path)
    if content is None:
        raise FileNotFoundError(f"{path} has no version")
    keys = content["keys"]
    checked = delta.withColumn(keys[0], F.when(~F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNotNull(), F.col(keys[0])).otherwise(F.raise_error(F.lit("null key"))))
    publish(spark, path, n + 1, _write(merged(_table(spark, content), checked, keys, content["buckets"], list(keep), list(order)), path, keys, content["buckets"]))
    return n + 1
