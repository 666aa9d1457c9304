"""Helpers that the operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir; where it is unset, a temporary one, but only
    in local mode, since on a cluster no other machine would see it."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _FALLBACK[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordspine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables; nothing that is still to run may read them."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_memo_of: dict[str, Callable[[], None]] = {}


def claim_memos(owner: str, forget: Callable[[], None]) -> None:
    """Called in a Python worker as an operator starts a partition: what other operators keep there for speed is emptied,
    so that a reused worker holds the memo tables of one operator at a time, and those stay warm within its stage."""
    for other in [o for o in _memo_of if o != owner]:
        _memo_of.pop(other)()
    _memo_of[owner] = forget


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts (or lists) take about limit bytes, so that what Python makes of a part stays small."""
    held = batch.column(batch.schema.names.index(column))
    sizes = 8 * pa.compute.list_value_length(held).fill_null(0).to_numpy() if pa.types.is_list(held.type) else pa.compute.binary_length(held).fill_null(0).to_numpy()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges, itself included.

    Neighbour minimum plus one pointer jump per round, until no label changes; every round is written to the shared
    folder. Labels only travel through joins that Spark can split and through aggregates with partial sums, so that one
    node with very many edges is no hot spot. No edges give no rows; self-edges give the node alone.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = materialize(both, "cc-edges")
    labels = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component"))
    written = labels = materialize(labels, "cc-labels")
    while True:
        seen = labels.select(F.col("node").alias("dst"), F.col("component").alias("theirs"))
        near = both.join(seen, "dst").groupBy("src").agg(F.min("theirs").alias("near")).withColumnRenamed("src", "node")
        one = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("one"))
        up = labels.select(F.col("node").alias("one"), F.col("component").alias("two"))
        nxt = one.join(up, "one").select("node", F.col("was"), F.least("one", "two").alias("component"))
        nxt = materialize(nxt, "cc-labels")
        discard(written)
        written, labels = nxt, nxt.select("node", "component")
        if nxt.where("component <> was").isEmpty():
            discard(both)
            return labels
