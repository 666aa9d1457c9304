"""Shards of nearly equal bytes by best-fit-decreasing bin packing of indivisible groups.

Groups are equal texts (null counts as empty). What enters the packing is bounded whatever the input's size: groups
larger than 1/1024 of a shard (at most 1024 a shard, by arithmetic) stand alone; all smaller ones fall by hash into a
fixed number of crumbs, each one item. A group larger than a whole shard can't be kept together under the law of
equal bytes; it alone is cut, by the hash of doc_id, into a fixed number of pieces. The smallest capacity that holds
all items is searched by bisection; items go by falling size into the tightest remaining capacity through a balanced
tree. Empty input gives no rows; repeated rows get slots of their own, in the order of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordspine.llm.common import materialize, table

CRUMBS = 4096
PIECES = 256
GRAIN = 1024


class CapacityTree:
    """Treap of (remaining capacity, bin): insert, and remove the smallest entry that is at least a size, in O(log n)."""

    def __init__(self):
        self.root = None
        self.seed = 88172645463325252

    def _priority(self) -> int:
        self.seed ^= (self.seed << 13) & 0xFFFFFFFFFFFFFFFF
        self.seed ^= self.seed >> 7
        self.seed ^= (self.seed << 17) & 0xFFFFFFFFFFFFFFFF
        return self.seed

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, None, None, self._priority()]), right)

    def take_at_least(self, size: int) -> tuple[int, int] | None:
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[1] is not None:
            node = node[1]
        _, rest = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, rest)
        return node[0]


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int) -> list[int] | None:
    """The bin of each item (items by falling size), or None if they need more bins."""
    tree, opened, out = CapacityTree(), 0, []
    for size in sizes:
        got = tree.take_at_least(size)
        if got is None:
            if opened == bins or size > capacity:
                return None
            got, opened = (capacity, opened), opened + 1
        out.append(got[1])
        tree.insert((got[0] - size, got[1]))
    return out


def pack(items: list[tuple[object, int]], bins: int) -> dict[object, int]:
    """Item to bin under the smallest capacity (to 1/10,000) for which best fit decreasing needs no more than bins."""
    items = sorted(items, key=lambda x: (-x[1], str(x[0])))
    sizes = [s for _, s in items]
    if not items:
        return {}
    low = max(sizes[0], -(-sum(sizes) // bins))
    high = low
    while (best := best_fit_decreasing(sizes, high, bins)) is None:
        low, high = high, high + max(1, high // 256)
    while high - low > max(1, high // 10_000):
        mid = (low + high) // 2
        if (got := best_fit_decreasing(sizes, mid, bins)) is None:
            low = mid
        else:
            best, high = got, mid
    return {k: b for (k, _), b in zip(items, best, strict=True)}


def assign_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; shard sizes in bytes are near equal."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).cast("long").alias("text_crc32"), F.xxhash64(body).alias("_g"))
    slim = materialize(slim, "shard-rows")
    groups = slim.groupBy("_g", "text_crc32", "size").agg(F.sum("size").alias("bytes"))
    groups = materialize(groups, "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = -(-total // shards)
    grain = max(1, share // GRAIN)
    # At most total / grain = 1024 * shards groups are larger than a grain.
    large = [(r["_g"], r["text_crc32"], r["size"], r["bytes"]) for r in groups.where(F.col("bytes") > grain).collect()]
    crumb = F.pmod("_g", F.lit(CRUMBS)).cast("int")
    crumbs = [(r["c"], r["b"]) for r in groups.where(F.col("bytes") <= grain).groupBy(crumb.alias("c")).agg(F.sum("bytes").alias("b")).collect()]
    schema = "_g long, text_crc32 long, size long, cut boolean"
    alone = spark.createDataFrame([(g, c, s, b > share) for g, c, s, b in large], schema)
    piece = F.when(F.col("cut"), F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).cast("int"))
    keyed = slim.join(F.broadcast(alone), ["_g", "text_crc32", "size"], "left").withColumn("piece", F.when(F.col("cut").isNull(), F.lit(-2)).otherwise(F.coalesce(piece, F.lit(-1))))
    cut = [x for x in large if x[3] > share]
    items: list[tuple[object, int]] = [((None, None, None, c), b) for c, b in crumbs] + [((g, c, s, -1), b) for g, c, s, b in large if b <= share]
    if cut:
        pieces = keyed.where(F.col("cut")).groupBy("_g", "text_crc32", "size", "piece").agg(F.sum("size").alias("b")).collect()
        items += [((r["_g"], r["text_crc32"], r["size"], r["piece"]), r["b"]) for r in pieces]
    where = pack(items, shards)
    by_group = spark.createDataFrame([(g, c, s, p, b) for (g, c, s, p), b in where.items() if g is not None], "_g long, text_crc32 long, size long, piece int, large_shard int")
    by_crumb = spark.createDataFrame([(p, b) for (g, _, _, p), b in where.items() if g is None], "_crumb int, small_shard int")
    placed = (
        keyed.join(F.broadcast(by_group), ["_g", "text_crc32", "size", "piece"], "left")
        .withColumn("_crumb", F.when(F.col("piece") == -2, crumb))
        .join(F.broadcast(by_crumb), "_crumb", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("large_shard", "small_shard").alias("shard"))
    )
    return with_slots(placed)


def with_slots(placed: DataFrame, rows_each: int = 50_000) -> DataFrame:
    """slot: gapless from 0 in each shard. Numbers within hash parts of a shard, plus the sizes of the parts before."""
    parts = max(64, placed.count() // rows_each)
    cut = placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)).cast("int"))
    counts = cut.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32")
    return cut.withColumn("_n", F.row_number().over(own) - 1).join(starts, ["shard", "_part"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("_start") + F.col("_n")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
