"""Hard-negative mining by Strassen products of int64 tiles and mergeable heaps.

1. Components become floor(scale * x), 64-bit integers. Rows are cut into blocks by a hash of the row; each pair of an anchor
   block and a candidate block is one tile, so that a task holds two bounded blocks whatever the input's size.
2. A tile's products come from Strassen's recursion on int64 with zero padding: additions, subtractions and leaf products
   are exact (modulo 2^64, so a score that fits 64 bits is exact whatever the intermediate sums are).
3. First pass: in each tile only anchors and candidates of one label are multiplied, and each anchor keeps the heap of its
   `positives` best. Heaps of all tiles merge by rank, before and after the shuffle.
4. Second pass: anchors carry their positives; each (anchor, positive) keeps the heap of the `negatives` best rows of other
   labels within floor_percent..100 % of the positive's score (no such window is there for a negative score).

Higher scores come first, then the smaller id. Rows with a null id, label or vector, or with a null or non-finite component,
take no part; components beyond 64 bits are held at the ends of that range. Vectors of different lengths never meet. Rows
that repeat id, label and vector count once; different rows with one id all count, but an anchor is never its own positive,
nor are rows with its id. All ties are told by id. Anchors without positives, and positives without negatives, give no row.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspine.llm.common import discard, materialize, table


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    floor_percent: int = 80
    block: int = 4096
    strip: int = 256
    leaf: int = 8


def strassen(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """The product of two int64 matrices; odd sides are padded with zeros."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, r, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :r], a[:h, r:], a[h:, :r], a[h:, r:]
    b11, b12, b21, b22 = b[:r, :w], b[:r, w:], b[r:, :w], b[r:, w:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    low, high = strassen(a21 + a22, b11, leaf), strassen(a11 + a12, b22, leaf)
    right, left = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    c = np.empty((2 * h, 2 * w), np.int64)
    c[:h, :w] = both + left - high + strassen(a12 - a22, b21 + b22, leaf)
    c[:h, w:] = right + high
    c[h:, :w] = low + left
    c[h:, w:] = both - low + right + strassen(a21 - a11, b11 + b12, leaf)
    return c[:m, :n]


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest allowed scores of each row, equal scores by smaller id."""
    some = np.flatnonzero(allowed.any(axis=1))
    if not len(some):
        return some, some
    part, may = scores[some], allowed[some]
    if part.shape[1] > k:
        held = np.where(may, part, np.iinfo(np.int64).min)
        may &= part >= np.partition(held, -k, axis=1)[:, [-k]]
    i, j = np.nonzero(may)
    order = np.lexsort((ids[j], -part[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(len(some)))
    keep = np.arange(len(i)) - first[i] < k
    return some[i[keep]], j[keep]


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t.column("q").combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    return tuple(t.filter(pa.compute.equal(t.column("side"), x)) for x in (0, 1))


def _positives(s: Settings):
    names = ["a", "score", "vec_id"]

    def tile(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim = key[2].as_py()
        anchors, rows = _sides(t)
        out: list[tuple[np.ndarray, ...]] = []
        a, own, label = (_column(anchors, c) for c in ("a", "vec_id", "label"))
        ids, other = (_column(rows, c) for c in ("vec_id", "label"))
        left, right = _matrix(anchors, dim), _matrix(rows, dim)
        for one in np.intersect1d(label, other):
            x, y = np.flatnonzero(label == one), np.flatnonzero(other == one)
            columns = right[y].T
            for lo in range(0, len(x), s.strip):
                part = x[lo : lo + s.strip]
                scores = strassen(left[part], columns, s.leaf)
                i, j = best(scores, own[part][:, None] != ids[y][None, :], ids[y], s.positives)
                out.append((a[part][i], scores[i, j], ids[y][j]))
        return pa.table({n: np.concatenate([np.empty(0, np.int64), *(o[k] for o in out)]) for k, n in enumerate(names)})

    return tile


def _negatives(s: Settings):
    names = ["a", "p", "score", "vec_id"]

    def tile(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim = key[2].as_py()
        anchors, rows = _sides(t)
        out: list[tuple[np.ndarray, ...]] = []
        a, label = (_column(anchors, c) for c in ("a", "label"))
        ids, other = (_column(rows, c) for c in ("vec_id", "label"))
        left, columns = _matrix(anchors, dim), _matrix(rows, dim).T
        held = anchors.column("tops").combine_chunks()
        tops = np.full((len(a), s.positives), np.iinfo(np.int64).min)
        tops[np.arange(s.positives)[None, :] < pa.compute.list_value_length(held).to_numpy()[:, None]] = held.flatten().to_numpy()
        for lo in range(0, len(a) if len(ids) else 0, s.strip):
            part = slice(lo, lo + s.strip)
            scores = strassen(left[part], columns, s.leaf)
            differs = label[part][:, None] != other[None, :]
            for p in range(s.positives):
                top = tops[part, p][:, None]
                # n * 100 >= top * floor_percent without a product that could pass 64 bits
                least = top - top // 100 * (100 - s.floor_percent) - top % 100 * (100 - s.floor_percent) // 100
                i, j = best(scores, differs & (scores <= top) & (scores >= least) & (top >= 0), ids, s.negatives)
                out.append((a[part][i], np.full(len(i), p, np.int64), scores[i, j], ids[j]))
        return pa.table({n: np.concatenate([np.empty(0, np.int64), *(o[k] for o in out)]) for k, n in enumerate(names)})

    return tile


def _ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The merged heaps: Spark ranks with a limit before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, s: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). is_anchor tells anchors by column vec_id."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * s.scale)).alias("q")).dropDuplicates()
    rows = materialize(rows.withColumn("dim", F.size("q")), "negatives-rows")
    anchors = materialize(rows.where(is_anchor).withColumn("a", F.monotonically_increasing_id()), "negatives-anchors")
    blocks = lambda df: max(1, ceil(df.count() / s.block))
    of_anchors, of_rows = blocks(anchors), blocks(rows)
    own = lambda n: F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def tiles(asking: DataFrame, work, schema: str) -> DataFrame:
        right = rows.select(F.lit(1).alias("side"), every(of_anchors).alias("i"), own(of_rows).alias("j"), "dim", "vec_id", "label", "q")
        left = asking.withColumns({"side": F.lit(0), "i": own(of_anchors)}).withColumn("j", every(of_rows))
        return left.unionByName(right, allowMissingColumns=True).groupBy("i", "j", "dim").applyInArrow(work, schema)

    near = _ranked(tiles(anchors, _positives(s), "a long, score long, vec_id long"), ["a"], s.positives)
    near = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("near"))  # at most `positives` a list
    near = materialize(near, "negatives-positives")
    asking = anchors.join(near.select("a", F.col("near.score").alias("tops")), "a")
    found = _ranked(tiles(asking, _negatives(s), "a long, p long, score long, vec_id long"), ["a", "p"], s.negatives)
    out = found.join(near, "a").join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a").withColumn("positive", F.col("near")[F.col("p").cast("int")])
    out = out.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
    out = materialize(out, "negatives-result")
    discard(rows, anchors, near)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    v = v.withColumn("label", F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(v, F.pmod("vec_id", F.lit(100)) == 0)


SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) AS rank, n.other AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
