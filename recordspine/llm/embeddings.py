"""Near duplicates among embeddings by int8 tile products with rigorous error bounds.

1. Equal vectors collapse to one class (its smallest vec_id); a very common vector costs one row.
2. Each class falls into one bucket in each of L hash tables (signs of k random projections). k follows the number of
   classes, so that buckets keep their size as the input grows; L follows k so that two vectors at the threshold share
   no bucket with a chance of at most `miss`.
3. A bucket is one tile; buckets above `block` rows are cut into blocks, and each pair of blocks is one tile. In a tile,
   vectors are quantised to int8 with their own scale; for u = û + e the product differs from that of û by at most
   |e_u||v̂| + |e_v||û| + |e_u||e_v|. Only pairs whose product plus bound reaches the threshold are computed again in
   double precision, and that decides. A tile is worked off in strips, so that its memory is bounded whatever it finds.
4. A pair that shares several buckets counts in its first table alone. A tile returns sums and a spanning set of its
   links, never its pairs; components follow by label propagation.

The column keeps its element type: floats as floats, all others as doubles; cosines are doubles.
Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths are never compared. Repeated vec_ids with equal vectors count as copies. Extra columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspine.llm.common import connected_components, discard, materialize, table
from recordspine.llm.minhash import spanning


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    miss: float = 1e-4
    bucket: int = 2048
    block: int = 4096
    strip: int = 256
    seed: int = 17


def tables_for(classes: int, s: Settings) -> tuple[int, int]:
    """Bits of a bucket and number of tables; up to one bucket's size all vectors meet in one."""
    bits = ceil(log2(classes / s.bucket)) if classes > s.bucket else 0
    hit = (1 - acos(s.threshold) / pi) ** bits
    return bits, ceil(log(s.miss) / log(1 - hit)) if bits else 1


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and the length of what quantising took away, for each unit vector."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(units - q * scale[:, None], axis=1)


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float, strip: int = 256, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows of left and right with cosine >= threshold in double precision, i < j if both are the same."""
    (ql, sl, el), (qr, sr, er) = quantise(left), quantise(right)
    qr = qr.astype(np.float32).T  # sums of int8 products are exact in float32 up to 1040 dimensions
    slack = 2.0**-23 * left.shape[1] if left.shape[1] > 1040 else 1e-12
    for lo in range(0, len(left), strip):
        part, first = slice(lo, lo + strip), lo if same else 0
        about = (ql[part].astype(np.float32) @ qr[:, first:]).astype(np.float64) * sl[part, None] * sr[None, first:]
        about += el[part, None] * (1 + er[first:])[None, :] + er[None, first:] * (1 + el[part])[:, None] + el[part, None] * er[None, first:] + slack
        i, j = np.nonzero(about >= threshold)
        i, j = i + lo, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 15):
            a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            keep = np.einsum("ij,ij->i", left[a], right[b]) >= threshold
            yield a[keep], b[keep]


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(raw: pd.Series, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1)


def _hashed(reps: DataFrame, bits: int, tables: int, s: Settings, kind: np.dtype) -> DataFrame:
    """One row a class and table: (t, code, class_id, copies, dim, v, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sizes = pa.compute.list_value_length(part.column(2)).to_numpy()
                ends, flat = np.cumsum(sizes), part.column(2).flatten().to_numpy()
                for dim in np.unique(sizes):
                    own = np.flatnonzero(sizes == dim)
                    x = flat[(ends[own] - dim)[:, None] + np.arange(dim)].astype(kind)
                    if dim not in planes:
                        planes[dim] = np.random.default_rng(s.seed).standard_normal((dim, bits * tables))
                    signs = (_units(x) @ planes[dim] > 0).reshape(len(own), tables, bits)
                    codes = (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                    fixed = [part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(np.full(len(own), dim, np.int32)), pa.array([v.tobytes() for v in x]), pa.array([c.tobytes() for c in codes])]
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(codes[:, t]), *fixed], names=["t", "code", "class_id", "copies", "dim", "v", "codes"])

    return reps.mapInArrow(run, "t int, code int, class_id long, copies long, dim int, v binary, codes binary")


def near_duplicates(vectors: DataFrame, s: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    held = vectors.schema[embedding].dataType
    single = isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType)
    kind = np.dtype(np.float32 if single else np.float64)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("v").isNotNull() & finite, F.lit(False)))
    rows = rows.withColumns({"k1": F.when(F.col("ok"), F.xxhash64("v")), "k2": F.when(F.col("ok"), F.xxhash64(F.lit(3), "v"))})
    classes = rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "embedding-classes")
    reps = rows.where("ok").join(classes, ["k1", "k2"]).where("vec_id = class_id").dropDuplicates(["k1", "k2"]).select("class_id", "copies", "v")
    reps = materialize(reps, "embedding-representatives")
    bits, tables = tables_for(reps.count(), s)
    entries = _hashed(reps, bits, tables, s, kind)
    # Only buckets that are larger than a block need to be known; the others are one tile.
    large = entries.groupBy("t", "code", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.block)
    large = materialize(large.select("t", "code", "dim", F.ceil(F.col("n") / (s.block // 2)).cast("int").alias("blocks")), "embedding-buckets")
    cut = entries.join(large, ["t", "code", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def tile(key, f: pd.DataFrame) -> pd.DataFrame:
        t, own_i, own_j = key[0], key[3], key[4]
        f = f.sort_values("class_id", kind="stable")
        left, right = f[f["own"] == own_i], f[f["own"] == own_j]
        empty = pd.DataFrame({"class_id": [], "links": [], "reach": []}).astype("int64")
        if not len(left) or not len(right) or len(f) < 2:
            return empty
        codes = [np.frombuffer(b"".join(x["codes"]), dtype=np.int32).reshape(len(x), -1) for x in (left, right)]
        same = own_i == own_j
        ids, copies = ((left[c] if same else pd.concat([left[c], right[c]])).to_numpy() for c in ("class_id", "copies"))
        links, label = np.zeros(len(ids)), np.arange(len(ids))
        for i, j in tile_links(_units(_rows(left["v"], kind)), _units(_rows(right["v"], kind)), s.threshold, s.strip, same):
            new = (codes[0][i] == codes[1][j]).argmax(axis=1) == t
            i, j = i[new], j[new] if same else j[new] + len(left)
            links += np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
            label = spanning(len(ids), np.concatenate([i, np.arange(len(ids))]), np.concatenate([j, label]))
        some = links > 0
        return pd.DataFrame({"class_id": ids[some], "links": links[some].astype(np.int64), "reach": ids[label][some]})

    found = materialize(cut.select("t", "code", "dim", "i", "j", "own", "class_id", "copies", "v", "codes").groupBy("t", "code", "dim", "i", "j").applyInPandas(tile, "class_id long, links long, reach long"), "embedding-links")
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("class_id <> reach").select(F.col("class_id").alias("a"), F.col("reach").alias("b")))
    known = classes.join(counts, "class_id", "left").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    own = F.coalesce("component", "vec_id")
    return rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), usable AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, coalesce(l.component, v.vec_id) AS component_id, coalesce(l.component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN counts c ON c.a = v.vec_id LEFT JOIN least l ON l.node = v.vec_id
"""
