"""Near duplicates by MinHash bands, odd sketches and confirmation on full shingle sets.

1. One pass over whole texts makes each document's shingle set and keeps of it: its size, a 128-bit key of the whole
   set, one hash per band of MinHash values, and an odd sketch: all MinHash values folded into a bitmap by parity.
2. Equal sets collapse to one node, written with a number of its own. Only nodes go on.
3. Nodes that share a band hash are candidates. In each bucket the most central member (the one with the fullest
   buckets) is compared with all others: m pairs, not m*m. Two sketches' XOR has about 2k(1-J) odd bits; pairs whose
   estimate lies under the threshold by more than `sketch_margin` are dropped, all others are confirmed on their full
   sets, made with a second hash of the words.
4. Buckets that still hold several components are searched to the end. Each member is set against its bucket's hub; H is
   the hub's set and all shingles that more than one of `common` members of its family have. Of a linked pair (x, y) either
   both share a shingle outside H, or their common part lies in H. For the first case x and y meet in a hash join on the
   rarest shingles outside H: of n shingles the first n - ceil(2tn/(1+t)) + 1 of the smaller set and the first
   n - ceil(tn) + 1 of the larger one, or no such pair is linked (prefix filtering). For the second, the part in H must
   reach t/(1+t) of both sizes together, which few members not linked to the hub do. Pairs in one component are never made.
   All linked pairs of open buckets are among these, whatever H is.
5. Connected components over the confirmed links; members take their node's.

With 24 bands of 4 a pair at similarity 0.8 shares no band with a chance of 3e-6; a pair's sketch misses by the margin
(6 standard deviations at 0.8) with less. Everything found is confirmed exactly. Null and empty texts and texts without words
have empty sets and link with nothing; repeated rows count once; a doc_id with several texts is one document each time, which
text is told by text_hash. Extra columns are not read, so that their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspine.llm.bytehash import U, mix, shingle_sets
from recordspine.llm.common import claim_memos, connected_components, discard, materialize, slices, table


@dataclass(frozen=True)
class NearDuplicates:
    shingle_words: int = 5
    percent: int = 80  # link if 100 * intersection >= percent * union
    bands: int = 24
    rows: int = 4
    samples: int = 96  # MinHash values, all of them in the sketch
    sketch_words: int = 8  # 64-bit words of the sketch
    sketch_margin: float = 0.25
    common: int = 8  # a shingle in more than one of so many members of a family counts as its hub's


_MULTIPLIERS = np.random.default_rng(7).integers(0, 2**63, 4096, dtype=U) * U(2) + U(1)
_SALTS = np.random.default_rng(8).integers(0, 2**63, 4096, dtype=U)


def minhash(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Row i: the k minima of the i-th set (all sets non-empty)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((k, len(sets)), dtype=U)
    moved = np.empty_like(flat)
    for j in range(k):
        np.bitwise_xor(flat, _SALTS[j], out=moved)
        np.multiply(moved, _MULTIPLIERS[j], out=moved)
        out[j] = np.minimum.reduceat(moved, starts)
    return out.T


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    used = samples[:, : bands * rows].reshape(len(samples), bands, rows)
    out = np.zeros((len(samples), bands), dtype=U)
    for r in range(rows):
        out = mix(out * U(31) + used[:, :, r] + U(r))
    return mix(out + np.arange(bands, dtype=U) * _MULTIPLIERS[0])


def odd_sketch(samples: np.ndarray, words: int) -> np.ndarray:
    """Each (position, value) flips one bit of the bitmap: the bits that are set an odd number of times remain."""
    at = mix(samples * U(3) + np.arange(samples.shape[1], dtype=U)[None, :] * _MULTIPLIERS[1])
    word, bit = (at >> U(8)) % U(words), at & U(63)
    out = np.zeros((len(samples), words), dtype=U)
    flips = np.left_shift(U(1), bit)
    for w in range(words):
        out[:, w] = np.bitwise_xor.reduce(np.where(word == U(w), flips, U(0)), axis=1)
    return out


def most_odd_bits(p: NearDuplicates) -> int:
    """Odd bits of an XOR up to which the estimate J = 1 + n/(4k) ln(1 - 2 odd/n) is at least the threshold less the margin."""
    n, low = 64 * p.sketch_words, p.percent / 100 - p.sketch_margin
    return int(n / 2 * (1 - np.exp(-4 * p.samples * (1 - low) / n)))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row number each row reaches over the links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def signatures(docs: DataFrame, p: NearDuplicates) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key1, key2, bands, sketch) of (doc_id, text_hash, text); bands and sketch are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memos("minhash", lambda: None)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = list(shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()], p.shingle_words))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                bands = np.zeros((len(sets), p.bands), dtype=U)
                sketch = np.zeros((len(sets), p.sketch_words), dtype=U)
                keys = np.zeros((len(sets), 2), dtype=U)
                again = list(shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()], p.shingle_words, 1))
                if len(full):
                    own = [sets[i] for i in full]
                    samples = minhash(own, p.samples)
                    bands[full], sketch[full] = band_hashes(samples, p.bands, p.rows), odd_sketch(samples, p.sketch_words)
                    for c, of in enumerate((own, [again[i] for i in full])):  # from two hashes of the words, so 128 bits even for one shingle
                        flat, starts = np.concatenate(of), np.cumsum([0, *(len(x) for x in of[:-1])])
                        keys[full, c] = np.add.reduceat(mix(flat + _SALTS[c]), starts)
                empty = pa.array(n == 0)
                columns = [pa.array(n), *(pa.array(keys[:, c].copy().view(np.int64)) for c in (0, 1)), lists(bands, empty), lists(sketch, empty)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "text_hash", "n_shingles", "key1", "key2", "bands", "sketch"])

    slim = docs.select("doc_id", "text_hash", "text")
    return slim.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, key1 long, key2 long, bands array<long>, sketch array<long>")


def lists(rows: np.ndarray, empty: pa.Array) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(rows) + 1, width, dtype=np.int32)), pa.array(rows.view(np.int64).ravel()), mask=empty)


def odd_bits(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def with_texts(pairs: DataFrame, texts: DataFrame, first: str, second: str) -> DataFrame:
    """The pairs with both texts. The text of second comes first, so that the pairs of a common first can be split."""
    for column in (second, first):
        pairs = pairs.join(texts.select(F.col("node").alias(column), F.col("text").alias(f"text_{column}")), column)
    return pairs


def set_pairs(frame: pd.DataFrame, first: str, second: str, k: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, set of first, set of second); a first that repeats is made once."""
    last, kept = None, np.empty(0, dtype=U)
    for i, (a, ta, tb) in enumerate(zip(frame[first], frame[f"text_{first}"], frame[f"text_{second}"], strict=True)):
        if a != last:
            last, kept = a, next(shingle_sets([ta.encode("utf-8", "surrogatepass")], k, seed))
        yield i, kept, next(shingle_sets([tb.encode("utf-8", "surrogatepass")], k, seed))


def confirm(pairs: DataFrame, texts: DataFrame, p: NearDuplicates) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hit = []
            for i, x, y in set_pairs(f, "a", "b", p.shingle_words, 1):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= p.percent * (len(x) + len(y) - both):
                    hit.append(i)
            yield f.loc[f.index[hit], ["a", "b"]]

    return with_texts(pairs, texts, "a", "b").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def against_hubs(members: DataFrame, texts: DataFrame, p: NearDuplicates) -> DataFrame:
    """(hub, node, n, inside, outside) of (hub, node): the size of the node's set, how many of it are in the hub's, and the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, outside = [], []
            for _, x, y in set_pairs(f, "hub", "node", p.shingle_words, 0):
                n.append(len(y))
                outside.append(np.setdiff1d(y, x, assume_unique=True).view(np.int64))
            sizes = np.array(n, dtype=np.int64)
            yield pd.DataFrame({"hub": f["hub"].to_numpy(), "node": f["node"].to_numpy(), "n": sizes, "inside": sizes - np.array([len(o) for o in outside], dtype=np.int64), "outside": outside})

    return with_texts(members, texts, "hub", "node").select("hub", "node", "text_hub", "text_node").mapInPandas(run, "hub long, node long, n long, inside long, outside array<long>")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, node, component, hub_component), once each, of the buckets (h, hub, node) that hold several components."""
    known = members.join(labels, "node", "left").select("h", "hub", "node", F.coalesce("component", "node").alias("component"))
    several = known.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    found = known.join(several, "h").select("hub", "node", "component").distinct()
    of_hub = labels.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    return found.join(of_hub, "hub", "left").withColumn("hub_component", F.coalesce("hub_component", "hub"))


def unresolved_pairs(members: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """Pairs (a, b) of different components that may be linked; every linked pair of an open bucket is among them.

    members as from open_members, sets as from against_hubs.
    """
    sizes = sets.groupBy("hub").agg(F.count(F.lit(1)).alias("family"))
    shingles = members.join(sets, ["hub", "node"]).select("hub", "node", "component", "hub_component", "n", "inside", F.explode_outer("outside").alias("shingle"))
    times = shingles.where("shingle IS NOT NULL").groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("times"), (F.min("component") < F.max("component")).alias("mixed")).where("times > 1")
    times = times.join(sizes, "hub").withColumn("common", p.common * F.col("times") > F.col("family")).drop("family")
    counted = shingles.join(times, ["hub", "shingle"], "left")
    # A document's shingles at most. Those that are common in the family count as the hub's.
    ranked = counted.groupBy("hub", "node", "component", "hub_component", "n", "inside").agg(
        F.count_if("common").alias("more"), F.array_sort(F.collect_list(F.when(~F.col("common"), F.struct("times", "shingle", "mixed")))).alias("shared"))
    rows = materialize(ranked.withColumn("inside", F.col("inside") + F.col("more")), "minhash-ranked")
    in_order = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("other")))
    fits = (F.col("component") != F.col("other_component")) & (100 * F.col("n") >= p.percent * F.col("m"))
    t = p.percent

    # A shingle outside the hub in common: each set's rarest ones, unique ones first, decide.
    unique = F.col("n") - F.col("inside") - F.size("shared")
    larger = F.col("n") - F.ceil(t * F.col("n") / 100) + 1
    smaller = F.col("n") - F.ceil(2 * t * F.col("n") / (100 + t)) + 1
    prefix = rows.select("hub", "node", "component", "n", smaller.alias("smaller"), unique.alias("unique"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(larger - unique, F.lit(0)).cast("int"))).alias("at", "s"))
    prefix = prefix.where("s.mixed").select("hub", "node", "component", "n", F.col("s.shingle").alias("shingle"), (F.col("unique") + F.col("at") < F.col("smaller")).alias("short"))
    of_larger = prefix.select("hub", "shingle", F.col("node").alias("other"), F.col("component").alias("other_component"), F.col("n").alias("m"))
    by_shingle = prefix.where("short").join(of_larger, ["hub", "shingle"]).where(in_order & fits)

    # Nothing outside the hub in common: what lies inside must do, for both.
    within = rows.where(100 * F.col("inside") >= t * F.col("n")).select("hub", "node", "component", "hub_component", "n", "inside")
    others = within.where("component <> hub_component").select("hub", F.col("node").alias("other"), F.col("component").alias("other_component"), F.col("n").alias("m"), F.col("inside").alias("other_inside"))
    enough = (100 + t) * F.least("inside", "other_inside") >= t * (F.col("n") + F.col("m"))
    by_size = within.join(others, "hub").where((F.col("component") != F.col("other_component")) & enough & (100 * F.least("n", "m") >= t * F.greatest("n", "m")))

    both = [x.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")) for x in (by_shingle, by_size)]
    return both[0].unionByName(both[1]).distinct()


def near_duplicates(docs: DataFrame, p: NearDuplicates = NearDuplicates(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, group, component_id, kept) of every row.

    text_hash: xxhash64 of the text; class_id: the smallest document of the same shingle set; group: a number of its own
    for each component, null without shingles; component_id: the smallest document reachable over links.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sig = materialize(signatures(rows, p), "minhash")
    classes = sig.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("class_id"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    own = classes.withColumnRenamed("class_id", "doc_id")
    reps = materialize(sig.join(own, ["key1", "key2", "doc_id"]).dropDuplicates(["node"]).select("node", "doc_id", "text_hash", "bands", "sketch"), "minhash-nodes")

    entries = reps.select("node", F.explode("bands").alias("h"))
    buckets = materialize(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"), "minhash-buckets")
    members = materialize(entries.join(buckets.where("n > 2").select("h", "n"), "h"), "minhash-members")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weights, "node").groupBy("h").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    members = members.join(materialize(hubs, "minhash-hubs"), "h").select("h", "hub", "node")

    sketches = reps.select("node", "sketch")
    most = most_odd_bits(p)

    def likely(pairs: DataFrame) -> DataFrame:
        for column in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("node").alias(column), F.col("sketch").alias(f"sketch_{column}")), column)
        return pairs.where(odd_bits("sketch_a", "sketch_b") <= most).select("a", "b")

    def texts_of(wanted: DataFrame) -> DataFrame:
        places = reps.select("node", "doc_id", "text_hash").join(wanted.select("node").distinct(), "node", "left_semi")
        return rows.join(places, ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "text")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "minhash-pairs")
        texts = materialize(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "minhash-texts")
        links = materialize(confirm(pairs, texts, p), "minhash-links")
        discard(pairs, texts)
        return links

    star = members.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    links = links_of(likely(star.unionByName(buckets.where("n = 2").select("a", "b")).distinct()))
    labels = connected_components(links)

    still_open = materialize(open_members(members, labels), "minhash-open")
    if not still_open.isEmpty():
        texts = materialize(texts_of(still_open), "minhash-texts")
        sets = materialize(against_hubs(still_open.where("node <> hub").select("hub", "node"), texts, p), "minhash-sets")
        more = links_of(likely(unresolved_pairs(still_open, sets, p)))
        discard(texts, sets)
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))

    named = labels.join(classes.select("node", "class_id"), "node")
    smallest = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    by_class = classes.join(labels, "node", "left").withColumn("group", F.coalesce("component", "node")).join(smallest, "component", "left")
    by_class = by_class.select("key1", "key2", "class_id", "group", F.coalesce("component_id", "class_id").alias("component_id"))
    out = sig.select("doc_id", "text_hash", "n_shingles", "key1", "key2").join(by_class, ["key1", "key2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), "group", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, NearDuplicates(shingle_words=4)).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i : i + 3] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sets AS (
  SELECT doc_id, count(*) AS n, list(s ORDER BY s) AS whole FROM shingles GROUP BY doc_id
), classes AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY md5(CAST(whole AS VARCHAR)), n) AS rep FROM sets
), own AS (
  SELECT md5(CAST(s AS VARCHAR)) AS s, c.doc_id, c.n FROM shingles JOIN classes c ON c.doc_id = shingles.doc_id AND c.rep = c.doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT doc_id, rep FROM classes UNION SELECT rep, doc_id FROM classes
), reach(node, other) AS (
  SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
), least AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, coalesce(l.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id
"""
