"""Ranked lexical search by a dual-tree traversal.

1. Items are cut into rounds of about `round_bytes` of text, so that the vocabulary which is sent to the tasks is bounded; a
   larger benchmark is answered in several rounds, each over all documents. Terms that no item holds count in a document's
   length only.
2. A first job over whole texts writes each document's length and its counts of the round's terms. The numbers of documents
   and terms, and each term's documents, are sums over that table.
3. In a task, documents form trees of up to `tree_docs` (ordered by their weightiest term) whose nodes hold, for each term,
   the maximum of its part of a score over their documents; items form a tree whose nodes hold each term's largest
   count. The product of two nodes' maxima bounds all scores between them. A pair of nodes is left out if its bound is
   under the weakest k-th score of the node's items; equal bounds are not, since ties are told by doc_id. What remains is
   scored exactly, the pairs with the highest bound first.
4. The same search over a sample of about `seed_docs` documents gives each item's k-th score there. That is a lower bound
   of the true one, so it only prunes: the main search covers all documents. Lists of k merge by rank.

Parts of scores are never negative, so maxima bound them. A null or empty text has no terms; a document without terms
counts nowhere and an item without terms gets no rows. A document with a null id counts in all statistics, but is not
listed. Repeated documents are documents of their own; rows that repeat an item's id and text count once, and texts that
share an id are answered each. Texts may be of any length and are read whole. Empty tables give no rows. Extra columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from heapq import heappush, heapreplace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordspine.llm.common import discard, materialize, slices, table


@dataclass(frozen=True)
class Settings:
    k: int = 10
    round_bytes: int = 1 << 20
    seed_docs: int = 20_000
    tree_docs: int = 8192
    doc_leaf: int = 64
    item_leaf: int = 8
    fanout: int = 8
    node_bytes: int = 64 << 20


# A term is made of letters, digits and all that is beyond ASCII; in UTF-8 the latter are the bytes from 0x80 on.
_WORD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


@dataclass
class Node:
    """first..last: items or documents of the node; idx, top: the terms of its items and their largest counts."""

    first: int
    last: int
    children: list[Node] = field(default_factory=list)
    idx: np.ndarray | None = None
    top: np.ndarray | None = None


def grow(leaves: list[Node], fanout: int) -> Node:
    """Nodes over nodes until one is left."""
    while len(leaves) > 1:
        leaves = [Node(g[0].first, g[-1].last, g) for g in (leaves[i : i + fanout] for i in range(0, len(leaves), fanout))]
    return leaves[0]


class Items:
    """A round's items with their vocabulary and tree."""

    def __init__(self, rows: list[tuple[object, str | None]], s: Settings):
        counted = [(key, Counter(terms(text))) for key, text in rows]
        counted = [(key, c) for key, c in counted if c]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
        sparse = [(key, np.array(sorted(self.vocabulary[t] for t in c), dtype=np.int64), {self.vocabulary[t]: n for t, n in c.items()}) for key, c in counted]
        sparse.sort(key=lambda x: x[1].tolist())  # items with like terms stand together
        self.keys = [key for key, _, _ in sparse]
        self.idx = [idx for _, idx, _ in sparse]
        self.count = [np.array([c[i] for i in idx.tolist()], dtype=np.int64) for _, idx, c in sparse]
        if self.keys:
            self.root = grow([Node(i, min(i + s.item_leaf, len(self.keys))) for i in range(0, len(self.keys), s.item_leaf)], s.fanout)
            self._fill(self.root)

    def _fill(self, node: Node) -> None:
        for c in node.children:
            self._fill(c)
        parts = [(c.idx, c.top) for c in node.children] or [(self.idx[i], self.count[i]) for i in range(node.first, node.last)]
        flat, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        node.idx, where = np.unique(flat, return_inverse=True)
        node.top = np.zeros(len(node.idx), dtype=np.int64)
        np.maximum.at(node.top, where, n)


class Search:
    """Heaps of a task's best documents for each item."""

    def __init__(self, items: Items, weights: np.ndarray, floors: np.ndarray, s: Settings):
        self.items, self.weights, self.s = items, weights, s
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items.keys]
        self.kth = np.maximum(floors, 1)  # the least score that may still enter
        self.scored = 0

    def add(self, ids: np.ndarray, m: np.ndarray, length: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents with their numbers of terms (at least one each), then the terms and counts of all of them."""
        part = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, length)))
        ends = np.cumsum(length)
        begin = ends - length
        best = np.maximum.reduceat(part, begin)
        weightiest = np.minimum.reduceat(np.where(part == np.repeat(best, length), term, len(self.weights)), begin)
        order = np.lexsort((-best, weightiest))
        at = np.repeat(begin[order] - np.concatenate([[0], np.cumsum(length[order])[:-1]]), length[order]) + np.arange(len(term))
        self.ids, self.term, self.part = ids[order], term[at], part[at]
        self.ptr = np.concatenate([[0], np.cumsum(length[order])])
        leaves = [Node(i, min(i + self.s.doc_leaf, len(ids))) for i in range(0, len(ids), self.s.doc_leaf)]
        root = grow(leaves, self.s.fanout)
        self._maxima(root)
        self._visit(self.items.root, root, self._bound(self.items.root, root))

    def _maxima(self, node: Node) -> None:
        if node.children:
            for c in node.children:
                self._maxima(c)
            node.top = reduce(np.maximum, (c.top for c in node.children))
        else:
            node.top = np.zeros(len(self.weights), dtype=np.int64)
            own = slice(self.ptr[node.first], self.ptr[node.last])
            np.maximum.at(node.top, self.term[own], self.part[own])

    @staticmethod
    def _bound(item: Node, doc: Node) -> int:
        return int(doc.top[item.idx] @ item.top)

    def _visit(self, item: Node, doc: Node, bound: int) -> None:
        if bound < self.kth[item.first : item.last].min():
            return
        if not item.children and not doc.children:
            return self._score(item, doc)
        if item.children and (not doc.children or item.last - item.first >= self.s.item_leaf * (doc.last - doc.first) // self.s.doc_leaf):
            pairs = [(c, doc) for c in item.children]
        else:
            pairs = [(item, c) for c in doc.children]
        for bound, _, (x, d) in sorted(((self._bound(*p), -i, p) for i, p in enumerate(pairs)), reverse=True, key=lambda z: z[:2]):
            self._visit(x, d, bound)

    def _score(self, item: Node, doc: Node) -> None:
        self.scored += 1
        own = slice(self.ptr[doc.first], self.ptr[doc.last])
        seen = np.isin(self.term[own], item.idx)
        place = np.searchsorted(item.idx, self.term[own][seen])
        part, row = self.part[own][seen], np.repeat(np.arange(doc.last - doc.first), np.diff(self.ptr[doc.first : doc.last + 1]))[seen]
        if not len(row):
            return
        rows, starts = np.unique(row, return_index=True)
        for i in range(item.first, item.last):
            counts = np.zeros(len(item.idx), dtype=np.int64)
            counts[np.searchsorted(item.idx, self.items.idx[i])] = self.items.count[i]
            scores = np.add.reduceat(counts[place] * part, starts)
            heap = self.heaps[i]
            for r in np.flatnonzero(scores >= self.kth[i]).tolist():
                entry = (int(scores[r]), -int(self.ids[doc.first + rows[r]]))
                if len(heap) < self.s.k:
                    heappush(heap, entry)
                elif entry > heap[0]:
                    heapreplace(heap, entry)
            if len(heap) == self.s.k:
                self.kth[i] = max(self.kth[i], heap[0][0])

    def found(self) -> pa.RecordBatch:
        rows = [(i, score, -doc) for i, heap in enumerate(self.heaps) for score, doc in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "score", "doc_id"])


def counts(docs: DataFrame, items: Items, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, term, tf) of documents with a term: all its terms' number, and the round's terms with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # bounded by Settings.round_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.get
        for whole in batches:
            for batch in slices(whole, "text"):
                n, held = [], []
                for t in batch.column(1):
                    words = terms(t.as_py())
                    own = Counter(map(known, words))
                    own.pop(None, None)
                    n.append(len(words))
                    held.append(own)
                size = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int32)
                lists = lambda each: pa.ListArray.from_arrays(pa.array(size), pa.array(np.fromiter((x for h in held for x in each(h)), dtype=np.int32, count=size[-1])))
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), lists(Counter.keys), lists(Counter.values)], names=["doc_id", "n", "term", "tf"])
                yield out.filter(pa.compute.greater(out.column(1), 0))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def searched(rows: DataFrame, items: Items, weights: np.ndarray, floors: np.ndarray, s: Settings) -> DataFrame:
    """(item, score, doc_id, rank): the k best of rows (doc_id, m, term, tf) for each item."""
    sent = rows.sparkSession.sparkContext.broadcast((items, weights, floors))
    nodes = max(2, s.node_bytes // max(1, 8 * len(weights)))
    size = min(s.tree_docs, max(1, nodes - nodes // s.fanout - 8) * s.doc_leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value, s)
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                b = whole.slice(start, size)
                length = pa.compute.list_value_length(b.column(2)).to_numpy()
                flat = [b.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3)]
                search.add(b.column(0).to_numpy(), b.column(1).to_numpy(), length, *flat)
        yield search.found()

    own = rows.where(F.col("doc_id").isNotNull() & (F.size("term") > 0)).select("doc_id", "m", "term", "tf")
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return own.mapInArrow(run, "item int, score long, doc_id long").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.k)


def _round(docs: DataFrame, items: Items, s: Settings, doc_id: str, text: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    rows = materialize(counts(docs, items, doc_id, text), "lexical-counts")
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = np.zeros(len(items.vocabulary), dtype=np.int64)
    for t, w in df.select("term", weight).toLocalIterator():  # a row for each term of the round
        weights[t] = w
    m = F.lit(25).cast("long") + F.expr(f"cast((cast(75 as decimal(38,0)) * n * {n_docs}) div {max(1, n_terms)} as long)")
    rows_m = rows.withColumn("m", m)
    floors = np.zeros(len(items.keys), dtype=np.int64)
    if n_docs > 2 * s.seed_docs:
        some = rows_m.where(F.pmod(F.xxhash64("doc_id"), F.lit(n_docs)) < s.seed_docs)
        for i, score in searched(some, items, weights, floors, s).where(F.col("rank") == s.k).select("item", "score").toLocalIterator():
            floors[i] = score
    keys = spark.createDataFrame(list(enumerate(items.keys)), f"item int, item_id {kind}")
    out = searched(rows_m, items, weights, floors, s).join(F.broadcast(keys), "item")  # the items of one round
    out = materialize(out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical-found")
    discard(rows)
    return out


def search(docs: DataFrame, items: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0."""
    kind = items.schema[item_id].dataType.simpleString()
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.length("text") > 0).distinct()
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = max(1, ceil(total / s.round_bytes))
    out = [docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")]
    for i in range(rounds):
        own = Items([tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == i).toLocalIterator()], s)
        if own.keys:
            out.append(_round(docs, own, s, doc_id, text, kind))
    return reduce(DataFrame.unionByName, out)


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), whole AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM words),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, whole),
parts AS (
  SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS part
  FROM tf JOIN weights USING (term) JOIN lengths ON lengths.doc_id = tf.doc_id, whole
), scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
