"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A document is toxic if one of its sentences is: P(toxic) = 1 - prod(1 - p(sentence)), p a logistic model over hashed
words of the sentence. Only documents are labelled; the gradient of the noisy-or shares each document's error out among
its sentences by their own scores, so the model learns which sentences and words carry the label, and later locates
them. Words, and the
beginnings of words, start from their smoothed log odds; only those that speak for toxicity can carry weight.

Fitted on a bounded sample of labelled rows (`sample_rows`, chosen by the hash of doc_id); scoring covers every row and
whole texts, in the order of sentences. Null and empty texts have no sentence and score the prior of an empty document,
which lies under 0.5. Without labelled rows of both classes nothing is known: every score is the prior of 0. Repeated
label rows count as often as they occur; null labels don't count. Inputs are texts alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, log1p
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspine.llm.common import claim_memos, table

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"\w+")


SPOKEN = re.compile(r"\w[^.!?\n]*")  # once in each sentence that has a word


def logistic(z: float) -> float:
    return 1 / (1 + exp(-min(max(z, -700.0), 700.0)))


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 5_000
    buckets: int = 1 << 18
    steps: int = 80
    rate: float = 0.1
    l2: float = 1e-4
    bias: float = -6.0
    least_documents: int = 4  # labelled 1, that hold a word or beginning, before it can carry weight
    least_lift: float = 1.5


@dataclass
class Model:
    weights: np.ndarray = field(repr=False)
    bias: float
    empty: float  # score of a document without sentences
    seen: set[str] = field(default_factory=set, repr=False)
    carrying: dict[str, float] = field(default_factory=dict, repr=False)
    hot: set[str] = field(default_factory=set, repr=False)  # the words of carrying
    heavy: dict[int, float] = field(default_factory=dict, repr=False)  # the buckets that have weight

    def forget(self) -> None:
        self.seen.clear()
        self.carrying.clear()
        self.hot.clear()

    def learn(self, words: set[str]) -> None:
        """Tell for each word whether it carries weight; most don't."""
        if len(self.seen) > 200_000:
            self.forget()
        n = len(self.weights)
        if not self.heavy:
            self.heavy.update((int(b), float(self.weights[b])) for b in np.flatnonzero(self.weights))
        self.seen |= words
        for word in words:
            x = sum(self.heavy.get(b, 0.0) for b in features(word, n))
            if x:
                self.carrying[word] = x
        self.hot = set(self.carrying)

    def logit(self, sentence: str) -> float | None:
        """Of a sentence by its distinct words; null if none of them carries weight."""
        words = set(WORD.findall(sentence))
        if not words <= self.seen:
            self.learn(words - self.seen)
        some = words & self.hot
        return self.bias + sum(self.carrying[w] for w in sorted(some)) if some else None

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence that has a word, in order; code points."""
        out = []
        for m in SENTENCE.finditer(text or ""):
            if WORD.search(m[0]):
                z = self.logit(m[0])
                out.append((m.start(), m.end(), logistic(self.bias if z is None else z)))
        return out

    def read(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text and its sentences of at least 0.5."""
        sentences = SPOKEN.findall(text or "")
        if not sentences:
            return self.empty, []
        told = [z for x in sentences if (z := self.logit(x)) is not None]
        quiet = len(sentences) - len(told)
        clean = quiet * log1p(-min(logistic(self.bias), 1 - 1e-12)) + sum(log1p(-min(logistic(z), 1 - 1e-12)) for z in told)
        loud = max([*told, self.bias]) >= 0
        return 1 - exp(clean), [x for x in self.sentence_scores(text) if x[2] >= 0.5] if loud else []

    def score(self, sentences: list[tuple[int, int, float]]) -> float:
        if not sentences:
            return self.empty
        return 1 - exp(sum(log1p(-min(s, 1 - 1e-12)) for _, _, s in sentences))


def features(word: str, buckets: int) -> list[int]:
    """Buckets of a word: itself in lower case and its beginnings of 3 to 6 letters, which stand for its stem."""
    w = word.lower().encode("utf-8", "surrogatepass") if word.isascii() else None
    if w is not None:  # the same, without a text for each beginning
        return [crc32(w) % buckets, *(crc32(b"-", crc32(w[:n])) % buckets for n in range(3, min(len(w), 7)))]
    w = word.lower()
    return [crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in (w, *(f"{w[:n]}-" for n in range(3, min(len(w), 7))))]


def noisy_or_fit(y: np.ndarray, sentences: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, s: Settings) -> Model:
    """Gradient steps (Adam) on the likelihood of the document labels.

    y: the documents' labels; sentences: how many each has; lengths: words' buckets in each sentence; tokens: the buckets.
    """
    bare = y[sentences == 0]
    y, sentences = y[sentences > 0].astype(float), sentences[sentences > 0]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(s.buckets, dtype=np.float32), -50.0, 0.0)
    rows, docs = len(lengths), len(y)
    of_sentence = np.repeat(np.arange(rows, dtype=np.int32), lengths)
    of_doc = np.repeat(np.arange(docs, dtype=np.int32), sentences)
    seen = np.zeros(s.buckets, dtype=bool)
    seen[tokens] = True
    used = np.flatnonzero(seen)
    place = np.zeros(s.buckets, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    tokens = place[tokens]
    pos, neg = np.zeros(len(used)), np.zeros(len(used))
    ends = np.searchsorted(of_sentence, np.cumsum(sentences))  # documents with a bucket, a few hundred at a time
    for lo in range(0, docs, 256):
        a, b = ends[lo - 1] if lo else 0, ends[min(lo + 256, docs) - 1]
        pair = np.unique(of_doc[of_sentence[a:b]].astype(np.int64) * len(used) + tokens[a:b])
        labels = y[pair // len(used)]
        pos += np.bincount(pair % len(used), weights=labels, minlength=len(used))
        neg += np.bincount(pair % len(used), weights=1 - labels, minlength=len(used))
    lift = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / (docs - y.sum() + 1))
    # Only what speaks for the label may carry weight; the rest is noise that long sentences would add up.
    speaks = (pos >= s.least_documents) & (lift > s.least_lift)
    used, w = used[speaks], lift[speaks]
    kept, place = speaks[tokens], np.cumsum(speaks) - 1
    tokens, of_sentence = place[tokens[kept]], of_sentence[kept]
    bias, m, v = s.bias, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, s.steps + 1):
        z = bias + np.bincount(of_sentence, weights=w[tokens], minlength=rows)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(of_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=docs))
        doc_p = np.clip(1 - clean, 1e-9, 1 - 1e-9)
        # d loglik / d z of a sentence: p for the label 1 as shared by noisy-or, -p for the label 0.
        gz = p * (y / doc_p - 1)[of_doc] / docs
        g = np.append(np.bincount(tokens, weights=gz[of_sentence], minlength=len(used)) - s.l2 * w, gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w, bias = np.maximum(w + move[:-1], 0.0), bias + move[-1]
    weights = np.zeros(s.buckets, dtype=np.float32)
    weights[used] = w
    return Model(weights, float(bias), float((bare.sum() + 0.1) / (len(bare) + 1)))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """labels: (doc_id, label 0/1) rows to learn from. At most about sample_rows documents reach the driver, as buckets."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
    n = known.count()
    if n > s.sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(n)) < s.sample_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(known, "doc_id").select("doc_id", "y", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = lru_cache(30_000)(lambda w: features(w, s.buckets))  # kept for this partition
        for f in frames:
            lengths, words = [], []
            for t in f["text"]:
                parts = [x for m in SENTENCE.finditer(t or "") if (x := [b for w in set(WORD.findall(m[0])) for b in hashed(w)])]
                lengths.append(np.array([len(x) for x in parts], dtype=np.int32).tobytes())
                words.append(np.array([x for part in parts for x in part], dtype=np.int32).tobytes())
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "lengths": lengths, "words": words})

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(run, f"doc_id {kind}, y int, lengths binary, words binary").toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[("doc_id", "ascending"), ("y", "ascending")]))
    y, sentences = got.column("y").to_numpy(), pc.binary_length(got.column("lengths")).to_numpy() // 4
    lengths, words = (np.frombuffer(b"".join(x.as_py() for x in got.column(c)), dtype=np.int32) for c in ("lengths", "words"))
    del got
    return noisy_or_fit(y, sentences, lengths, words, s)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_sentences (start, end, score of sentences of at least 0.5, in order)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by Settings.buckets

    @F.pandas_udf("struct<score:double,found:array<struct<start:int,end:int,score:double>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim_memos("toxicity", sent.value.forget)
        for texts in batches:
            read = [sent.value.read(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in read], "found": [[{"start": a, "end": b, "score": p} for a, b, p in f] for _, f in read]})

    out = docs.withColumn("_toxic", run(F.col(text).cast("string")))
    return out.withColumns({"toxicity": F.col("_toxic.score"), "toxic_sentences": F.col("_toxic.found")}).drop("_toxic")


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
