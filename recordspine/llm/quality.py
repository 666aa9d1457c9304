"""Quality by hierarchical empirical Bayes: the document's own evidence and what its host and path are like.

A document classifier (logistic, over shares that Spark's own functions count in the text) gives each document a chance
of being good. Grouped sums give every host and path its mean; the spread of the means beyond what chance explains sets
how strongly sparse sites are drawn to their parent: a path to its host, a host to the corpus. A document's site
posterior leaves the document itself out. Result: logit(document) + logit(path posterior) - logit(corpus mean).

Fitted on a bounded sample of labelled rows (`sample_rows`, by the hash of doc_id; only shares reach the driver); all
sums cover all documents. Null and empty texts have no shares and count as bad (chance 0.02); null hosts and paths are
sites of their own. Without labels of both classes every document's chance is 0.5. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspine.llm.common import materialize, table


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    l2: float = 1e-3
    steps: int = 60
    least_variance: float = 1e-5


MEASURES = ("upper", "symbols", "digits", "distinct", "distinct_roots", "line_copies", "sentence_ends", "word_length", "size")


def with_measures(docs: DataFrame, text: str) -> DataFrame:
    """docs with _body and the bounded measures of a text, each from 0 to about 1.

    Built in steps, so that Spark splits a text once and not again wherever a measure is used.
    """
    out = docs.withColumn("_body", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumns({"_n": F.greatest(F.char_length("_body"), F.lit(1)), "_words": F.split("_body", r"[ \n\t]+"), "_lines": F.split("_body", "\n")})
    left = lambda pattern: F.char_length(F.regexp_replace("_body", pattern, ""))
    out = out.withColumns({
        "_w": F.size("_words"), "_dw": F.size(F.array_distinct("_words")), "_l": F.size("_lines"), "_dl": F.size(F.array_distinct("_lines")),
        "_upper": left(r"\p{Lu}+"), "_symbols": left(r"[#$%&*|<>{}\[\]=_~^@!\\/]+"), "_digits": left("[0-9]+"), "_ends": left("[.?]+"),
    }).drop("_words", "_lines")
    c, n = F.col, F.col("_n")
    return out.withColumns({
        "upper": (n - c("_upper")) / n, "symbols": (n - c("_symbols")) / n, "digits": (n - c("_digits")) / n, "distinct": c("_dw") / c("_w"), "distinct_roots": c("_dw") / F.sqrt(c("_w")) / 30,
        "line_copies": 1 - c("_dl") / c("_l"), "sentence_ends": F.least((n - c("_ends")) / c("_w"), F.lit(1.0)), "word_length": F.least(n / c("_w") / 20, F.lit(2.0)), "size": F.least(F.log2(n + 1) / 20, F.lit(1.5)),
    })


def logistic(x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(s.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) / len(y) - s.l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + s.l2 * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def document_chance(measured: DataFrame, labels: DataFrame, s: Settings, doc_id: str, label: str) -> Column:
    """Column of the chance that a document is good, over the measures and fitted on labels; scoring stays in the JVM."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    n = known.count()
    if n > s.sample_rows:
        known = known.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(n)) < s.sample_rows)
    got = measured.where("not_empty").select(F.col("doc_id").alias("_id"), *MEASURES).join(known, "_id").toPandas().sort_values(["_id", "_y"], kind="stable")
    y = got["_y"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return F.when(~F.col("not_empty"), 0.02).otherwise(0.5)
    x = got[list(MEASURES)].to_numpy(dtype=float)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / spread
    # Squares let both too little and too much of a share count.
    w = logistic(np.column_stack([z, np.minimum(z * z, 9)]), y, s)
    total = F.lit(float(w[-1]))
    for i, k in enumerate(MEASURES):
        zi = (F.col(k) - float(mean[i])) / float(spread[i])
        total = total + zi * float(w[i]) + F.least(zi * zi, F.lit(9.0)) * float(w[len(MEASURES) + i])
    chance = 1 / (1 + F.exp(-total))
    return F.when(~F.col("not_empty"), 0.02).otherwise(F.least(F.greatest(chance, F.lit(0.001)), F.lit(0.999)))


def strength(groups: DataFrame, n: str, mean: str, parent: str, s: Settings) -> float:
    """Pseudo-documents of the parent: from the variance of group means beyond sampling (method of moments)."""
    row = groups.agg(
        F.sum(F.col(n) * F.pow(F.col(mean) - F.col(parent), 2)).alias("between"),
        F.sum(F.col("var")).alias("within"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("groups"), F.avg(F.col(parent) * (1 - F.col(parent))).alias("pq"),
    ).first()
    if not row["n"]:
        return 1.0
    per_row = (row["within"] or 0.0) / row["n"]
    tau = max(s.least_variance, ((row["between"] or 0.0) - row["groups"] * per_row) / row["n"])
    return max(1.0, per_row / tau)


def score_quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """(doc_id, document_chance, site_posterior, quality) of every row of docs."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    # A row of numbers for each document; texts are read once.
    measured = materialize(with_measures(slim, "text").select("doc_id", "host", "path", (F.length("_body") > 0).alias("not_empty"), *MEASURES), "quality-measures")
    rows = measured.select("doc_id", "host", "path", document_chance(measured, labels, s, doc_id, label).alias("p"))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mu = min(0.999, max(0.001, (whole["s"] or 0.5) / (whole["n"] or 1)))
    host_means = hosts.select("host", "hn", "hs", (F.col("hs") / F.col("hn")).alias("mean"), F.lit(mu).alias("parent"), (F.col("hss") - F.col("hs") * F.col("hs") / F.col("hn")).alias("var"))
    k_host = strength(host_means, "hn", "mean", "parent", s)
    parents = host_means.select(F.col("host").alias("h"), "hn", "hs", F.col("mean").alias("parent"))
    at_path = paths.join(parents, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    at_path = materialize(at_path.withColumns({"mean": F.col("s") / F.col("n"), "var": F.col("ss") - F.col("s") * F.col("s") / F.col("n")}), "quality-sites")
    k_path = strength(at_path, "n", "mean", "parent", s)
    sites = at_path.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "hn", "hs")
    at = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    host_post = (F.col("hs") - F.col("p") + k_host * mu) / (F.col("hn") - 1 + k_host)
    path_post = (F.col("s") - F.col("p") + k_path * host_post) / (F.col("n") - 1 + k_path)
    site = F.least(F.greatest(path_post, F.lit(0.001)), F.lit(0.999))
    logit = lambda c: F.log(c / (1 - c))
    total = logit(F.col("p")) + logit(site) - float(np.log(mu / (1 - mu)))
    return at.select("doc_id", F.col("p").alias("document_chance"), site.alias("site_posterior"), (1 / (1 + F.exp(-total))).alias("quality"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    out = score_quality(docs, labels)
    return out.select("doc_id", F.round("document_chance", 6).alias("document_chance"), F.round("site_posterior", 6).alias("site_posterior"), F.round("quality", 6).alias("quality"), (F.col("quality") >= 0.5).alias("kept"))
