"""URL filters: rules by host and path first, then gradient-boosted trees on lexical features.

Rules fit a host with all its subdomains where the path starts with theirs; the longest (host and path together) wins,
then the first in text order. They are a short list, written into one expression.

Where no rule fits, the chance of a boosted ensemble decides. Its features come from the address alone: lengths of url, host,
path and query, depth, host labels and hyphens, digit ratios, entropies of host and path, counts of parameters, scheme, and
statistics of the host's suffix (its last two labels): how many urls have it and which share of its labelled urls is bad.
Counts and shares cover all rows. The trees are fitted on at most about `sample_rows` urls of each label.

Labels: a column of 0/1; null rows teach nothing. `seed_label` makes one where none is given: 1 if a part of the host is a
word of a seed list, else 0. The words themselves are no feature, so that what is learnt are the shapes of such hosts.

Null urls and urls without '://' have an empty host and path; they are scored like others. Repeated rows stay. Without
labels of both kinds the model's chance is 0. An empty table gives no rows. All columns of the input stay; columns named
host, path, rule, chance or verdict are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspine.llm.common import discard, materialize, table

# The rules of the query, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Words in hosts that seed the labels.
SEEDS = ["ad", "ads", "adult", "adserver", "bet", "bets", "casino", "clickbait", "gambling", "loans", "malware", "phishing", "pills", "poker", "porn", "slots", "spam", "torrent", "tracker", "viagra", "warez", "xxx"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 10_000
    trees: int = 20
    depth: int = 3
    seed: int = 13
    cut: float = 0.5
    broadcast_rows: int = 200_000


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return df.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def matched(rules: list[tuple[str, str, str]], host: Column, path: Column, give) -> Column:
    """give(rule) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(give((v, h, p)))) for v, h, p in ordered]
    return F.coalesce(*(F.when(x, y) for x, y in fits), F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Bits for each character."""
    n = F.length(text)
    of = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when(of(c) > 0, of(c) * F.log2(of(c))).otherwise(0.0))).otherwise(0.0)


def share(text: Column, kind: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, kind, ""))) / n).otherwise(0.0)


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def lexical(df: DataFrame, url: str = "url") -> tuple[DataFrame, list[str]]:
    """Adds the lexical features of url, host and path, and the suffix; gives their names."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    f = {
        "f_length": F.length(u), "f_host_length": F.length(host), "f_path_length": F.length(path), "f_query_length": F.length(query),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")), "f_labels": F.when(host != "", count_of(host, ".") + 1).otherwise(0), "f_hyphens": count_of(host, "-"),
        "f_longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), F.lit(0)),
        "f_digits": share(u, "[0-9]+"), "f_host_digits": share(host, "[0-9]+"), "f_odd": share(u, r"[A-Za-z0-9/:.]+"),
        "f_host_entropy": entropy(host), "f_path_entropy": entropy(path), "f_parameters": F.when(query != "", count_of(query, "&") + 1).otherwise(0), "f_secure": u.startswith("https://").cast("int"),
    }
    suffix = F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2), ".")
    return df.withColumns({k: v.cast("double") for k, v in f.items()}).withColumn("f_suffix", suffix), list(f)


def suffix_statistics(df: DataFrame) -> DataFrame:
    """(f_suffix, f_suffix_urls, f_suffix_bad): logarithm of the urls of a suffix, and the smoothed share of bad ones among the labelled."""
    y = F.col("_label").cast("double")
    rate = (F.coalesce(F.sum(y), F.lit(0.0)) + 0.5) / (F.count(y) + 1)
    return df.groupBy("f_suffix").agg(F.log1p(F.count(F.lit(1))).alias("f_suffix_urls"), rate.alias("f_suffix_bad"))


def seed_label(host: Column, words: list[str] = SEEDS) -> Column:
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words))).cast("int")


def fit(rows: DataFrame, features: list[str], s: Settings) -> Model | None:
    """The ensemble from rows with features and _label; None if only one label is there. Copies of a url teach once."""
    known = rows.where(F.col("_label").isin(0, 1)).select(*features, F.col("_label").cast("double").alias("y"), "_url")
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    place = lambda k: F.pmod(F.xxhash64("_url"), F.lit(max(k, s.sample_rows)))
    pick = reduce(lambda a, b: a | b, ((F.col("y") == y) & (place(k) < s.sample_rows) for y, k in n.items()))
    learn = known.where(pick).groupBy("_url").agg(F.min(F.struct("y", *features)).alias("x")).select("x.*")
    learn = materialize(learn.coalesce(4), "urls-sample")
    model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=s.trees, maxDepth=s.depth, stepSize=0.3, seed=s.seed).fit(VectorAssembler(inputCols=features, outputCol="features").transform(learn))
    discard(learn)
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], s: Settings = Settings(), url: str = "url", label: str | None = None) -> DataFrame:
    """pages with host, path, rule, chance (of being bad) and verdict. label: a column of pages, else seed_label."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "chance", "verdict")]
    named = [F.col(f"`{label}`").cast("int").alias("_label")] if label else []
    rows = with_parts(pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.col(f"`{url}`").cast("string").alias("_url"), *named), "_url")
    if not label:
        rows = rows.withColumn("_label", seed_label(F.col("host")))
    rows, names = lexical(rows, "_url")
    suffixes = materialize(suffix_statistics(rows), "urls-suffixes")
    small = suffixes.count() <= s.broadcast_rows
    rows = rows.join(F.broadcast(suffixes) if small else suffixes, "f_suffix")
    names = [*names, "f_suffix_urls", "f_suffix_bad"]
    model = fit(rows, names, s)
    if model is None:
        rows = rows.withColumn("chance", F.lit(0.0))
    else:
        rows = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows)).withColumn("chance", vector_to_array("probability")[1])
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(matched(rules, host, path, lambda r: r[0]), F.when(F.col("chance") >= s.cut, "block").otherwise("allow"))
    return rows.select("_row.*", "host", "path", matched(rules, host, path, lambda r: r[1] + r[2]).alias("rule"), "chance", verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "chance")
