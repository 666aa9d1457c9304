"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, units behind numbers and names inside sentences become typed placeholders, so that a question with other
numbers and names has the same template.

1. Search: of a document every fourth window of 5 template tokens, of a benchmark item all of them; they meet in a
   hash join. Any common run of 8 tokens holds such a window, so no run of 8 is lost.
2. Alignment: for the documents found, all windows of 8 tokens meet the item's; a document and an item are aligned by
   the difference of positions, and matched windows cover item tokens. Windows with fewer than 4 different ordinary tokens don't count.
3. Decision: an alignment counts from 13 covered tokens or half of the item's tokens. Its slots must be consistent: one
   value of the item (typed) stands for one value of the document; else it is a chance match of templates. With
   Settings.whole, as the query and the pipeline have it, this is asked of each stretch, not of the whole alignment: the
   tokens of an unbroken stretch count if the stretch is consistent, or as far as 13 tokens in a row (or half an item)
   in it are, so that one changed name does not clear a text. Without it one clash rejects the alignment.

4. Plain words: with Settings.whole the same search and alignment run over plain lower-cased words, without
   placeholders; an alignment counts from 13 covered words or half of the item's. So copies in other capitals are found.
5. Literal words: with Settings.whole any 13 words in a row that equal the item's also count, and of an item under 13
   words the whole item. This holds for tables, lists and repeated words too, whose windows don't count above, and for
   items under 8 words; signs between words don't matter. An item of one word is thus in each text with that word.

With TEMPLATES, a copy all in capitals has no names to tell and matches between the item's names only, and items
under 8 tokens match nothing. Null and empty texts are clean. Repeated items or rows count once; an id with
several texts is a row or an item for each of them, and windows of two texts never meet in one alignment. Extra columns are
not read, whatever their names; texts may be of any length. Each table of the benchmark (keys, windows, items by their words) is broadcast only after its own rows are counted
and few; otherwise both sides are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspine.llm.common import materialize, table

# Units of measure that follow a number.
UNITS = "km|m|cm|mm|kg|g|mg|lb|lbs|oz|l|ml|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|miles?|feet|ft|inch(?:es)?|meters?|metres?|grams?|liters?|litres?|dollars?|euros?|cents?|usd|eur|percent|degrees?"
NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
SEPARATOR = r"(?:[^\p{L}\p{N}#=.,:/]|[.,:/](?!\p{N})|(?<!\p{N})[.,:/])+"


@dataclass(frozen=True)
class Settings:
    search_words: int = 5
    stride: int = 4
    window: int = 8
    ordinary: int = 4
    run: int = 13
    share: float = 0.5
    broadcast_rows: int = 2_000_000
    whole: bool = True


# The narrower form: templates only, and one clash of values rejects a whole alignment.
TEMPLATES = Settings(whole=False)


def tokens(text: Column, values: bool) -> Column:
    """Array of template tokens; with values, placeholders read like #num=12."""
    shown = "=$0" if values else ""
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[#=\s\p{Z}]+", " ")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;:)] )\p{Lu}\p{Ll}+(?![\p{L}])", f"#name{shown}")
    t = F.regexp_replace(t, NUMBER, f" #num{shown} ")
    unit = rf"(?i)(#num{'=[^ ]*' if values else ''} +)({UNITS})(?![\p{{L}}])"
    t = F.regexp_replace(t, unit, f"$1#unit{'=$2' if values else ''}")
    return F.filter(F.split(F.lower(t), SEPARATOR), lambda x: x != "")


def plain_words(text: Column) -> Column:
    """Array of lower-cased words and numbers."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def windows(column: str, n: int | Column, step: int = 1) -> Column:
    """Array of hashes of each step-th window of n tokens."""
    last = F.size(column) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(column, i + 1, n if isinstance(n, Column) else F.lit(n))).alias("h")))


def template(column: str) -> Column:
    return F.transform(column, lambda x: F.split_part(x, F.lit("="), F.lit(1)))


def consistent(aligned: Column) -> Column:
    """Whether each value of the item stands for one value of the document in these aligned tokens."""
    slots = F.array_distinct(F.transform(F.filter(aligned, lambda x: x["ours"].startswith("#")), lambda x: F.struct(x["ours"].alias("ours"), x["theirs"].alias("theirs"))))
    return F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda x: x["ours"])))


def count_stretches(need: Column) -> Column:
    """Number of tokens in column aligned (by position) that lie in a consistent stretch, or in need consistent tokens in a row."""
    runs = F.array_distinct(F.transform("aligned", lambda x: x["run"]))
    even = F.filter(runs, lambda r: consistent(F.filter("aligned", lambda x: x["run"] == r)))
    of_runs = F.transform(F.filter("aligned", lambda x: F.array_contains(even, x["run"])), lambda x: x["at"])
    heads = F.filter(F.sequence(F.lit(1), F.size("aligned") - need + 1), lambda i: (F.get("aligned", i - 1)["run"] == F.get("aligned", i + need - 2)["run"]) & consistent(F.slice("aligned", i, need)))
    of_heads = F.flatten(F.transform(heads, lambda i: F.transform(F.slice("aligned", i, need), lambda x: x["at"])))
    return F.size(F.array_union(of_runs, of_heads))


def line_up(doc_windows: DataFrame, item_windows: DataFrame, window: int) -> DataFrame:
    """(doc_id, item_id, shift, covered): the item positions that matched windows cover, for each difference of positions."""
    hits = doc_windows.join(item_windows, "h").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift"), "item_at").distinct()
    lined = hits.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("item_at").alias("starts"))  # at most an item's windows
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x, x + window - 1)))))
    return lined.select("doc_id", "item_id", "shift", covered.alias("covered"))


def literal(rows: DataFrame, whole: DataFrame, items: DataFrame, near: Callable[[DataFrame], DataFrame], s: Settings) -> DataFrame:
    """(doc_id, item_id, size, covered): 13 words in a row, or all of a shorter item. From window words on, whole has all documents that can match."""
    n = F.least(F.lit(s.run), F.size("item_words"))
    keys = items.select("item_id", F.size("item_words").alias("size"), n.alias("covered"), F.explode(windows("item_words", n)).alias("w")).select("item_id", "size", "covered", "w.h").distinct()
    keys = materialize(keys, "leak-literals")
    lengths = [r.covered for r in keys.select("covered").distinct().collect()]  # at most 13
    hashed = lambda texts, sizes: texts.select("doc_id", F.explode(F.array_distinct(F.transform(F.concat(*[windows("doc_words", k) for k in sizes]), lambda w: w["h"]))).alias("h"))
    short, long = ([k for k in lengths if (k < s.window) == x] for x in (True, False))
    sides = [hashed(whole, long)] if long else []
    sides += [hashed(rows.select("doc_id", plain_words(F.col("text")).alias("doc_words")), short)] if short else []
    found = [x.join(near(keys), "h").select("doc_id", "item_id", "size", "covered").distinct() for x in sides]
    return reduce(DataFrame.unionByName, found) if found else whole.crossJoin(keys).select("doc_id", "item_id", "size", "covered").limit(0)


def find_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, share, size): one row for each document and benchmark item that it holds; size: the item's words."""
    as_row = lambda i, text: F.struct(F.col(i).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("hash"))  # noqa: E731  one id with two texts is two rows
    items = benchmark.select(as_row(item_id, item_text).alias("item_id"), tokens(F.col(item_text), True).alias("item_tokens"), plain_words(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0 if s.whole else F.size("item_tokens") >= s.window).dropDuplicates()
    items = materialize(items.withColumn("item_template", template("item_tokens")), "leak-items")
    searched = lambda template, words, step: F.concat(windows(template, s.search_words, step), windows(words, s.search_words, step)) if s.whole else windows(template, s.search_words, step)
    keys = materialize(items.select(F.explode(searched("item_template", "item_words", 1)).alias("w")).select("w.h").distinct(), "leak-keys")
    near = lambda x: F.broadcast(x) if x.count() <= s.broadcast_rows else x  # noqa: E731  x is written: counting it costs little
    held = items.agg(F.coalesce(F.sum(F.size("item_tokens") + F.size("item_words")), F.lit(0))).first()[0]
    near_items = F.broadcast(items) if held <= s.broadcast_rows else items

    rows = docs.select(as_row(doc_id, text).alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = rows.select("doc_id", tokens(F.col("text"), False).alias("t"), plain_words(F.col("text")).alias("p")).select("doc_id", F.explode(searched("t", "p", s.stride)).alias("w")).select("doc_id", "w.h")
    near_docs = materialize(seen.join(near(keys), "h", "left_semi").select("doc_id").distinct(), "leak-docs")

    whole = rows.join(near_docs, "doc_id", "left_semi").dropDuplicates()
    whole = materialize(whole.select("doc_id", tokens(F.col("text"), True).alias("doc_tokens"), plain_words(F.col("text")).alias("doc_words")).withColumn("doc_template", template("doc_tokens")), "leak-texts")
    ordinary = lambda column, other: F.size(F.array_distinct(F.filter(F.slice(column, F.col("w.at") + 1, F.lit(s.window)), lambda x: ~x.rlike(other)))) >= s.ordinary
    item_windows = lambda column, other: materialize(items.select("item_id", column, F.explode(windows(column, s.window)).alias("w")).where(ordinary(column, other)).select("item_id", F.col("w.at").alias("item_at"), "w.h"), "leak-windows")
    doc_windows = lambda column: whole.select("doc_id", F.explode(windows(column, s.window)).alias("w")).select("doc_id", F.col("w.at").alias("doc_at"), "w.h")

    lined = line_up(doc_windows("doc_template"), near(item_windows("item_template", "^#")), s.window)
    needed = lambda column: F.least(F.lit(s.run), F.ceil(s.share * F.size(column)).cast("int"))
    both = lined.join(near_items.select("item_id", "item_tokens"), "item_id").where(F.size("covered") >= needed("item_tokens"))
    both = both.join(whole.select("doc_id", "doc_tokens"), "doc_id")
    aligned = F.transform("covered", lambda p, i: F.struct(p.alias("at"), (p - i).alias("run"), F.get("item_tokens", p).alias("ours"), F.get("doc_tokens", p + F.col("shift")).alias("theirs")))
    both = both.select("doc_id", "item_id", F.size("item_tokens").alias("size"), needed("item_tokens").alias("need"), aligned.alias("aligned"))
    counted = count_stretches(F.col("need")) if s.whole else F.when(consistent(F.col("aligned")), F.size("aligned")).otherwise(0)
    found = both.select("doc_id", "item_id", "size", "need", counted.alias("covered")).where("covered >= need").select("doc_id", "item_id", "size", "covered")
    if s.whole:
        worded = line_up(doc_windows("doc_words"), near(item_windows("item_words", r"^\p{N}")), s.window)
        worded = worded.join(near_items.select("item_id", "item_words"), "item_id").where(F.size("covered") >= needed("item_words"))
        found = found.unionByName(worded.select("doc_id", "item_id", F.size("item_words").alias("size"), F.size("covered").alias("covered")))
        found = found.unionByName(literal(rows, whole, items, near, s))
    return found.groupBy(F.col("doc_id.id").alias("doc_id"), F.col("item_id.id").alias("item_id")).agg(F.max("covered").cast("long").alias("covered"), F.max(F.col("covered") / F.col("size")).alias("share"), F.max("size").cast("long").alias("size"))


def flag(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), **columns: str) -> DataFrame:
    """(doc_id, leaked, n_items, item_ids) of every row of docs."""
    doc_id, text = columns.get("doc_id", "doc_id"), columns.get("text", "text")
    rows = docs.withColumn("_row", F.xxhash64(F.col(doc_id), F.col(text).cast("string")))
    found = find_leaks(rows, benchmark, s, **(columns | {"doc_id": "_row"})).groupBy(F.col("doc_id").alias("_row")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = materialize(found, "leaks")
    out = rows.select(F.col(doc_id).alias("doc_id"), "_row").join(found, "_row", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("leaked"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)).alias("item_ids"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = flag(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "leaked", "n_items", F.concat_ws(",", F.col("item_ids").cast("array<string>")).alias("item_ids"))
