"""From raw documents to training pieces: toxicity, near duplicates, decontamination, personal data, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspine.llm import decontamination, minhash, pii, sentencepiece_fst, toxicity
from recordspine.llm.common import materialize, table


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """_row, the whole row as one struct, and the named columns: no name of the input can clash with one of a stage."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(v.alias(k) for k, v in columns.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is at least 0.5; the model learns from all labels of the documents at hand.

    Null and empty texts have the score that empty texts of the labelled rows give; repeated rows all go or stay. Extra
    columns stay, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(packed(docs, text=F.col("text")), model).where("toxicity < 0.5").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays (five words, similarity 0.8): that of the smallest doc_id; of equal rows, one.

    Texts without words are in no group and stay, but once for each doc_id and text. A doc_id with several texts is one
    document each time: a row goes only with its own text's group. Extra columns stay, whatever their names.
    """
    found = materialize(minhash.near_duplicates(docs).select("doc_id", "text_hash", "group").distinct(), "pipeline-groups")
    grouped = found.where(F.col("group").isNotNull())
    first = grouped.groupBy("group").agg(F.min("doc_id").alias("first"))
    same_id = grouped.join(first, "group").where("doc_id = first").groupBy("group", "first").agg(F.min("text_hash").alias("first_hash"))
    removed = grouped.join(same_id, "group").where("doc_id <> first OR text_hash <> first_hash").select("doc_id", "text_hash")
    removed = materialize(removed, "pipeline-removed")
    hashed = packed(docs, _id=F.col("doc_id").cast("long"), _hash=F.xxhash64(F.col("text").cast("string")))
    repeated = materialize(hashed.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id", "_hash"), "pipeline-repeated")
    keys = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    left = hashed.join(removed.select(*keys), ["_id", "_hash"], "left_anti")
    if not repeated.isEmpty():
        once = left.join(repeated, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
        left = left.join(repeated, ["_id", "_hash"], "left_anti").unionByName(once)
    return left.select("_row.*")


LEAST_WORDS = 5  # of an item whose documents go


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text holds a benchmark item of at least five words; null and empty texts stay, and so does a clean
    text whose doc_id another, leaking text has too.

    A shorter item ("yes") stands in very many clean texts: it is reported by decontamination.flag, but removes nothing.
    Extra columns stay, whatever their names.
    """
    hashed = packed(docs, _key=F.xxhash64("doc_id", F.col("text").cast("string")), text=F.col("text"))
    leaks = decontamination.find_leaks(hashed, table(spark, sf_dir, "benchmark").select("item_id", "text"), doc_id="_key")
    leaks = materialize(leaks.where(F.col("size") >= LEAST_WORDS).select(F.col("doc_id").alias("_key")).distinct(), "pipeline-leaks")
    return hashed.join(leaks, "_key", "left_anti").select("_row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets; n_chars follows. Null texts stay null; repeated rows and extra columns stay,
    whatever their names."""
    found = pii.detect_pii(packed(docs, text=F.col("text")))
    new = {"text": F.col("redacted_text"), "n_chars": F.char_length("redacted_text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*((new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_pieces, piece_ids)."""
    pieces = sentencepiece_fst.encode(docs)
    return pieces.select("doc_id", "lang", "source", "n_chars", F.greatest(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("sentencepiece", to_pieces),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
