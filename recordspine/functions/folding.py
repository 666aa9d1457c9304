"""Names under full compatibility decomposition (NFKD), which no function of Spark gives: ligatures, full-width forms, all letters with marks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(text: str, strict: bool) -> str:
    """Lower-case ASCII words. strict leaves a space where a mark stood; else marks go and their letters stay together."""
    t = unicodedata.normalize("NFKD", text)
    if not strict:
        t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub(r"[^a-zA-Z0-9]+", " ", re.sub("[\"“”']", "", t)).strip().lower()


def with_folded_names(df: DataFrame, name: str, out: str, strict: bool = False) -> DataFrame:
    """df with the folded name in column out; null stays null.

    Plain ASCII names take Spark's own functions. Only the distinct other ones go through Python, by Arrow batches, and are
    joined back, so that a name held by very many rows is decomposed once; the join has one row for a name.
    """

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda n: folded(n, strict))

    own = F.col(name)
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(own, "[\"']", ""), "[^a-zA-Z0-9]+", " ")))
    beyond = F.when(own.rlike(r"[^\x00-\x7F]"), own)
    names = df.select(beyond.alias("_beyond")).where("_beyond IS NOT NULL").distinct().select("_beyond", fold("_beyond").alias("_folded"))
    wide = df.withColumn("_beyond_own", beyond).join(names, F.col("_beyond_own") == F.col("_beyond"), "left")
    return wide.select(*(F.col(f"`{c}`") for c in df.columns if c != out), F.when(F.col("_beyond_own").isNotNull(), F.col("_folded")).otherwise(plain).alias(out))
