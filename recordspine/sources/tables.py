"""Readers for the record formats and sinks for snapshots and record sets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a staging record, all text.
STAGING_FIELDS = (
    "candidateRecordVersion stagingRecordId sourceKey sourceUrl sourceMemberUrl sourceSnapshotSha256 fetchedAt extractionStatus displayName officeTitle governmentLevel "
    "jurisdictionName canonicalMatchStatus refreshClass recordKind branch chamber stateName stateCode districtLabel districtNumber partyCode partyName officeRoom phone "
    "rawRowText rawHeadingText termLabel countyDescription firstName lastName serviceStartDateText serviceEndDateText externalMemberId formerMemberName"
).split()
STAGING = T.StructType([*(T.StructField(f, T.StringType()) for f in STAGING_FIELDS), T.StructField("committeeAssignments", T.ArrayType(T.StringType())), T.StructField("_corrupt_record", T.StringType())])
PUBLIC_COLUMNS = {
    "seats": ["seat_id", "seat_name", "jurisdiction_id", "office_type", "branch"],
    "persons": ["person_id", "canonical_name"],
    "occupancies": ["occupancy_id", "seat_id", "person_id", "occupancy_status", "start_date"],
    "claims": ["claim_id", "subject_type", "subject_id", "field_key", "normalized_value", "valid_from", "valid_to"],
    "evidence": ["evidence_id", "source_key", "content_hash"],
}
_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the cluster's shared folder (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or _FALLBACK.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{base.rstrip('/')}/recordspine/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the cluster's shared folder and read back: cuts the plan."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """Record files under path, one JSON object each; broken ones keep their text in _corrupt_record. is_discovery: by path."""
    out = spark.read.schema(STAGING).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    return out.withColumn("file_path", F.col("_metadata.file_path")).withColumn("is_discovery", F.col("file_path").contains("source-discovery"))


def first_of(*names: str, row: str = "row") -> Column:
    """The first alias of a field that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.trim(F.col(f"{row}.{n}")), F.lit("")) for n in names))


def read_xml_roster(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_csv_directory(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A CSV with a header in any of several spellings, to the names of aliases."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    plain = {c.strip().lower().replace(" ", "_"): c for c in raw.columns}
    pick = lambda names: F.coalesce(*(F.nullif(F.trim(F.col(f"`{plain[n]}`")), F.lit("")) for n in names if n in plain), F.lit(None).cast("string"))
    return raw.select(*(pick(names).alias(k) for k, names in aliases.items()))


def json_rows(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Rows of an API payload that is either a list or an object with results."""
    listed = F.from_json(payload, f"array<{schema}>")
    inside = F.from_json(payload, f"struct<results:array<{schema}>>")["results"]
    return df.withColumn("row", F.explode(F.when(F.ltrim(payload).startswith("["), listed).otherwise(inside)))


def unpack_envelope(df: DataFrame, part: str, schema: str, body: str = "body", keys: tuple[str, ...] = ("envelope_id",)) -> DataFrame:
    """One array of a nested result as rows with the envelope's keys."""
    return df.select(*keys, F.inline(F.from_json(body, f"struct<{part}:array<{schema}>>")[part]))


def snapshot_key(source: Column, day: Column, content: Column, ext: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), source, F.date_format(day, "yyyy/MM/dd"), F.concat(F.sha2(content, 256), F.lit("."), ext))


def append_snapshots(df: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Append contents that are not stored yet, by hash, under source/year/month/day; returns what was new."""
    spark = df.sparkSession
    rows = df.withColumn("content_hash", F.sha2(F.col(content), 256)).dropDuplicates(["source_key", "content_hash"])
    rows = rows.withColumns({"year": F.year("retrieved_at"), "month": F.month("retrieved_at"), "day": F.dayofmonth("retrieved_at")})
    try:
        rows = rows.join(spark.read.parquet(path).select("source_key", "content_hash"), ["source_key", "content_hash"], "left_anti")
    except Exception as e:  # noqa: BLE001  only a first run has no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = written(rows, "snapshots")
    rows.write.mode("append").partitionBy("source_key", "year", "month", "day").parquet(path)
    return rows


def replace_records(df: DataFrame, path: str, partition: str) -> None:
    """Replace the record sets of the partitions in df; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).json(path)


def public(table: str, df: DataFrame) -> DataFrame:
    """Only the columns that may be shown; a table without a list may not be read."""
    if table not in PUBLIC_COLUMNS:
        raise PermissionError(f"{table} is not public")
    return df.select(*(c for c in PUBLIC_COLUMNS[table] if c in df.columns))


# Columns that no write may hold.
FORBIDDEN_COLUMNS = ["id", "record_status", "claim_key", "route", "person_key", "content_sha256", "r2_key"]


def assert_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if it holds only columns that the table has, in the table's types, and none that is forbidden; else an error that names the others."""
    types = {f.name: f.dataType for f in schema}
    wrong = {
        "forbidden columns": [c for c in df.columns if c in FORBIDDEN_COLUMNS],
        "unknown columns": [c for c in df.columns if c not in types and c not in FORBIDDEN_COLUMNS],
        "columns of another type": [f.name for f in df.schema if f.name in types and f.dataType != types[f.name]],
    }
    for what, names in wrong.items():
        if names:
            raise ValueError(f"{what}: {', '.join(sorted(names))}")
    return df


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of 1 to 100 rows of the ordered table, with the table's total."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit))).crossJoin(F.broadcast(total))
