"""The append-only processing log (JSON lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.records import latest_per_key

MANIFEST_SCHEMA = (
    "doc_id string, source string, source_relative string, source_size bigint, source_mtime_ns bigint, "
    "sha256 string, started_at string, status string, batch_id string, uploaded_at string, result string, "
    "raw_zip string, error string, finished_at string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every readable record with its place in the log; corrupt and blank lines are left out.

    The place is (file modification time, file name, block start, row): rows come in file
    order inside a split and splits are numbered in file order.
    """
    schema = f"{MANIFEST_SCHEMA}, _corrupt_record string"
    parsed = spark.read.schema(schema).json(path)
    placed = parsed.select(
        "*",
        F.struct(
            F.col("_metadata.file_modification_time").alias("written"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
    )
    # A scan that keeps only the corrupt column is not allowed, so data columns stay in the filter.
    return placed.where(F.col("_corrupt_record").isNull() & F.coalesce("sha256", "source", "doc_id").isNotNull()).drop(
        "_corrupt_record"
    )


def successes(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("status") == "success")


def latest_by_hash(manifest: DataFrame) -> DataFrame:
    keyed = manifest.where(F.col("sha256").isNotNull() & (F.col("sha256") != ""))
    return latest_per_key(keyed, ["sha256"], ["line_no"])


def latest_by_source(manifest: DataFrame) -> DataFrame:
    keyed = manifest.where(F.col("source").isNotNull() & (F.col("source") != ""))
    return latest_per_key(keyed, ["source"], ["line_no"])


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
