"""Snapshots and folders to write to."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..session import shuffles_dropped


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions below a root, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and files.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """Changes whenever a file at or below the path is added, replaced or resized."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    states = [path]
    entries = files.listFiles(location, True)
    while entries.hasNext():
        entry = entries.next()
        states.append(f"{entry.getPath()} {entry.getLen()} {entry.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(states)).encode()).hexdigest()[:16]


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    versions = _versions(spark, root)
    return spark.read.parquet(f"{root}/version={versions[-1]}") if versions else None


def write_snapshot(frame: DataFrame, root: str) -> DataFrame:
    """Writes the next version and returns it; readers keep the old one until it is complete."""
    spark = frame.sparkSession
    versions = _versions(spark, root)
    target = f"{root}/version={versions[-1] + 1 if versions else 0}"
    with shuffles_dropped(spark):
        frame.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def write_document_buckets(frame: DataFrame, root: str, buckets: int = 256) -> None:
    """Overwrites only the document buckets the frame holds."""
    from pyspark.sql import functions as F

    bucketed = frame.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    bucketed.repartition("doc_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "doc_bucket"
    ).parquet(root)


def write_texts(texts: DataFrame, root: str) -> None:
    """Cleaned Markdown as new files, one folder per document; inputs are never rewritten."""
    texts.select("doc_id", "text").write.partitionBy("doc_id").option("lineSep", "\n").text(root)
