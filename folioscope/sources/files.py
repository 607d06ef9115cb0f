"""Files: whole texts, content hashes, image listings, archives."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

PARENT_FOLDER = "([^/]+)/[^/]+$"
IMAGES_OWNER = "([^/]+)/images/[^/]+$"


def read_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(doc_id, md_path, text) of canonical/<doc_id>/full.md; invalid bytes become U+FFFD."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(
        F.regexp_extract("_metadata.file_path", PARENT_FOLDER, 1).alias("doc_id"),
        F.col("_metadata.file_path").alias("md_path"),
        F.make_valid_utf8("value").alias("text"),
    )


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, modificationTime, length), without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return files.load(path).select("path", "modificationTime", "length")


def image_counts(spark: SparkSession, path: str) -> DataFrame:
    images = list_files(spark, path, "*.jpg").select(F.regexp_extract("path", IMAGES_OWNER, 1).alias("doc_id"))
    return images.where(F.col("doc_id") != "").groupBy("doc_id").agg(F.count("*").alias("image_count"))


def scan_files(spark: SparkSession, path: str, cache: DataFrame | None = None, glob: str = "*.pdf") -> DataFrame:
    """Distinct contents: (sha256, path, length, modificationTime, copies), first path kept.

    `cache` holds (path, length, modificationTime, sha256); only files it does not know
    are read and hashed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    identity = ["path", "length", "modificationTime"]
    if cache is None:
        hashed = reader.load(path).select(*identity, F.sha2("content", 256).alias("sha256"))
    else:
        known = cache.select(*identity, "sha256").dropDuplicates(identity)
        listed = list_files(spark, path, glob)
        reused = listed.join(known, identity)
        fresh = reader.load(path).join(known.select(*identity), identity, "left_anti")
        hashed = reused.unionByName(fresh.select(*identity, F.sha2("content", 256).alias("sha256")))
    first = F.min_by(F.struct("length", "modificationTime"), "path")
    return hashed.groupBy("sha256").agg(
        F.min("path").alias("path"), first.alias("stat"), F.count("*").alias("copies")
    ).select("sha256", "path", "stat.*", "copies")


def new_records(scanned: DataFrame, folder: str, started_at) -> DataFrame:
    """Log rows for files about to be submitted."""
    return scanned.select(
        F.substring("sha256", 1, 32).alias("doc_id"),
        F.col("path").alias("source"),
        F.replace("path", F.lit(folder.rstrip("/") + "/"), F.lit("")).alias("source_relative"),
        F.col("length").alias("source_size"),
        (F.unix_micros("modificationTime") * 1000).alias("source_mtime_ns"),
        "sha256",
        started_at.alias("started_at"),
        F.lit("submitting").alias("status"),
    )


def safe_member(name: str) -> str | None:
    """Relative path of a wanted archive member; None for anything else or for escapes."""
    parts = [part for part in name.replace("\\", "/").split("/") if part]
    if not parts or name.endswith(("/", "\\")) or any(part in (".", "..") for part in parts):
        return None
    wanted = parts[-1].lower().endswith(".md") or any(part.lower() == "images" for part in parts)
    return "/".join(parts) if wanted else None


def extract_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, is_image, content, error) of the Markdown and image members of all archives.

    An archive or member that cannot be read gives one row with the error and no content; the others go on.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "is_image", "content", "error"]
        for batch in batches:
            for archive_path, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for row in archive_members(archive_path, content):
                    rows.append(row)
                    held += len(row[3] or b"")
                    if held > MEMBER_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    return archives.mapInPandas(members, "archive string, member string, is_image boolean, content binary, error string")


# Unpacked bytes that one frame of members holds.
MEMBER_BYTES = 16 << 20


def archive_members(path: str, content: bytes) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as failure:
        yield path, None, None, None, str(failure)
        return
    with archive:
        for info in archive.infolist():
            member = safe_member(info.filename)
            if member:
                is_image = "images" in member.lower().split("/")
                try:
                    yield path, member, is_image, archive.read(info), None
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError) as failure:
                    yield path, member, is_image, None, f"{type(failure).__name__}: {failure}"


def require_inputs(spark: SparkSession, *paths: str) -> None:
    """Fails with the list of missing inputs before any work starts."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    missing = []
    for path in paths:
        location = jvm.org.apache.hadoop.fs.Path(path)
        if not location.getFileSystem(conf).exists(location):
            missing.append(path)
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))
