"""Catalogue rows out of the processing log, the texts on disk and their images."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.dates import date_reason, iso_from_yymmdd
from ..functions.names import base_name, category_from_path, month_from_path, parsed_name, week_from_path
from ..functions.text import detect_language


def describe_files(files: DataFrame, today: dt.date, overrides: DataFrame | None = None) -> DataFrame:
    """Adds parsed metadata and review flags to rows with file_name and source_relative.

    `overrides` holds verified dates as (doc_id, report_date text).
    """
    parsed = files.withColumn("parsed", parsed_name(F.col("file_name")))
    dated = parsed.withColumn("iso", iso_from_yymmdd(F.col("parsed.yymmdd")))
    if overrides is not None:
        verified = overrides.select("doc_id", F.col("report_date").alias("verified"))
        dated = dated.join(verified, "doc_id", "left").withColumn("iso", F.coalesce("verified", "iso")).drop("verified")
    category = category_from_path(F.col("source_relative"))
    described = dated.select(
        *[name for name in dated.columns if name not in ("parsed", "iso")],
        "parsed.title", "parsed.institution", category.alias("category"),
        F.col("iso").try_cast("date").alias("report_date"),
        week_from_path(F.col("source_relative")).alias("week"),
        month_from_path(F.col("source_relative")).alias("month"),
        "parsed.stock_code", "parsed.page_count",
        F.concat_ws(
            "; ", F.col("parsed.reason"), date_reason(F.col("iso"), today),
            F.when(category.isNull(), fixed.REASON_CATEGORY_MISSING),
        ).alias("review_reason"),
    )
    return described.withColumn("needs_review", F.col("review_reason") != "").withColumn(
        "review_reason", F.nullif("review_reason", F.lit(""))
    )


def verified_dates(spark) -> DataFrame:
    rows = list(fixed.DATE_OVERRIDES.items())
    return spark.createDataFrame(rows, "doc_id string, report_date string")


def build_catalog(
    manifest: DataFrame, texts: DataFrame, images: DataFrame, today: dt.date, indexed_at: Column
) -> DataFrame:
    """One row per successfully processed document whose text exists.

    The last success record of a document wins. `texts` holds (doc_id, md_path, text),
    `images` (doc_id, image_count).
    """
    done = manifest.where(F.col("status") == "success").withColumn(
        "doc_id",
        F.when(F.coalesce("sha256", F.lit("")) != "", F.substring("sha256", 1, 32)).otherwise(F.col("doc_id")),
    ).where(F.col("doc_id") != "")
    last = done.groupBy("doc_id").agg(
        F.max_by(F.struct("sha256", "source", "source_relative"), "line_no").alias("record")
    )
    origin = F.coalesce(F.nullif("record.source", F.lit("")), "record.source_relative", F.lit(""))
    named = last.select(
        "doc_id", "record.sha256", base_name(origin).alias("file_name"),
        F.coalesce("record.source_relative", F.lit("")).alias("source_relative"),
    )
    measured = texts.select(
        "doc_id", "md_path", detect_language(F.col("text")).alias("lang"), F.length("text").alias("char_count")
    )
    present = named.join(measured, "doc_id").join(images, "doc_id", "left").fillna(0, ["image_count"])
    described = describe_files(present, today, verified_dates(manifest.sparkSession))
    return described.withColumnRenamed("file_name", "source_filename").withColumn("indexed_at", indexed_at)


def catalog_report(manifest: DataFrame, catalog: DataFrame, previous: DataFrame | None) -> DataFrame:
    """One row of run counters; successes count log records, not documents."""
    success = manifest.where(F.col("status") == "success")
    total = success.agg(F.count("*").alias("n")).scalar()
    ids = success.select(F.coalesce(F.substring("sha256", 1, 32), "doc_id").alias("doc_id")).distinct()
    missing = ids.join(catalog.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n")).scalar()
    known = catalog.join(previous.select("doc_id"), "doc_id", "left_semi") if previous is not None else catalog.limit(0)
    updated = known.agg(F.count("*").alias("n")).scalar()
    return catalog.agg(
        F.count("*").alias("documents"), F.count_if("needs_review").alias("needs_review")
    ).select(
        total.alias("total_success"), (F.col("documents") - updated).alias("inserted"), updated.alias("updated"),
        missing.alias("skipped_without_text"), "needs_review",
    )
