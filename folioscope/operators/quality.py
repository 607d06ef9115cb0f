"""Audits over facts, documents and whole collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.amounts import value_status
from ..functions.dates import as_of_reason


def audit_facts(facts: DataFrame) -> DataFrame:
    """Every fact with its value status and as-of complaint; NULL means fine."""
    report = F.date_format("report_date", "yyyy-MM-dd")
    return facts.withColumn("value_status", value_status(F.col("value_text"), F.col("value_num"))).withColumn(
        "as_of_reason", as_of_reason(F.col("as_of_date"), report, F.col("metric"))
    )


def audit_totals(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count("*").alias("facts"),
        F.count_if(F.col("value_status") == "scale_mismatch").alias("scale_mismatch"),
        F.count_if(F.col("value_status") == "fillable").alias("fillable"),
        F.count_if(F.col("as_of_reason").isNotNull()).alias("stale_as_of"),
    )


def health(documents: DataFrame, chunks: DataFrame, facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Row counts of the stores and the review backlog, one row per measure."""

    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")

    return (
        counted(documents, "documents")
        .unionByName(counted(documents.where("needs_review"), "needs_review"))
        .unionByName(counted(chunks, "chunks"))
        .unionByName(counted(facts, "facts"))
        .unionByName(counted(vectors, "vectors"))
    )
