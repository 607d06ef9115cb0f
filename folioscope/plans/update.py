"""Incremental update: catalogue, then chunks of new documents, then open extractions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.records import upsert
from ..sources.files import image_counts, read_texts
from ..sources.manifest import read_manifest
from ..sources.sinks import read_snapshot, write_snapshot
from .catalog import build_catalog
from .facts import ExtractionProvider, apply_extraction, extract_answers, todo_documents
from .indexing import index_chunks

EMPTY_FACTS = (
    "fact_id string, doc_id string, report_date date, entity string, entity_code string, metric string, "
    "value_num double, value_text string, unit string, direction string, as_of_date string, quote string"
)
EMPTY_THEMES = "doc_id string, theme string"
EMPTY_LOG = (
    "doc_id string, model string, schema_ver int, fact_count int, theme_count int, extracted_at timestamp"
)


def _stored(spark: SparkSession, root: str, schema: str) -> DataFrame:
    found = read_snapshot(spark, root)
    return spark.createDataFrame([], schema) if found is None else found


def run_update(
    spark: SparkSession,
    manifest_path: str,
    canonical_path: str,
    store: str,
    today: dt.date,
    provider: ExtractionProvider | None = None,
    schema_version: int = 1,
    limit: int | None = None,
    tasks: int = 8,
) -> dict[str, DataFrame]:
    """Writes the next snapshot of each table below `store` and returns them.

    Every step hands over a written table, so a lost executor repeats one step only.
    """
    now = F.current_timestamp()
    manifest = read_manifest(spark, manifest_path)
    texts = read_texts(spark, canonical_path, "full.md")
    fresh = build_catalog(manifest, texts, image_counts(spark, canonical_path), today, now)
    previous = read_snapshot(spark, f"{store}/documents")
    documents = write_snapshot(
        fresh if previous is None else upsert(previous, fresh, ["doc_id"]), f"{store}/documents"
    )
    known = texts.join(documents.select("doc_id"), "doc_id", "left_semi")
    chunks = write_snapshot(
        index_chunks(known, read_snapshot(spark, f"{store}/chunks"), new_only=True), f"{store}/chunks"
    )
    result = {"documents": documents, "chunks": chunks}
    if provider is None:
        return result
    log = _stored(spark, f"{store}/extraction_log", EMPTY_LOG)
    todo = todo_documents(documents, log, schema_version, limit).join(texts.select("doc_id", "text"), "doc_id")
    answers = extract_answers(todo, provider, tasks).join(documents.select("doc_id", "report_date"), "doc_id")
    answers = write_snapshot(answers, f"{store}/answers")
    facts, themes, log = apply_extraction(
        answers, _stored(spark, f"{store}/facts", EMPTY_FACTS), _stored(spark, f"{store}/doc_themes", EMPTY_THEMES),
        log, provider.model, schema_version, now,
    )
    for name, frame in (("facts", facts), ("doc_themes", themes), ("extraction_log", log)):
        result[name] = write_snapshot(frame, f"{store}/{name}")
    return result
