"""Facts and themes out of extraction answers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.amounts import first_number
from ..functions.records import parse_loose_json
from ..functions.text import strip
from ..operators.cleaning import normalize_documents
from ..operators.records import replace_documents, upsert

ANSWER_SCHEMA = (
    "facts array<struct<entity:string,entity_code:string,metric:string,value_num:string,value_text:string,"
    "unit:string,direction:string,as_of_date:string,quote:string>>, themes array<string>"
)


class ExtractionProvider(Protocol):
    """Answers one document with JSON text; must be picklable, called inside tasks."""

    model: str

    def extract(self, meta: str, body: str) -> str: ...


def todo_documents(documents: DataFrame, log: DataFrame, schema_version: int, limit: int | None = None) -> DataFrame:
    """Documents this schema version has not seen, newest first when limited."""
    done = log.where(F.col("schema_ver") == schema_version).select("doc_id")
    open_documents = documents.join(done, "doc_id", "left_anti")
    if limit is None:
        return open_documents
    return open_documents.orderBy(F.desc_nulls_last("report_date"), "doc_id").limit(limit)


def extract_answers(documents: DataFrame, provider: ExtractionProvider, tasks: int) -> DataFrame:
    """(doc_id, answer, error) of every window of a text; `tasks` bounds how many calls run at once.

    A text of more than `EXTRACTION_CHARS` characters is asked in as many calls as it has windows; `fact_rows` and
    `theme_rows` unite their answers. A document with a failed window counts as failed as a whole.
    """
    meta = F.concat_ws(" / ", *[F.nullif(F.col(n).cast("string"), F.lit("")) for n in
                                ("institution", "title", "report_date", "category")])
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(fixed.EXTRACTION_CHARS))
    cleaned = normalize_documents(documents).withColumn("text", F.coalesce("text", F.lit("")))
    windows = cleaned.select("doc_id", meta.alias("meta"), "text", F.posexplode(starts).alias("window", "start"))
    body = F.substring(F.col("text"), F.col("start"), F.lit(fixed.EXTRACTION_CHARS))
    prepared = windows.select("doc_id", "window", "meta", body.alias("body"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, window, row_meta, row_body in zip(batch["doc_id"], batch["window"], batch["meta"], batch["body"]):
                try:
                    rows.append((doc_id, window, provider.extract(row_meta, row_body), None))
                except Exception as failure:  # one document must not stop the others
                    rows.append((doc_id, window, None, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(rows, columns=["doc_id", "window", "answer", "error"])

    asked = prepared.repartition(tasks).mapInPandas(ask, "doc_id string, window int, answer string, error string")
    # As many rows as the document has windows.
    return asked.groupBy("doc_id").agg(
        F.first("error", ignorenulls=True).alias("error"),
        F.array_sort(F.collect_list(F.struct("window", "answer"))).alias("windows"),
    ).select("doc_id", F.transform("windows", lambda row: row["answer"]).alias("answers"), "error")


def _parsed(answers: DataFrame) -> DataFrame:
    """A row per window, with `parsed`; a single `answer` is the first window."""
    if "answers" in answers.columns:
        single = answers.select("*", F.posexplode("answers").alias("window", "answer"))
    else:
        single = answers.withColumn("window", F.lit(0))
    return single.withColumn("parsed", parse_loose_json(F.col("answer"), ANSWER_SCHEMA))


def fact_rows(answers: DataFrame) -> DataFrame:
    """Fact table rows of (doc_id, report_date, answer or answers); empty texts become NULL."""
    # An inner explode would let Spark filter on the array first and so parse every answer twice.
    exploded = _parsed(answers).select("doc_id", "report_date", "window", F.posexplode_outer("parsed.facts").alias("position", "fact"))
    filled = exploded.where(F.col("fact").isNotNull())

    def text(name: str) -> Column:
        return F.nullif(F.col(f"fact.{name}"), F.lit("")).alias(name)

    later = F.concat_ws(".", F.col("window").cast("string"), F.col("position").cast("string"))
    place = F.when(F.col("window") == 0, F.col("position").cast("string")).otherwise(later)
    return filled.select(
        F.concat_ws("#", "doc_id", place).alias("fact_id"), "doc_id", "report_date",
        text("entity"), text("entity_code"), text("metric"), first_number(F.col("fact.value_num")).alias("value_num"),
        text("value_text"), text("unit"), text("direction"), text("as_of_date"), text("quote"),
    )


def theme_rows(answers: DataFrame) -> DataFrame:
    themes = _parsed(answers).select("doc_id", F.explode_outer("parsed.themes").alias("theme"))
    themes = themes.withColumn("theme", strip(F.col("theme")))
    return themes.where(F.col("theme") != "").distinct()


def extraction_log_rows(
    answers: DataFrame, facts: DataFrame, themes: DataFrame, model: str, schema_version: int, at: Column
) -> DataFrame:
    fact_counts = facts.groupBy("doc_id").agg(F.count("*").cast("int").alias("fact_count"))
    theme_counts = themes.groupBy("doc_id").agg(F.count("*").cast("int").alias("theme_count"))
    counted = answers.where(F.col("error").isNull()).select("doc_id").join(fact_counts, "doc_id", "left")
    counted = counted.join(theme_counts, "doc_id", "left").fillna(0, ["fact_count", "theme_count"])
    return counted.select(
        "doc_id", F.lit(model).alias("model"), F.lit(schema_version).alias("schema_ver"),
        "fact_count", "theme_count", at.alias("extracted_at"),
    )


def apply_extraction(
    answers: DataFrame, facts: DataFrame, themes: DataFrame, log: DataFrame, model: str, schema_version: int, at: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next snapshots of facts, themes and log. Facts and themes are replaced per document."""
    good = answers.where(F.col("error").isNull())
    new_facts, new_themes = fact_rows(good), theme_rows(good)
    log_rows = extraction_log_rows(good, new_facts, new_themes, model, schema_version, at)
    return (
        replace_documents(facts, new_facts, good),
        replace_documents(themes, new_themes, good),
        upsert(log, log_rows, ["doc_id"]),
    )
