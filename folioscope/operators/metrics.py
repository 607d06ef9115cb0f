"""Metric timelines over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.amounts import canonical_amount, canonical_unit, entity_spellings
from ..functions.like import contains_any


def with_effective_date(facts: DataFrame) -> DataFrame:
    """Report date first, as-of text otherwise; ISO text, so partial dates compare too."""
    report = F.date_format("report_date", "yyyy-MM-dd")
    return facts.withColumn("eff_date", F.coalesce(report, F.col("as_of_date")))


def with_normalized_amount(facts: DataFrame) -> DataFrame:
    return facts.withColumn("norm_num", canonical_amount(F.col("value_num"), F.col("unit"))).withColumn(
        "norm_unit", F.when(F.col("value_num").isNotNull(), canonical_unit(F.col("unit")))
    )


def metric_timeline(
    facts: DataFrame,
    documents: DataFrame,
    entity: str | None = None,
    metric: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    limit: int = fixed.TIMELINE_LIMIT,
) -> DataFrame:
    """Dated points of one entity and metric, oldest first, undated last."""
    points = with_effective_date(facts)
    if entity:
        points = points.where(contains_any(F.col("entity"), entity_spellings(entity)))
    if metric:
        points = points.where(F.col("metric") == metric)
    if date_from:
        points = points.where(F.col("eff_date") >= date_from)
    if date_to:
        points = points.where(F.col("eff_date") <= date_to)
    owned = points.join(documents.select("doc_id", "institution", "title"), "doc_id")
    first = owned.orderBy(F.asc_nulls_last("eff_date"), "doc_id", "fact_id").limit(limit)
    return with_normalized_amount(first)


def charted(points: DataFrame) -> DataFrame:
    """Points with a date and a finite value, as (y, unit): normalised where that is possible."""
    chosen = points.withColumn("y", F.coalesce("norm_num", "value_num")).withColumn(
        "unit", F.when(F.col("norm_num").isNotNull(), F.col("norm_unit")).otherwise(F.coalesce("unit", F.lit("")))
    )
    return chosen.where(F.col("eff_date").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y"))


def dominant_units(usable: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent unit per key with its extents; series of one point are not drawn.

    Ties go to the unit whose earliest point comes first.
    """
    counts = usable.groupBy(*keys, "unit").agg(
        F.count("*").alias("points"), F.min(F.struct("eff_date", "doc_id", "fact_id")).alias("first_point"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.min("eff_date").alias("first_date"), F.max("eff_date").alias("last_date"),
    )
    best = Window.partitionBy(*keys).orderBy(F.desc("points"), "first_point")
    first = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") == 1)
    return first.where(F.col("points") >= 2).drop("place", "first_point")


def dominant_unit_series(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points per key in the key's most frequent unit, scaled to 0..1 on both axes."""
    usable = charted(points)
    series = usable.join(dominant_units(usable, keys), [*keys, "unit"])

    def day(name: str) -> Column:
        text = F.col(name)
        return F.unix_date(F.when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text).cast("date"))

    span = day("last_date") - day("first_date")
    height = F.col("y_max") - F.col("y_min")
    return series.withColumn(
        "x_pos", F.when(span == 0, 0.0).otherwise((day("eff_date") - day("first_date")) / span)
    ).withColumn("y_pos", F.when(height == 0, 0.0).otherwise((F.col("y") - F.col("y_min")) / height))
