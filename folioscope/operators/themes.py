"""Theme counts over documents: heat curves, boards, splits and sub-categories.

Documents are unique by doc_id and doc_themes by (doc_id, theme).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.dates import time_bucket
from ..functions.like import contains_like
from ..functions.text import has_text, is_foreign


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal, halves to even; 0 for an empty whole."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(part / whole * 100, 1))


def tagged_documents(documents: DataFrame, doc_themes: DataFrame, theme: str) -> DataFrame:
    """Documents carrying a theme that contains the text; a semi-join, so no duplicates arise."""
    return documents.join(doc_themes.where(contains_like(F.col("theme"), theme)), "doc_id", "left_semi")


def theme_heat(documents: DataFrame, doc_themes: DataFrame, theme: str, by: str = "month") -> DataFrame:
    tagged = tagged_documents(documents, doc_themes, theme)
    return tagged.groupBy(time_bucket(F.col("report_date"), by).alias("bucket")).agg(F.count("*").alias("docs"))


def theme_heat_all(documents: DataFrame, doc_themes: DataFrame, by: str = "month") -> DataFrame:
    """Every theme's own curve in one pass."""
    dated = documents.select("doc_id", time_bucket(F.col("report_date"), by).alias("bucket"))
    return doc_themes.join(dated, "doc_id").groupBy("theme", "bucket").agg(F.count("*").alias("docs"))


def top_themes(doc_themes: DataFrame, limit: int = fixed.TOP_THEMES_LIMIT) -> DataFrame:
    counts = doc_themes.groupBy("theme").agg(F.count("*").alias("docs"))
    return counts.orderBy(F.desc("docs"), "theme").limit(limit)


def split_counts(grouped) -> DataFrame:
    """Domestic and foreign document counts with their shares, for a grouping over `lang`."""
    foreign = F.count_if(is_foreign(F.col("lang")))
    counts = grouped.agg(F.count("*").alias("total"), foreign.alias("foreign"))
    counts = counts.withColumn("domestic", F.col("total") - F.col("foreign"))
    return counts.withColumn("domestic_pct", percentage(F.col("domestic"), F.col("total"))).withColumn(
        "foreign_pct", percentage(F.col("foreign"), F.col("total"))
    )


def domestic_foreign_split(
    documents: DataFrame, doc_themes: DataFrame | None = None, theme: str | None = None
) -> DataFrame:
    scope = documents if not theme else tagged_documents(documents, doc_themes, theme)
    return split_counts(scope.groupBy())


def sub_categories(doc_themes: DataFrame, theme: str, limit: int = fixed.SUBCATEGORY_LIMIT) -> DataFrame:
    """Themes that share documents with exactly this theme, with their share of its documents."""
    base = doc_themes.where(F.col("theme") == theme)
    total = base.agg(F.count("*").alias("n")).scalar()
    others = doc_themes.where(F.col("theme") != theme).join(base.select("doc_id"), "doc_id", "left_semi")
    counts = others.groupBy("theme").agg(F.count("*").alias("docs"))
    top = counts.orderBy(F.desc("docs"), "theme").limit(limit)
    return top.withColumn("pct", percentage(F.col("docs"), total))


def institutions(documents: DataFrame, floor: int = fixed.INSTITUTION_FLOOR) -> DataFrame:
    named = documents.where(F.col("institution").isNotNull() & has_text(F.col("institution")))
    return named.groupBy("institution").agg(F.count("*").alias("docs")).where(F.col("docs") >= floor)


def chain_themes(nodes: DataFrame) -> DataFrame:
    return nodes.select("theme").distinct().orderBy("theme")
