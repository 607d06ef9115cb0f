"""Material and cache keys for written interpretations of timelines, themes and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..operators.chains import structure_hash
from ..operators.records import upsert
from ..operators.search import within_budget

CACHE_KEYS = ["scope_key", "period", "by_unit"]
PROMPT_VERSION = "chain-interp-v1"


def _named(label: str, value: Column) -> Column:
    filled = F.nullif(value, F.lit(""))
    return F.when(filled.isNotNull(), F.concat(F.lit(label), filled))


def timeline_material(points: DataFrame, keys: list[str], budget: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """Numbered lines per key, oldest point first, cut at the character budget."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("eff_date"), "doc_id", "fact_id")
    numbered = points.withColumn("place", F.row_number().over(order))
    report = F.date_format("report_date", "yyyy-MM-dd")
    value = F.coalesce(F.nullif("value_text", F.lit("")), F.col("value_num").cast("string"))
    line = F.concat_ws(
        "　",
        F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]")),
        _named("出处：", F.concat_ws(" · ", F.nullif("institution", F.lit("")), F.nullif("title", F.lit("")))),
        _named("发布日：", report),
        F.when(~F.col("as_of_date").eqNullSafe(report), _named("标注期：", F.col("as_of_date"))),
        _named("指标：", F.col("metric")),
        F.when(value.isNotNull(), F.concat(F.lit("值："), value, F.coalesce("unit", F.lit("")))),
        _named("方向：", F.col("direction")),
        _named("原文：", F.col("quote") if "quote" in points.columns else F.lit(None).cast("string")),
    )
    sized = numbered.withColumn("line", line).withColumn("line_chars", F.length("line"))
    return within_budget(sized, keys, "place", "line_chars", budget)


def trend_lines(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("line", F.concat(F.col("bucket"), F.lit("："), F.col("docs").cast("string"), F.lit(" 篇")))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """One line per group: its name, stage and segment names in order."""
    segments = nodes.where(F.col("node_type") == "segment").groupBy("parent_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("segments")
    )
    groups = nodes.where(F.col("node_type") == "group").select(
        "theme", F.col("node_id").alias("parent_id"), "seq", "name", "stage"
    )
    names = F.array_join(F.transform("segments", lambda entry: entry["name"]), "、")
    line = F.concat(
        F.lit("- "), F.col("name"), F.lit("（"), F.coalesce("stage", F.lit("")), F.lit("）："), F.coalesce(names, F.lit(""))
    )
    return groups.join(segments, "parent_id", "left").select("theme", "seq", line.alias("line"))


def buckets_hash(buckets: DataFrame, split: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of a scope's buckets and split; buckets per scope are bounded by the calendar."""
    listed = buckets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "docs"))).alias("buckets"))
    joined = listed.join(split, keys)
    parts = [name for name in split.columns if name not in keys]
    text = F.to_json(F.struct("buckets", F.struct(*parts).alias("split")))
    return joined.select(*keys, F.substring(F.sha2(text, 256), 1, 16).alias("input_hash"))


def tree_input_hash(nodes: DataFrame, signatures: DataFrame, model: str) -> DataFrame:
    """Cache key of a tree's interpretation: structure, evidence, prompt version and model."""
    joined = structure_hash(nodes).join(signatures, "theme")
    text = F.concat_ws("|", "structure_hash", "evidence_hash", F.lit(PROMPT_VERSION), F.lit(model))
    return joined.select("theme", F.substring(F.sha2(text, 256), 1, 16).alias("input_hash"))


def cache_lookup(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted keys with their cached payload; NULL payload where the inputs changed."""
    return wanted.join(
        cache.select(*CACHE_KEYS, "input_hash", "payload", "model", "created_at"), [*CACHE_KEYS, "input_hash"], "left"
    )


def cache_store(cache: DataFrame, entries: DataFrame) -> DataFrame:
    return upsert(cache, entries, CACHE_KEYS)
