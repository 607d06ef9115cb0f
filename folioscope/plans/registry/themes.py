"""Theme counts, metric timelines and fact audits over the order tables."""

from pyspark.sql import functions as F

from ...functions.amounts import canonical_entity
from ...functions.dates import as_of_reason
from ...operators import metrics, quality, themes
from ...plans import material
from ...sources import tables as t
from . import REGISTRY
from .views import COMPANY, DOCS, REPORTS, TAGS, UNITS, facts

WEEK = "strftime(report_date, '%Y-W%W')"
MONTH = "strftime(report_date, '%Y-%m')"


def _heat_sql(bucket: str) -> str:
    return f"""WITH {REPORTS}, {TAGS}
SELECT {bucket} AS bucket, count(DISTINCT doc_id) AS docs FROM reports JOIN tags USING (doc_id)
WHERE lower(theme) LIKE '%ring%' GROUP BY 1"""


@REGISTRY.add("theme_heat_month", _heat_sql(MONTH))
def theme_heat_month(spark, sf):
    return themes.theme_heat(t.order_reports(spark, sf), t.order_themes(spark, sf), "ring", "month")


@REGISTRY.add("theme_heat_week", _heat_sql(WEEK))
def theme_heat_week(spark, sf):
    return themes.theme_heat(t.order_reports(spark, sf), t.order_themes(spark, sf), "RING", "week")


@REGISTRY.add(
    "theme_heat_month_all",
    f"""WITH {REPORTS}, {TAGS}
SELECT theme, {MONTH} AS bucket, count(DISTINCT doc_id) AS docs FROM reports JOIN tags USING (doc_id) GROUP BY ALL""",
)
def theme_heat_month_all(spark, sf):
    return themes.theme_heat_all(t.order_reports(spark, sf), t.order_themes(spark, sf), "month")


@REGISTRY.add(
    "top_themes",
    f"""WITH {TAGS} SELECT theme, count(DISTINCT doc_id) AS docs FROM tags GROUP BY theme ORDER BY docs DESC, theme LIMIT 30""",
)
def top_themes(spark, sf):
    return themes.top_themes(t.order_themes(spark, sf))


SPLIT = """count(*) AS total, count(*) FILTER (lower(lang) LIKE 'en%') AS "foreign",
count(*) FILTER (lang IS NULL OR lower(lang) NOT LIKE 'en%') AS domestic,
round_even(count(*) FILTER (lang IS NULL OR lower(lang) NOT LIKE 'en%') / count(*)::DOUBLE * 100, 1) AS domestic_pct,
round_even(count(*) FILTER (lower(lang) LIKE 'en%') / count(*)::DOUBLE * 100, 1) AS foreign_pct"""


@REGISTRY.add("domestic_foreign_split", f"WITH {DOCS} SELECT {SPLIT} FROM docs")
def domestic_foreign_split(spark, sf):
    return themes.domestic_foreign_split(t.text_documents(spark, sf))


@REGISTRY.add(
    "domestic_foreign_split_theme",
    f"""WITH {REPORTS}, {TAGS}
SELECT {SPLIT} FROM reports WHERE doc_id IN (SELECT doc_id FROM tags WHERE lower(theme) LIKE '%brand#1%')""",
)
def domestic_foreign_split_theme(spark, sf):
    return themes.domestic_foreign_split(t.order_reports(spark, sf), t.order_themes(spark, sf), "brand#1")


@REGISTRY.add(
    "theme_subcats",
    f"""WITH {TAGS}, base AS (SELECT doc_id FROM tags WHERE theme = 'Brand#1'),
total AS (SELECT count(*) AS n FROM base)
SELECT t2.theme, count(DISTINCT t2.doc_id) AS docs,
       round_even(count(DISTINCT t2.doc_id) / any_value(n)::DOUBLE * 100, 1) AS pct
FROM tags t1 JOIN tags t2 ON t1.doc_id = t2.doc_id, total
WHERE t1.theme = 'Brand#1' AND t2.theme <> 'Brand#1' GROUP BY t2.theme ORDER BY docs DESC, t2.theme LIMIT 12""",
)
def theme_subcats(spark, sf):
    return themes.sub_categories(t.order_themes(spark, sf), "Brand#1")


@REGISTRY.add(
    "institutions_min3",
    f"WITH {DOCS} SELECT institution, count(*) AS docs FROM docs WHERE trim(institution) <> '' GROUP BY 1 HAVING count(*) >= 3",
)
def institutions_min3(spark, sf):
    return themes.institutions(t.text_documents(spark, sf))


TIMELINE_COLUMNS = ["eff_date", "fact_id", "entity", "metric", "value_num", "value_text", "unit", "direction",
                    "as_of_date", "institution", "norm_num", "norm_unit"]
TIMELINE_SELECT = """eff_date, fact_id, entity, metric, value_num, value_text, unit, direction, as_of_date, institution,
round(norm_num, 6) AS norm_num, norm_unit"""


def _timeline_sql(entity: str, condition: str) -> str:
    return f"""WITH {facts(entity)}, {REPORTS}, {UNITS}, points AS (
  SELECT f.*, r.institution, r.title, coalesce(report_text, as_of_date) AS eff_date,
         value_num * multiple / 1e8::DOUBLE AS norm_num, CASE WHEN value_num IS NOT NULL THEN norm_unit END AS norm_unit
  FROM facts f JOIN reports r USING (doc_id) LEFT JOIN units USING (unit)
), first AS (
  SELECT * FROM points WHERE {condition} ORDER BY eff_date NULLS LAST, doc_id, fact_id LIMIT 200
)"""


RING = "lower(entity) LIKE '%ring%' AND metric = '目标价' AND eff_date >= '1996-01-01' AND eff_date <= '1999-12-31'"
TSMC = "(entity LIKE '%台积电%' OR lower(entity) LIKE '%tsmc%' OR entity LIKE '%台積電%') AND metric = '目标价'"


def _rounded(points):
    return points.select(*TIMELINE_COLUMNS).withColumn("norm_num", F.round("norm_num", 6))


@REGISTRY.add("metric_timeline", _timeline_sql("p_name", RING) + f" SELECT {TIMELINE_SELECT} FROM first")
def metric_timeline(spark, sf):
    return _rounded(
        metrics.metric_timeline(
            t.line_facts(spark, sf), t.order_reports(spark, sf), "ring", "目标价", "1996-01-01", "1999-12-31"
        )
    )


def _aliased(spark, sf):
    return metrics.metric_timeline(t.brand_facts(spark, sf), t.order_reports(spark, sf), "tsmc", "目标价")


@REGISTRY.add("metric_timeline_alias", _timeline_sql(COMPANY, TSMC) + f" SELECT {TIMELINE_SELECT} FROM first")
def metric_timeline_alias(spark, sf):
    return _rounded(_aliased(spark, sf))


@REGISTRY.add(
    "dominant_unit_series",
    _timeline_sql(COMPANY, TSMC)
    + """, usable AS (
  SELECT *, coalesce(norm_num, value_num) AS y, CASE WHEN norm_num IS NOT NULL THEN norm_unit ELSE coalesce(unit, '') END AS y_unit
  FROM first WHERE eff_date IS NOT NULL AND coalesce(norm_num, value_num) IS NOT NULL
), grouped AS (
  SELECT metric, y_unit, count(*) AS points, min((eff_date, doc_id, fact_id)) AS first_point, min(y) AS y_min, max(y) AS y_max,
         min(eff_date) AS first_date, max(eff_date) AS last_date FROM usable GROUP BY ALL
), main AS (SELECT * FROM (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY metric ORDER BY points DESC, first_point) = 1) WHERE points >= 2)
SELECT u.metric, fact_id, eff_date, u.y_unit AS unit, round(y, 6) AS y,
       round(coalesce(date_diff('day', first_date::DATE, eff_date::DATE) / nullif(date_diff('day', first_date::DATE, last_date::DATE), 0)::DOUBLE, 0), 6) AS x_pos,
       round(coalesce((y - y_min) / nullif(y_max - y_min, 0), 0), 6) AS y_pos
FROM usable u JOIN main m ON m.metric = u.metric AND m.y_unit = u.y_unit""",
)
def dominant_unit_series(spark, sf):
    series = metrics.dominant_unit_series(_aliased(spark, sf), ["metric"])
    return series.select(
        "metric", "fact_id", "eff_date", "unit",
        *[F.round(name, 6).alias(name) for name in ("y", "x_pos", "y_pos")],
    )


@REGISTRY.add(
    "dominant_units",
    f"""WITH {facts('p_name')}, {UNITS}, usable AS (
  SELECT entity, metric, report_text, doc_id, fact_id, coalesce(value_num * multiple / 1e8::DOUBLE, value_num) AS y,
         CASE WHEN value_num * multiple IS NOT NULL THEN norm_unit ELSE coalesce(unit, '') END AS y_unit
  FROM facts LEFT JOIN units USING (unit) WHERE value_num IS NOT NULL
), grouped AS (
  SELECT entity, metric, y_unit, count(*) AS points, min((report_text, doc_id, fact_id)) AS first_point,
         round(min(y), 6) AS y_min, round(max(y), 6) AS y_max FROM usable GROUP BY ALL
)
SELECT * FROM (SELECT entity, metric, y_unit AS unit, points, y_min, y_max FROM grouped
QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY points DESC, first_point) = 1) WHERE points >= 2""",
)
def dominant_units(spark, sf):
    points = metrics.with_normalized_amount(metrics.with_effective_date(t.line_facts(spark, sf)))
    main = metrics.dominant_units(metrics.charted(points), ["entity", "metric"])
    return main.select(
        "entity", "metric", "unit", "points", F.round("y_min", 6).alias("y_min"), F.round("y_max", 6).alias("y_max")
    )


@REGISTRY.add(
    "normalized_amounts",
    f"""WITH {facts('p_name')}, {UNITS}
SELECT metric, unit, CASE WHEN value_num IS NOT NULL THEN norm_unit END AS norm_unit, count(*) AS facts,
       round(sum(value_num * multiple / 1e8::DOUBLE), 4) AS norm_sum
FROM facts LEFT JOIN units USING (unit) GROUP BY ALL""",
)
def normalized_amounts(spark, sf):
    points = metrics.with_normalized_amount(t.line_facts(spark, sf))
    return points.groupBy("metric", "unit", "norm_unit").agg(
        F.count("*").alias("facts"), F.round(F.sum("norm_num"), 4).alias("norm_sum")
    )


@REGISTRY.add(
    "canonical_entities",
    f"""WITH {facts(COMPANY)}
SELECT CASE WHEN lower(trim(entity)) IN ('台积电', 'tsmc', '台積電') THEN '台积电' ELSE entity END AS entity, metric, count(*) AS facts
FROM facts GROUP BY ALL""",
)
def canonical_entities(spark, sf):
    named = t.brand_facts(spark, sf).withColumn("entity", canonical_entity(F.col("entity")))
    return named.groupBy("entity", "metric").agg(F.count("*").alias("facts"))


# A number explains a value within a factor of 100, or within 5 % of a scale word's ratio.
AUDIT = """audited AS (
  SELECT *, list_filter(list_transform(regexp_extract_all(replace(value_text, ',', ''), '-?\\d[\\d,]*\\.?\\d*'),
                                       lambda s: TRY_CAST(s AS DOUBLE)), lambda v: v <> 0) AS nums,
         CASE WHEN value_num IS NULL AND regexp_full_match(replace(trim(value_text), ',', ''), '-?\\d[\\d,]*\\.?\\d*')
              THEN 'fillable' END AS fill,
         (CAST(substr(report_text, 1, 4) AS INTEGER) - CAST(substr(as_of_date, 1, 4) AS INTEGER)) * 12
           + CAST(substr(report_text, 6, 2) AS INTEGER) - CAST(substr(as_of_date, 6, 2) AS INTEGER) AS lag
  FROM facts
), checked AS (
  SELECT *, coalesce(fill, CASE WHEN value_num <> 0 AND len(nums) > 0 AND len(list_filter(nums, lambda v:
      (abs(value_num / v) > 0.01 AND abs(value_num / v) < 100)
      OR len(list_filter([1e-12, 1e-11, 1e-10, 1e-9, 1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1e0, 1e1, 1e2, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8, 1e9, 1e10, 1e11, 1e12]::DOUBLE[],
            lambda b: abs(value_num / v) / b BETWEEN 0.95 AND 1.05)) > 0)) = 0 THEN 'scale_mismatch' END) AS value_status,
         CASE WHEN metric = '目标价' AND lag > 3 THEN metric || ' 的 as_of_date(' || as_of_date || ') 早于报告日(' || report_text || ') '
              || lag || ' 个月（点位报价疑误系历史行情日）' END AS as_of_reason
  FROM audited
)"""


@REGISTRY.add(
    "facts_verify_totals",
    f"""WITH {facts('p_name')}, {AUDIT}
SELECT count(*) AS facts, count(*) FILTER (value_status = 'scale_mismatch') AS scale_mismatch,
       count(*) FILTER (value_status = 'fillable') AS fillable, count(*) FILTER (as_of_reason IS NOT NULL) AS stale_as_of FROM checked""",
)
def facts_verify_totals(spark, sf):
    return quality.audit_totals(quality.audit_facts(t.line_facts(spark, sf)))


@REGISTRY.add(
    "facts_verify_value",
    f"""WITH {facts('p_name')}, {AUDIT}
SELECT fact_id, entity, metric, value_num, value_text, unit, value_status FROM checked WHERE value_status IS NOT NULL""",
)
def facts_verify_value(spark, sf):
    audited = quality.audit_facts(t.line_facts(spark, sf))
    return audited.where(F.col("value_status").isNotNull()).select(
        "fact_id", "entity", "metric", "value_num", "value_text", "unit", "value_status"
    )


@REGISTRY.add(
    "facts_verify_asof",
    f"""WITH {facts('p_name')}, {AUDIT}
SELECT fact_id, entity, as_of_date, report_text AS report_date, as_of_reason FROM checked WHERE as_of_reason IS NOT NULL""",
)
def facts_verify_asof(spark, sf):
    report = F.date_format("report_date", "yyyy-MM-dd")
    checked = t.line_facts(spark, sf).select(
        "fact_id", "entity", "as_of_date", report.alias("report_date"),
        as_of_reason(F.col("as_of_date"), report, F.col("metric")).alias("as_of_reason"),
    )
    return checked.where(F.col("as_of_reason").isNotNull())


@REGISTRY.add(
    "timeline_material",
    _timeline_sql(COMPANY, TSMC)
    + """, numbered AS (
  SELECT *, row_number() OVER (ORDER BY eff_date NULLS LAST, doc_id, fact_id) AS place FROM first
), lined AS (
  SELECT place, concat_ws('　', '[' || place || ']', '出处：' || institution || ' · ' || title, '发布日：' || report_text,
         CASE WHEN as_of_date <> report_text THEN '标注期：' || as_of_date END, '指标：' || metric,
         '值：' || value_text || unit, '方向：' || direction) AS line FROM numbered
), summed AS (SELECT *, sum(length(line)) OVER (ORDER BY place) AS used FROM lined)
SELECT place AS ref, line, CAST(used AS BIGINT) AS used_chars FROM summed WHERE place = 1 OR used <= 24000""",
)
def timeline_material(spark, sf):
    lines = material.timeline_material(_aliased(spark, sf), ["metric"])
    return lines.select(F.col("ref").cast("bigint").alias("ref"), "line", F.col("used_chars").cast("bigint").alias("used_chars"))


@REGISTRY.add(
    "trend_lines",
    f"""WITH {REPORTS}, {TAGS} SELECT bucket, bucket || '：' || docs || ' 篇' AS line FROM (
SELECT {MONTH} AS bucket, count(DISTINCT doc_id) AS docs FROM reports JOIN tags USING (doc_id) WHERE theme LIKE '%ring%' GROUP BY 1)""",
)
def trend_lines(spark, sf):
    heat = themes.theme_heat(t.order_reports(spark, sf), t.order_themes(spark, sf), "ring", "month")
    return material.trend_lines(heat).select("bucket", "line")
