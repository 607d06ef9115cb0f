"""Calendar buckets and date checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from . import fixed
from .text import let


def month_bucket(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(fixed.UNKNOWN_BUCKET))


def week_bucket(day: Column) -> Column:
    """Year and Monday-first week number; days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("string")
    label = F.concat(F.date_format(day, "yyyy"), F.lit("-W"), F.lpad(week, 2, "0"))
    return F.coalesce(label, F.lit(fixed.UNKNOWN_BUCKET))


def time_bucket(day: Column, by: str) -> Column:
    return week_bucket(day) if by == "week" else month_bucket(day)


def iso_from_yymmdd(stamp: Column) -> Column:
    """Two-digit years below 69 are 20xx and dates before 2000 are refused."""
    usable = stamp.rlike("^[0-9]{6}$") & (F.substring(stamp, 1, 2).try_cast("int") < 69)
    day = F.try_to_date(F.concat(F.lit("20"), stamp), "yyyyMMdd")
    return F.when(usable, F.date_format(day, "yyyy-MM-dd"))


def date_reason(iso: Column, today: dt.date) -> Column:
    """Why a report date needs review; NULL when it is fine."""
    day = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso.try_cast("date"))
    limit = F.date_add(F.lit(today), fixed.FUTURE_TOLERANCE_DAYS)
    return (
        F.when(iso.isNull() | (iso == ""), fixed.REASON_DATE_MISSING)
        .when(day.isNull(), fixed.REASON_DATE_MALFORMED)
        .when(
            day > limit,
            F.concat(F.lit("report_date 为未来日期（"), iso, F.lit("），疑似文件名年份手误")),
        )
    )


def as_of_reason(as_of: Column, report: Column, metric: Column) -> Column:
    """Quoted prices dated well before their report; NULL when fine or not checked."""

    def months(text: Column) -> Column:
        def counted(found: Column) -> Column:
            return F.when(found != "", F.substring(found, 1, 4).cast("int") * 12 + F.substring(found, 6, 2).cast("int"))

        return let(F.regexp_extract(F.trim(text), r"^\d{4}-\d{1,2}", 0), counted)

    lag = months(report) - months(as_of)
    checked = F.trim(metric).isin(fixed.SPOT_METRICS)
    message = F.concat(
        metric, F.lit(" 的 as_of_date("), as_of, F.lit(") 早于报告日("), report, F.lit(") "),
        lag.cast("string"), F.lit(" 个月（点位报价疑误系历史行情日）"),
    )
    return F.when(checked & (lag > fixed.AS_OF_MAX_MONTHS), message)
