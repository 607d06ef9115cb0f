"""Report metadata read from file names and archive paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import all_matches, let, strip

STOCK_CODE = r"[（(](\d{6})[)）]"
PAGE_COUNT = r"-(\d+)页"


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), "[^/]*$", 0)


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]+$", "")


def url_decoded(text: Column) -> Column:
    """Decode %XX escapes only; a text with a stray percent sign stays as it is."""
    guarded = F.replace(text, F.lit("+"), F.lit("%2B"))
    protected = F.regexp_replace(guarded, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(protected), text)).otherwise(text)


def parsed_name(file_name: Column) -> Column:
    """STRUCT(institution, title, yymmdd, stock_code, page_count, reason)."""

    def dated(name: Column) -> Column:
        # The greedy first group makes it the last date anchor.
        work = F.regexp_replace(name, r"-\d+页$", "")
        return let(work, lambda text: _parts(name, text, all_matches(text, r"^.*-(?=\d{6}(?:-|$))", 0)))

    return let(url_decoded(stem(file_name)), dated)


def _parts(name: Column, work: Column, anchors: Column) -> Column:
    """The parts of a decoded name; `anchors` holds the text up to the dash before its last date, if any."""

    def cut(anchor: Column) -> Column:
        behind = F.substring(work, F.length(anchor) + 1, F.length(work))
        after = F.regexp_replace(F.substring(behind, F.lit(7), F.length(behind)), "^-+|-+$", "")
        return F.struct(
            F.substring(anchor, F.lit(1), F.length(anchor) - 1).alias("before"), F.substring(behind, 1, 6).alias("stamp"),
            after.alias("after"))

    def named(split: Column) -> Column:
        trailing = split["stamp"].isNotNull() & (split["after"] != "") & ~split["after"].contains("页") & (
            F.length(split["after"]) <= fixed.MAX_INSTITUTION_CHARS)
        head = F.coalesce(split["before"], name)
        first = F.substring_index(head, "-", 1)
        rest = F.when(head.contains("-"), F.substring(head, F.length(first) + 2, F.length(head))).otherwise("")
        institution = F.when(F.coalesce(trailing, F.lit(False)), split["after"]).when(rest == "", "").otherwise(first)
        title = F.when(F.coalesce(trailing, F.lit(False)), split["before"]).when(rest == "", first).otherwise(rest)
        return F.struct(
            strip(institution).alias("institution"), F.regexp_replace(title, "^[ _-]+|[ _-]+$", "").alias("title"),
            split["stamp"].alias("stamp"))

    def finished(parts: Column) -> Column:
        institution = parts["institution"]
        cjk = F.length(F.regexp_replace(institution, "[^一-鿿]", ""))
        suspect = (institution != "") & ((cjk > fixed.MAX_INSTITUTION_CHARS) | institution.rlike("[：（）:]"))
        reason = F.when(institution == "", fixed.REASON_INSTITUTION_MISSING).when(suspect, fixed.REASON_INSTITUTION_SUSPECT)
        code = F.regexp_extract(name, STOCK_CODE, 1)
        return F.struct(
            F.when(institution == "", fixed.UNKNOWN_INSTITUTION).otherwise(institution).alias("institution"),
            F.when(parts["title"] == "", name).otherwise(parts["title"]).alias("title"),
            parts["stamp"].alias("yymmdd"), F.when(code != "", code).alias("stock_code"),
            F.regexp_extract(name, PAGE_COUNT, 1).try_cast("int").alias("page_count"), reason.alias("reason"))

    anchor = F.try_element_at(anchors, F.lit(1))
    return let(let(let(anchor, cut), named), finished)


def category_from_path(path: Column) -> Column:
    category = F.lit(None).cast("string")
    for keyword in reversed(fixed.CATEGORY_KEYWORDS):
        category = F.when(path.contains(keyword), keyword).otherwise(category)
    return category


def _first_part(path: Column, pattern: str) -> Column:
    parts = F.filter(F.split(path, r"[\\/]"), lambda part: part.rlike(pattern))
    return F.try_element_at(parts, F.lit(1))


def week_from_path(path: Column) -> Column:
    return _first_part(path, "^第[一二三四五六七八九十]+周$")


def month_from_path(path: Column) -> Column:
    return _first_part(path, r"^\d{4}年\d{1,2}月$")
