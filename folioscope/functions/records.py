"""Tolerant JSON and service-response helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructType

from . import fixed
from .text import all_matches


def parse_loose_json(text: Column, schema: StructType | str) -> Column:
    """Object read directly, from a fenced block, or from the outermost braces."""
    options = {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"}
    trimmed = F.trim(text)
    fenced = F.regexp_extract(trimmed, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(trimmed, r"(?s)\{.*\}", 0)

    def usable(candidate: Column) -> Column:
        return F.when(F.get_json_object(candidate, "$").isNotNull(), F.from_json(candidate, schema, options))

    return F.coalesce(usable(trimmed), usable(fenced), usable(braces))


def result_items(response: Column, item_schema: StructType | str) -> Column:
    """Item array out of any envelope: data.extract_result, data.results, data, or a bare list."""
    item = item_schema if isinstance(item_schema, str) else item_schema.simpleString()

    def parsed(path: str) -> Column:
        found = F.get_json_object(response, path)
        return F.when(found.startswith("["), F.from_json(found, f"array<{item}>"))

    def filled(items: Column) -> Column:
        return F.when(F.size(items) > 0, items)

    return F.coalesce(
        filled(parsed("$.data.extract_result")), filled(parsed("$.data.results")), parsed("$.data"),
        filled(parsed("$.extract_result")), parsed("$.results"), parsed("$"),
        F.from_json(F.lit("[]"), f"array<{item}>"),
    )


def response_class(code: Column) -> Column:
    """ok / fatal / daily_limit / retryable / error; a response without a code is ok."""
    text = code.cast("string")
    return (
        F.when(text.isNull() | text.isin(fixed.OK_CODES), "ok")
        .when(text.isin(fixed.FATAL_CODES), "fatal")
        .when(text.isin(fixed.DAILY_LIMIT_CODES), "daily_limit")
        .when(text.isin(fixed.RETRYABLE_CODES), "retryable")
        .otherwise("error")
    )


def retry_delay(attempt: Column, base: Column, maximum: Column, server_delay: Column) -> Column:
    """Delay before jitter: the server's wish or exponential, kept within base and maximum."""
    wanted = F.coalesce(server_delay, base * F.pow(F.lit(2.0), attempt))
    return F.least(maximum, F.greatest(base, wanted))


def sub_query_lines(answer: Column, original: Column, limit: int | None = None) -> Column:
    """Original question plus one sub-query per answer line, distinct; at most `limit` of them where it is given."""
    cleaned = F.transform(
        F.split(answer, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"),
        lambda line: F.regexp_replace(line, "^[ \\-·•\t\u3000]+|[ \\-·•\t\u3000]+$", ""),
    )
    wanted = F.filter(F.concat(F.array(original), cleaned), lambda line: line != "")
    distinct = F.array_distinct(wanted)
    return distinct if limit is None else F.slice(distinct, 1, limit)


def markdown_images(text: Column) -> Column:
    return all_matches(text, r"!\[[^\]]*\]\((images/[^)]+)\)", 1)
