"""LIKE the way the query surface defines it: wildcards live, only ASCII letters fold."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .text import all_matches, ascii_lower


def _regex(pattern: str) -> str:
    parts = re.split("([%_])", pattern)
    wild = {"%": ".*", "_": "."}
    return "".join(wild.get(part) or re.sub(r"([^\w\s])", r"\\\1", part, flags=re.ASCII) for part in parts)


def like(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?is)^{_regex(pattern)}$")


def contains_like(text: Column, needle: str) -> Column:
    """text LIKE '%needle%', scanned without the surrounding wildcards."""
    return text.rlike(f"(?is){_regex(needle)}") if needle else text.isNotNull()


def contains_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | contains_like(text, needle)
    return found


# Lengths of the literal pieces that texts and patterns meet on, longest first.
KEY_LENGTHS = (5, 2, 1)


def _match_key(pattern: Column, literal: bool) -> Column:
    """First literal piece of a pattern in the longest listed length it has, else ''."""
    key = F.lit("")
    for length in reversed(KEY_LENGTHS):
        piece = F.regexp_extract(pattern, f"(?s){'.' if literal else '[^%_]'}{{{length}}}", 0)
        key = F.when(piece != "", piece).otherwise(key)
    return key


def _text_keys(text: Column) -> Column:
    """Every key a pattern contained in the text can have: one search over the text for each length."""
    pieces = [all_matches(text, f"(?s)(?=(.{{{length}}}))", 1) for length in KEY_LENGTHS]
    return F.array_distinct(F.concat(F.array(F.lit("")), *pieces))


def substring_join(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Rows of both sides where text LIKE '%pattern%'; `literal` patterns hold no wildcards.

    Both sides meet on a short literal key, so the join is an equi-join that Spark can
    broadcast or split by size; the LIKE itself only checks the rows that met.
    """
    keyed_patterns = patterns.withColumn("_pattern", ascii_lower(F.col(pattern)))
    keyed_patterns = keyed_patterns.where(F.col("_pattern").isNotNull()).withColumn(
        "_key", _match_key(F.col("_pattern"), literal)
    )
    keyed_texts = texts.withColumn("_text", ascii_lower(F.col(text)))
    keyed_texts = keyed_texts.where(F.col("_text").isNotNull()).withColumn(
        "_key", F.explode(_text_keys(F.col("_text")))
    )
    # Every other character is itself; a backslash must not escape the one after it.
    escaped = F.regexp_replace("_pattern", r"\\", r"\\\\")
    met = keyed_texts.join(keyed_patterns, "_key").withColumn("_escaped", F.concat(F.lit("%"), escaped, F.lit("%")))
    # Patterns without wildcards, nearly all of them, need a plain search only.
    plain = F.col("_text").contains(F.col("_pattern"))
    matches = plain if literal else F.when(
        F.col("_pattern").rlike("[%_]"), F.like("_text", F.col("_escaped"))
    ).otherwise(plain)
    return met.where(matches).drop("_key", "_text", "_pattern", "_escaped")
