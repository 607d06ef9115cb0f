"""Markdown cleaning and conservative spelling repair, inside the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import (
    LINE_ENDS, all_matches, contains_one_of, has_text, let, lines_with_ends, only_newlines,
)

_GAP = r"[\h\x1f]"
_DAILY = r"(?U)^\s*#\s+(?:\*\*)?每日报告(?:\*\*)?\s*$"
_START = rf"##{_GAP}+(?:\*\*)?(?i:START{_GAP}*YOUR{_GAP}*FINANCE)(?:\*\*)?"
_START_TO_END = rf"(?s)(?<![^{LINE_ENDS}]){_GAP}*+{_START}{_GAP}*(?:[{LINE_ENDS}].*)?$"
_START_HINT = rf"##{_GAP}+(?:\*\*)?(?i:START)"
_IMAGE_LINE = r"(?iU)^\s*!?\[[^\]]*\]\(images/[^)]+\)\s*$"
_CAPTION_LINE = r"(?iU)^\s*(Exhibit|Figure|Table|图|表)\s*\d"
_BULLET = r"(?U)^n\s+(?=\S)"
_PROMO_LINE = "(?U)^\\s*(?:" + "|".join(fixed.PROMO_LINE_PATTERNS) + ")$"
_PROMO_HINTS = ["每日报告", "起点财经", "每日微信群内分享"]
_INDENTED_OR_BLANK = r"(?U)\n\s"
_MISSPELT = (
    rf"(?iU)\b(?=[{''.join(sorted({word[0] for word in fixed.LIGATURE_FIXES}))}])(?:" + "|".join(fixed.LIGATURE_FIXES) + r")\b")
_ANY_BULLET = rf"(?U)n(?<=(?<![^{LINE_ENDS}])n)\s+\S"


def _content(line: Column) -> Column:
    return F.regexp_replace(line, "[\r\n]+$", "")


def _with_end(content: Column, line: Column) -> Column:
    return F.concat(content, F.when(line.endswith("\n"), "\n").otherwise(""))


def _without_promo(line: Column) -> Column:
    def judged(content: Column) -> Column:
        stripped = reduce(
            lambda text, phrase: F.replace(text, F.lit(phrase), F.lit("")), fixed.PROMO_PHRASES, content
        )
        kept = let(stripped, lambda text: F.when(text.rlike(_PROMO_LINE), "").otherwise(text))
        return F.when(content.rlike(_DAILY), "").otherwise(kept)

    return let(
        _content(line),
        lambda content: F.when(contains_one_of(content, _PROMO_HINTS + ["扫一扫"]), judged(content)).otherwise(content),
    )


def _line_roles(lines: Column) -> Column:
    """One letter per line: s(hare notice), d(aily heading), i(mage), x = image to drop, o(ther).

    A share notice condemns the next image unless a daily heading comes first.
    """
    notices = [phrase for phrase in fixed.PROMO_PHRASES if fixed.COPYRIGHT_MARK in phrase]

    def role(line: Column) -> Column:
        notice = reduce(lambda seen, phrase: seen | line.contains(phrase), notices, F.lit(False))
        return (
            F.when(line.rlike(_DAILY), "d").when(notice, "s").when(line.rlike(_IMAGE_LINE), "i").otherwise("o")
        )

    letters = F.array_join(F.transform(lines, role), "")
    return F.split(F.regexp_replace(letters, "(so*+)i", "$1x"), "")


def _before_start_block(text: Column) -> Column:
    return F.when(text.rlike(_START_HINT), F.regexp_replace(text, _START_TO_END, "")).otherwise(text)


def clean_markdown(text: Column) -> Column:
    """Text without promotional blocks and blank lines; ends at the start-block heading."""
    def kept_line(line: Column, role: Column) -> Column:
        content = let(
            _without_promo(line), lambda text: F.when(has_text(text), _with_end(text, line)).otherwise("")
        )
        return F.when(role == "x", "").otherwise(content)

    lines = lines_with_ends(_before_start_block(text))
    plain = F.transform(F.filter(lines, has_text), lambda line: _with_end(_content(line), line))
    cleaned = let(lines, lambda all_lines: F.zip_with(all_lines, _line_roles(all_lines), kept_line))
    promoted = contains_one_of(text, _PROMO_HINTS)
    untouched = ~promoted & ~text.rlike(_START_HINT) & only_newlines(text) & (
        ~F.concat(F.lit("\n"), text).rlike(_INDENTED_OR_BLANK)
    )
    return F.when(untouched, text).otherwise(F.array_join(F.when(promoted, cleaned).otherwise(plain), ""))


def clean_change_count(text: Column) -> Column:
    """Lines whose content changed, every non-empty line after the start block included."""
    def count(body: Column) -> Column:
        changed = let(
            lines_with_ends(body),
            lambda lines: F.zip_with(
                lines,
                _line_roles(lines),
                lambda line, role: ((role == "x") | (_without_promo(line) != _content(line))).cast("int"),
            ),
        )
        tail = lines_with_ends(F.substring(text, F.length(body) + 1, F.length(text)))
        dropped = F.size(F.filter(tail, lambda line: _content(line) != ""))
        return F.aggregate(changed, F.lit(0), lambda total, one: total + one) + dropped

    return let(_before_start_block(text), count)


def _respelt(line: Column) -> Column:
    """Whole-word repairs that keep only the first letter's case."""
    repairs = F.create_map(*[F.lit(part) for pair in fixed.LIGATURE_FIXES.items() for part in pair])
    rest = F.split(line, _MISSPELT, -1)
    words = F.transform(
        all_matches(line, _MISSPELT),
        lambda word: F.concat(
            F.substring(word, 1, 1), F.substring(repairs[F.lower(word)], 2, 99)
        ),
    )
    return F.array_join(
        F.flatten(F.zip_with(rest, words, lambda text, word: F.array(text, F.coalesce(word, F.lit(""))))), ""
    )


def _repaired(line: Column) -> Column:
    kept = line.rlike(_IMAGE_LINE) | line.rlike(_CAPTION_LINE)
    respelt = let(
        F.regexp_replace(line, _BULLET, "- "),
        lambda bulleted: F.when(bulleted.rlike(_MISSPELT), _respelt(bulleted)).otherwise(bulleted),
    )
    return F.when(kept, line).otherwise(respelt)


def repair_lines(cleaned: Column) -> Column:
    """Bullets and spelling put right line by line; images and captions stay untouched."""
    needs = cleaned.rlike(_MISSPELT) | cleaned.rlike(_ANY_BULLET)
    repaired = F.array_join(F.transform(lines_with_ends(cleaned), _repaired), "")
    return F.when(needs, repaired).otherwise(cleaned)


def normalize_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """Clean, then repair; two projections, so the cleaned text is computed once."""
    return documents.withColumn(text, clean_markdown(F.col(text))).withColumn(text, repair_lines(F.col(text)))


def repair_change_count(cleaned: Column) -> Column:
    """Spelling repairs plus one for every changed line."""

    def changes(line: Column) -> Column:
        kept = line.rlike(_IMAGE_LINE) | line.rlike(_CAPTION_LINE)
        words = F.regexp_count(line, F.lit(_MISSPELT))
        return F.when(kept, 0).otherwise(words + (_repaired(line) != line).cast("int"))

    counted = F.transform(lines_with_ends(cleaned), changes)
    return F.aggregate(counted, F.lit(0), lambda total, one: total + one)
