"""Tokens, lines, windows, language and identifiers as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed

# Every character that ends a line, as a regex class body.
LINE_ENDS = "\\n-\\r\\x1c-\\x1e\\x85\\u2028-\\u2029"
_RARE_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
CJK = "一-鿿㐀-䶿"
RAW_TOKEN = f"[\\p{{L}}\\p{{N}}_&&[^{CJK}]]+|[{CJK}]"
INDEX_TOKEN = f"[\\p{{L}}\\p{{N}}&&[^{CJK}]]+|[{CJK}]"
# Latin letters with marks and the letters they decompose to; loose marks go.
_MARKED = [chr(c) for low, high in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(low, high)
           if (plain := unicodedata.normalize("NFD", chr(c)))[0].isascii() and len(plain) > 1]
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)
_LOOSE_MARKS = "".join(map(chr, range(0x300, 0x370)))

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def has_text(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once and hands it to `body`.

    Spark shares no subexpressions around higher-order functions, so a value named twice
    there would be computed twice, and nested uses multiply.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_one_of(text: Column, needles: Iterable[str]) -> Column:
    """Plain byte search, far cheaper than a regex; used to skip work most texts do not need."""
    return reduce(lambda found, needle: found | text.contains(needle), needles, F.lit(False))


def only_newlines(text: Column) -> Column:
    return ~contains_one_of(text, _RARE_LINE_ENDS)


def lines_with_ends(text: Column) -> Column:
    def split(whole: Column) -> Column:
        simple = F.filter(F.split(whole, r"(?<=\n)", -1), lambda line: line != "")
        general = all_matches(whole, f"[^{LINE_ENDS}]*+(?:\\r\\n|[{LINE_ENDS}])|[^{LINE_ENDS}]++")
        return F.when(only_newlines(whole), simple).otherwise(general)

    return let(text, split)


def folded(text: Column) -> Column:
    """Lower case without accents."""
    plain = F.translate(text, "".join(_MARKED) + _LOOSE_MARKS, _PLAIN)
    return F.lower(F.when(text.rlike("[^\\x00-\\x7f]"), plain).otherwise(text))


def raw_tokens(text: Column) -> Column:
    """Word pieces before folding: runs of letters and digits, and single CJK characters."""
    return all_matches(text, RAW_TOKEN)


def index_token_string(text: Column) -> Column:
    """Folded index tokens joined by one blank; empty string when there are none.

    Without CJK characters the tokens are what stands between runs of other characters, so these give way to a blank and
    no list of tokens is made.
    """
    spaced = F.trim(F.regexp_replace(folded(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(text.rlike(f"[{CJK}]"), F.array_join(all_matches(folded(text), INDEX_TOKEN), " ")).otherwise(spaced)


def index_tokens(text: Column) -> Column:
    joined = index_token_string(text)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def query_tokens(text: Column) -> Column:
    """Query side: distinct raw tokens, first occurrence kept."""
    return F.array_distinct(raw_tokens(text))


def estimated_tokens(length: Column) -> Column:
    return F.greatest(F.lit(1), (length / F.lit(fixed.CHARS_PER_TOKEN)).cast("int"))


def windows(text: Column) -> Column:
    """Overlapping character windows of one over-long text."""
    size = int(fixed.TARGET_TOKENS * fixed.CHARS_PER_TOKEN)
    step = size - int(fixed.OVERLAP_TOKENS * fixed.CHARS_PER_TOKEN)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def detect_language(text: Column) -> Column:
    """By the share of CJK characters among the letters of the whole text."""
    cjk = F.length(F.regexp_replace(text, "[^一-鿿]+", ""))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    return (
        F.when(cjk + letters == 0, "und")
        .when(cjk / (cjk + letters) >= fixed.LANG_ZH_SHARE, "zh")
        .otherwise("en")
    )


def is_foreign(lang: Column) -> Column:
    """Anything that does not start with 'en', NULL included, counts as domestic."""
    return F.coalesce(F.lower(lang).startswith("en"), F.lit(False))


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(strip(name), r"(?U)[^\w]+", "-")
    short = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, fixed.SLUG_CHARS)
    return F.when(short == "", "x").otherwise(short)


def embed_key(text: Column, model: str, dim: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\0{dim}\0"), text), 256)


def content_id(digest: Column) -> Column:
    return F.substring(digest, 1, 32)


def redact(secret: Column) -> Column:
    return (
        F.when(secret.isNull() | (secret == ""), "<未设置>")
        .when(F.length(secret) <= 12, "****")
        .otherwise(F.concat(F.substring(secret, 1, 4), F.lit("…"), F.substring(secret, -4, 4)))
    )
