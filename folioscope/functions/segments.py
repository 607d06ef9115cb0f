"""Comparable forms of segment names."""

from __future__ import annotations

from itertools import chain
from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed
from .text import all_matches

_WIDE = "".join(chr(code) for code in range(0xFF01, 0xFF5F)) + "\u3000"
_NARROW = "".join(chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)) + " "
PUNCTUATION = "(?U)[\\s\\-_·.,，。:：'\"“”‘’]"
SEPARATOR = "[/／、+＋]|与|及(?!物)|和(?![成弦])"
PARENTHESIS = "[（(]([^）)]*)[）)]"


def normalize_name(name: Column) -> Column:
    folded = F.regexp_replace(F.lower(F.translate(name, _WIDE, _NARROW)), PUNCTUATION, "")
    without_noise = reduce(
        lambda text, word: F.replace(text, F.lit(word), F.lit("")), fixed.SEGMENT_NOISE, folded
    )
    return F.coalesce(F.trim(without_noise), F.lit(""))


def _plain_normalize(name: str) -> str:
    """The same folding for the table's own entries, which are plain ASCII or CJK words."""
    kept = "".join(ch for ch in name.lower() if not ch.isspace() and ch not in "-_·.,，。:：'\"“”‘’")
    return reduce(lambda text, word: text.replace(word, ""), fixed.SEGMENT_NOISE, kept)


def synonym_index() -> dict[str, str]:
    """Folded spelling -> canonical name; a spelling listed twice keeps its last group."""
    return {
        _plain_normalize(spelling): canonical
        for canonical, spellings in fixed.SEGMENT_SYNONYMS.items()
        for spelling in spellings
        if _plain_normalize(spelling)
    }


def _synonym_map() -> Column:
    return F.create_map(*[F.lit(part) for part in chain.from_iterable(synonym_index().items())])


def canonical_name(name: Column) -> Column:
    folded = normalize_name(name)
    return F.coalesce(F.try_element_at(_synonym_map(), folded), folded)


def name_atoms(name: Column) -> Column:
    """Atomic concepts of a compound name, each as its canonical form."""
    inner = F.flatten(
        F.transform(all_matches(name, PARENTHESIS, 1), lambda part: F.split(part, SEPARATOR))
    )
    outer = F.split(F.regexp_replace(name, PARENTHESIS, " "), SEPARATOR)
    folded = F.transform(F.concat(inner, outer), normalize_name)
    synonyms = _synonym_map()
    atoms = F.transform(
        F.filter(folded, lambda atom: F.length(atom) >= 2),
        lambda atom: F.coalesce(F.try_element_at(synonyms, atom), atom),
    )
    return F.coalesce(F.array_distinct(atoms), F.array().cast("array<string>"))
