"""Amount units, value checks and entity spellings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import let


def _unit_case(unit: Column, value_of) -> Column:
    trimmed = F.trim(unit)
    chosen = F.lit(None)
    for canonical, units in fixed.AMOUNT_UNITS.items():
        for name, multiple in units.items():
            chosen = F.when(trimmed == name, F.lit(value_of(canonical, multiple))).otherwise(chosen)
    return chosen


def canonical_unit(unit: Column) -> Column:
    return _unit_case(unit, lambda canonical, _: canonical).cast("string")


def canonical_amount(value: Column, unit: Column) -> Column:
    """Amount in hundreds of millions of its currency; NULL where units do not compare."""
    multiple = _unit_case(unit, lambda _, multiple: float(multiple)).cast("double")
    return value * multiple / F.lit(fixed.AMOUNT_BASE)


def first_number(text: Column) -> Column:
    digits = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+\.?\d*", 0)
    return digits.try_cast("double")


def _scale_bases() -> list[float]:
    bases: set[float] = set()
    for multiple in fixed.SCALE_WORDS.values():
        bases |= {multiple, 1 / multiple, multiple / fixed.AMOUNT_BASE, fixed.AMOUNT_BASE / multiple}
    return sorted(bases)


def value_status(value_text: Column, value: Column) -> Column:
    """'fillable', 'scale_mismatch' or NULL.

    A value agrees with its text when any number in the text is the same within 5 %,
    directly or through a scale word, or lies within a factor of one hundred.
    """
    plain = F.replace(F.trim(value_text), F.lit(","), F.lit(""))
    fillable = value.isNull() & plain.rlike(r"^-?\d[\d,]*\.?\d*$")
    numbers = F.filter(
        F.transform(
            F.regexp_extract_all(
                F.replace(value_text, F.lit(","), F.lit("")), F.lit(r"-?\d[\d,]*\.?\d*"), F.lit(0)
            ),
            lambda token: token.try_cast("double"),
        ),
        lambda number: number.isNotNull() & (number != 0),
    )
    bases = F.array(*[F.lit(base) for base in _scale_bases()])

    def agrees(number: Column) -> Column:
        ratio = F.abs(value / number)
        near = (ratio > 0.01) & (ratio < 100)
        return near | F.exists(bases, lambda base: (ratio / base).between(0.95, 1.05))

    unexplained = let(numbers, lambda found: (F.size(found) > 0) & ~F.exists(found, agrees))
    suspicious = value.isNotNull() & (value != 0) & unexplained
    return F.when(fillable, "fillable").when(suspicious, "scale_mismatch")


def canonical_entity(name: Column) -> Column:
    folded = F.lower(F.trim(name))
    chosen = name
    for canonical, spellings in fixed.ENTITY_ALIASES.items():
        chosen = F.when(
            folded.isin(sorted({spelling.lower() for spelling in spellings})), F.lit(canonical)
        ).otherwise(chosen)
    return chosen


def entity_spellings(name: str) -> list[str]:
    """Every known spelling of the entity a caller asks for, itself included."""
    wanted = name.strip().lower()
    for spellings in fixed.ENTITY_ALIASES.values():
        if wanted in {spelling.lower() for spelling in spellings}:
            return spellings
    return [name]
