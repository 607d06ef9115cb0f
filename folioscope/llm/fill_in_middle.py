"""Fill-in-middle transformation: texts cut at line ranks that an indexable skip list turns into code points.

A text of n units (lines with their line break; the last may lack it) becomes prefix, middle and suffix, written with
sentinels as `<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm). The two cuts are ranks
among the n + 1 places between units, drawn from a hash of the seed and doc_id, so reruns and executors agree.

The lowest lane of the list has a link for every unit; a unit's tower decides how many express lanes also stop after it,
one in four per lane. Each link carries its width in units and in code points; an express link's widths are the sums of
the links below it. A cut is found by going down from the highest lane and following every link that does not pass the
rank: the sums of the followed widths are the rank and, exactly, the code points before it. The list of a text is built
and searched inside the row; nothing is shuffled.

Defined results: a null text is empty; empty texts, texts that already hold a sentinel, and texts beyond `rate` are
plain, which is the text as it stands, with null prefix_chars and middle_chars. A null doc_id hashes as the empty string,
so rows without id share their draws. Repeated rows have equal results. Columns of `docs` named as an added column are
replaced, all others stay.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100
SPM_RATE = 50
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Lane(NamedTuple):
    """Links of one lane in order: widths in units and code points, and where the same link starts in the lane below."""

    units: list[int]
    chars: list[int]
    below: list[int]


def tower(unit: int) -> int:
    """Express lanes that stop after this unit (1-based): k or more for one unit in 4 to the k, evenly spread."""
    return (64 - ((unit * _GOLDEN) & _MASK).bit_length()) // 2


def skip_list(widths: list[int]) -> list[Lane]:
    """Lanes from the lowest up, over units of these widths in code points."""
    lanes = [Lane([1] * len(widths), widths, [])]
    starts, heights = list(range(len(widths))), [0, *map(tower, range(1, len(widths)))]
    while True:
        last, height = lanes[-1], len(lanes)
        stops = [link for link, start in enumerate(starts) if start == 0 or heights[start] >= height]
        if len(stops) < 2:
            return lanes
        spans = list(zip(stops, [*stops[1:], len(starts)], strict=True))
        lanes.append(Lane([sum(last.units[a:b]) for a, b in spans], [sum(last.chars[a:b]) for a, b in spans], stops))
        starts = [starts[link] for link in stops]


def chars_before(lanes: list[Lane], rank: int) -> int:
    """Code points of the first `rank` units; at most the number of units."""
    units = chars = link = 0
    for lane in reversed(lanes):
        while link < len(lane.units) and units + lane.units[link] <= rank:
            units, chars, link = units + lane.units[link], chars + lane.chars[link], link + 1
        if units == rank:
            break
        link = lane.below[link]
    return chars


def unit_widths(text: str) -> list[int]:
    """Code points of every unit, in order."""
    parts = text.split("\n")
    return [len(part) + 1 for part in parts[:-1]] + ([len(parts[-1])] if parts[-1] else [])


def draws(seed: int, doc_id: str) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[at:at + 8], 16) for at in range(0, 32, 8))


def moved(text: str, doc_id: str, seed: int, rate: int, spm_rate: int) -> tuple:
    """The fields of `RESULT` for one text."""
    widths = unit_widths(text)
    one, two, form, order = draws(seed, doc_id)
    if not widths or form % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return len(widths), "plain", None, None, text
    lanes, (low, high) = skip_list(widths), sorted((one % (len(widths) + 1), two % (len(widths) + 1)))
    start, stop = chars_before(lanes, low), chars_before(lanes, high)
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    if order % 100 < spm_rate:
        return len(widths), "spm", start, stop - start, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return len(widths), "psm", start, stop - start, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """`docs` (doc_id, text) with n, form, prefix_chars, middle_chars and output; rates are percents."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    @F.arrow_udf(RESULT)
    def cut(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [moved(text.as_py(), doc_id.as_py(), seed, rate, spm_rate) for doc_id, text in zip(ids, texts, strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
            names=["n", "form", "prefix_chars", "middle_chars", "output"])

    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    others = [F.col(f"`{name}`") for name in docs.columns if name.lower() not in added]
    result = cut(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    name = unused(docs, "cut")
    return docs.select(*others, result.alias(name)).select(*others, *[F.col(f"{name}.{field}") for field in added])


def restored(output: Column, form: Column) -> Column:
    """The text before the cut, from an output and its form alone."""
    def mended(first: str, second: str, order: str) -> Column:
        return F.regexp_replace(output, f"(?s)^{first}(.*?){second}(.*?){MIDDLE}(.*)$", order)

    return F.when(form == "psm", mended(PREFIX, SUFFIX, "$1$3$2")).when(
        form == "spm", mended(SUFFIX, PREFIX, "$2$3$1")).otherwise(output)
