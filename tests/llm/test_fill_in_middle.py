"""Fill-in-middle cuts against plain slicing, exact round trips, and awkward tables."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import fill_in_middle as fim

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
TEXT = st.text(st.sampled_from("ab \n\r é😀<P>SM"), max_size=60)


def plain_cut(text, doc_id, seed=7, rate=100, spm=50):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(-(1 << 63), (1 << 63) - 1), st.integers(0, 100), st.integers(0, 100))
def test_cuts_match_slicing(text, doc_id, rate, spm):
    assert fim.moved(text, str(doc_id), 7, rate, spm) == plain_cut(text, doc_id, 7, rate, spm)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=400))
def test_every_rank_is_reached(widths):
    lanes, total = fim.skip_list(widths), 0
    for rank, width in enumerate([*widths, 0]):
        assert fim.chars_before(lanes, rank) == total
        total += width
    for lane in lanes:
        assert (sum(lane.units), sum(lane.chars)) == (len(widths), sum(widths))


def test_express_lanes_are_sparse():
    lanes = fim.skip_list([1] * 4096)
    assert [len(lane.units) for lane in lanes[:4]] == sorted((len(lane.units) for lane in lanes[:4]), reverse=True)
    assert 700 < len(lanes[1].units) < 1350 and len(lanes) > 4


def test_round_trip_and_awkward_rows(spark):
    long = "\n".join("word " * (k % 7) for k in range(30_000))
    texts = [None, "", "\n", "one line", "a\nb\nc\n", "has <S> inside\nx\n", long, "a\nb\nc\n", "é😀\n\r\nz", "x\n" * 9 + "y"]
    rows = [(i if i % 4 else None, text, "mine", "mine") for i, text in enumerate(texts)] + [(4, "a\nb\nc\n", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut string, Output string")
    got = fim.transformed(docs.withColumn("form", F.lit("mine"))).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert got.columns == ["doc_id", "text", "cut", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    found = got.collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.back == (row.text or "")
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == plain_cut(
            row.text or "", "" if row.doc_id is None else row.doc_id)
    assert fim.transformed(docs.limit(0)).collect() == []
