"""Language-model scores against brute force over all segmentations, and awkward tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, token string, n string, marginal string, row string"


@pytest.fixture(scope="module")
def vocabulary():
    return lm.Vocabulary.read(lm.VOCABULARY)


def segmentations(text, pieces):
    """Log probability and pieces of every segmentation, spelled out one by one; a letter that is no piece goes by its bytes."""
    if not text:
        yield 0.0, []
        return
    known = {size: pieces.endings.get(text[:size], (0.0, None)) for size in range(1, len(text) + 1)}
    steps = [(size, log, [piece]) for size, (log, piece) in known.items() if piece is not None]
    if known[1][1] is None:
        some = [pieces.bytes[byte] for byte in text[0].encode()]
        steps.append((1, sum(log for log, _ in some), [piece for _, piece in some]))
    for size, log, ids in steps:
        for rest, more in segmentations(text[size:], pieces):
            yield log + rest, ids + more


WORDS = ["the", "theation", "x", "été", "日本", "a1b2", "▁", "zzzz", "unhappines", "😀s"]


@pytest.mark.parametrize("word", WORDS)
def test_marginal_sums_all_segmentations(vocabulary, word):
    pieces = vocabulary.pieces()
    brute = math.log(sum(math.exp(log) for log, _ in segmentations(lm.START + word, pieces)))
    assert math.isclose(lm.marginal(word, pieces), brute, rel_tol=1e-12)


@pytest.mark.parametrize("word", WORDS)
def test_expected_counts(vocabulary, word):
    pieces, got, want = vocabulary.pieces(), np.zeros(len(vocabulary.weights)), np.zeros(len(vocabulary.weights))
    walk = lm.Walk(pieces, got)
    walk.to(word, 3)
    walk.back_to(0)
    every = list(segmentations(lm.START + word, pieces))
    whole = sum(math.exp(log) for log, _ in every)
    for log, ids in every:
        np.add.at(want, ids, 3 * math.exp(log) / whole)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


def test_walks_share_beginnings(vocabulary):
    pieces = vocabulary.pieces()
    alone, together = np.zeros(len(vocabulary.weights)), np.zeros(len(vocabulary.weights))
    walk, words = lm.Walk(pieces, together), sorted([*WORDS, "thea", "then", "xx", "日", "été"])
    for times, word in enumerate(words):
        assert math.isclose(walk.to(word, times), lm.marginal(word, pieces), rel_tol=1e-12)
        single = lm.Walk(pieces, alone)
        single.to(word, times)
        single.back_to(0)
    walk.back_to(0)
    np.testing.assert_allclose(together, alone, rtol=1e-9, atol=1e-12)


def test_pieces_are_a_distribution(vocabulary):
    expected = np.zeros(len(vocabulary.weights))
    walk = lm.Walk(vocabulary.pieces(), expected)
    walk.to("theation", 50)
    walk.back_to(0)
    for pieces in (vocabulary.pieces(), vocabulary.pieces(expected)):
        logs = [log for log, piece in pieces.endings.values() if piece is not None] + [log for log, _ in pieces.bytes] + [pieces.end]
        assert math.isclose(sum(map(math.exp, logs)), 1.0, rel_tol=1e-9)
    assert lm.marginal("theation", vocabulary.pieces(expected)) > lm.marginal("theation", vocabulary.pieces())


def brute(rows, vocabulary):
    """The contract's fields for every row, with a Counter, and the model by the operator's own word marginals."""
    def tokens(text):
        return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [lm.END]

    def held(doc_id):
        return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0

    counts = Counter(token for doc_id, text, *_ in rows if not held(doc_id) for token in tokens(text))
    expected = np.zeros(len(vocabulary.weights))
    for token, n in counts.items():
        walk = lm.Walk(vocabulary.pieces(), expected)
        walk.to(token, n)
        if token == lm.END:
            expected[vocabulary.end] += n
        else:
            walk.back_to(0)
    pieces, total = vocabulary.pieces(expected), sum(counts.values())
    for doc_id, text, *_ in rows:
        some = tokens(text)
        yield (doc_id, held(doc_id), len(some), sum(counts[token] > 0 for token in some), total,
               sum(math.log10((counts[token] + 0.1) / (total + 0.1 * (len(counts) + 1))) for token in some),
               sum(pieces.end if token == lm.END else lm.marginal(token, pieces) for token in some) / math.log(10))


def compare(frame, want):
    def key(row):
        return (row[0] is None, row[0] or 0, *row[1:])

    got, want = sorted(map(tuple, frame.collect()), key=key), sorted(want, key=key)
    assert [row[:5] for row in got] == [row[:5] for row in want]
    np.testing.assert_allclose([row[5:] for row in got], [row[5:] for row in want], rtol=1e-9)


@pytest.mark.parametrize("head", [0, 5, 1 << 19])
def test_scores_match_brute_force(spark, vocabulary, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "ROWS", 7)
    draw = random.Random(head)
    rows = [(doc, " \t\n".join(draw.choice("the The THEation Été 日本語 x y zz z9 q r".split(" ")) for _ in range(draw.randrange(30))),
             "mine", "mine", None, "x") for doc in range(80)]
    rows += [(None, "the odd one", None, None, None, None), (3, None, None, None, None, None), (4, "", None, None, None, None),
             (5, "word" * 2000, None, None, None, None), (5, "word" * 2000, None, None, None, None), (-9, "once only-here", None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    compare(lm.scored(frame.repartition(5)), list(brute(rows, vocabulary)))


def test_awkward(spark, vocabulary):
    frame = spark.createDataFrame([(None, "only held out", None, None, None, None)], SCHEMA)
    compare(lm.scored(frame), list(brute([(None, "only held out")], vocabulary)))
    assert lm.scored(frame.limit(0)).collect() == []


def test_model_tells_language_from_noise(spark):
    """Most held-out texts of the tables, junk and all, are likelier a character than with the letters of their words shuffled."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 400").select("doc_id", "text").collect()
    draw = random.Random(1)
    rows = [(row.doc_id, row.text) for row in docs]
    held = [row for row in rows if zlib.crc32(str(row[0]).encode()) % 10 == 0]
    noise = [(10_000_000 + at, " ".join("".join(draw.sample(word, len(word))) for word in text.split())) for at, (_, text) in enumerate(held)]
    noise = [(next(i for i in range(doc, doc + 10_000) if zlib.crc32(str(i).encode()) % 10 == 0), text) for doc, text in noise]
    got = {row.doc_id: row.score for row in lm.scored(spark.createDataFrame(rows + noise, "doc_id long, text string")).collect()}
    better = [got[row[0]] / len(row[1]) > got[other[0]] / len(other[1]) for row, other in zip(held, noise, strict=True)]
    assert len(better) > 5 and sum(better) >= 0.75 * len(better)
