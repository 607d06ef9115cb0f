"""Language-model scores of whole texts: add-constant unigrams over words, and the marginal of a subword lattice.

A text is its words (A to Z lower-cased) and one end. The model gives a word the sum over all its segmentations into
pieces of an existing vocabulary, of the product of the pieces' probabilities; since no piece crosses a word's
border, the log probability of a text is the sum over its words plus that of the end piece. The sum over segmentations is
a forward recursion in log space over the word's lattice. A character that is no piece goes by its byte pieces, so no text
is impossible. Words are walked in order, and the recursion goes on from what a word shares with the one before it.

1. Vocabulary: how often each distinct word stands in the learning texts (0 for words of other texts only), one aggregate
   over all texts. It grows with the corpus and stays a table.
2. Pieces: the vocabulary file gives pieces and scores. Scores are merge ranks, read as Zipf weights; they start the
   recursion and stay as `PRIOR` pseudo-counts. `ROUNDS` rounds of expectation and maximisation run over the whole vocabulary,
   each distinct word once, weighted by its count. What reaches the driver has one number a piece, 32,000 at any size.
3. Each distinct word gets its marginal once.
4. Texts: words of the highest counts, `HEAD` at most, are looked up in a broadcast table; the pairs of text and
   rarer word meet the vocabulary by a shuffle, where no key is hot, since hot words are in the head.

Counts join on the words themselves, so nothing is estimated. Floating sums may differ in the last digits between runs.

Defined results: a null text is empty; an empty text has its end alone (n_tokens 1). A row learns unless the CRC-32 of its
doc_id as text is a multiple of `FOLDS`; a null doc_id hashes as the empty text and so is held out (its CRC-32 is 0). With
nothing to learn from N and V are 0, and the prior alone weights the pieces. Repeated rows count and are scored each. A word is one lattice
however long it is. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, slim, whole_text

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS = 10
HEAD = 1 << 19
ROUNDS = 1
PRIOR = 1000.0
ADDED = 0.1
ROWS = 4000
START = "▁"
END = ""
WORDS = "token string, n long"
LEARNED = "token string, n long, marginal double"
PARTIAL = ("doc_id long, held_out boolean, n_tokens long, n_known long, base double, marginal double, "
           "tail array<struct<token: string, times: int>>")


class Pieces(NamedTuple):
    """Log probability and id by piece and by what ends a piece (0 and None); by byte; pieces of one letter; the end's log."""

    endings: dict[str, tuple[float, int | None]]
    bytes: list[tuple[float, int]]
    letters: frozenset[str]
    end: float


class Vocabulary(NamedTuple):
    """Pieces of a vocabulary file that words can be made of; `weights` sum to 1 and hold what the scores say."""

    names: list[str | None]
    bytes: list[int]
    end: int
    weights: np.ndarray

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        names, weights, at_byte, end = [], np.zeros(count), [0] * 256, model.eos_id()
        for at in range(count):
            piece, rank = model.id_to_piece(at), -model.get_score(at)
            usable = not (model.is_byte(at) or model.is_control(at) or model.is_unknown(at) or START in piece[1:] or piece != piece_lower(piece))
            names.append(piece if usable and rank < count else None)
            if names[-1] is not None:
                weights[at] = 1 / (1 + rank)
            elif model.is_byte(at):
                at_byte[int(piece[3:5], 16)] = at
                weights[at] = 1 / (1 + count)
        weights[end] = 1.0
        return cls(names, at_byte, end, weights / weights.sum())

    def pieces(self, expected: np.ndarray | None = None) -> Pieces:
        """Probabilities after these expected counts, smoothed by the vocabulary's own weights."""
        counts = np.zeros(len(self.weights)) if expected is None else expected
        with np.errstate(divide="ignore"):
            logs = np.log((counts + PRIOR * self.weights) / (counts.sum() + PRIOR)).tolist()
        ids = {name: at for at, name in enumerate(self.names) if name is not None}
        endings: dict[str, tuple[float, int | None]] = {name[start:]: (0.0, None) for name in ids for start in range(1, len(name))}
        endings.update({name: (logs[at], at) for name, at in ids.items()})
        return Pieces(endings, [(logs[at], at) for at in self.bytes], frozenset(name for name in ids if len(name) == 1), logs[self.end])


def piece_lower(text: str) -> str:
    return "".join(letter.lower() if "A" <= letter <= "Z" else letter for letter in text)


def _sum_of_logs(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    most = max(values)
    return most + math.log(sum([math.exp(value - most) for value in values]))


class Walk:
    """The forward recursion over words in order; what a word shares with the one before it is not computed again.

    `forward[j]` is the log of the summed probability of all segmentations of the first j characters. With `counts`, how often
    each piece is expected is added there: a word puts its number of occurrences on its last place, and a place that the
    next word does not share hands its weight back along its edges, each by its share of the sum.
    """

    def __init__(self, pieces: Pieces, counts: np.ndarray | None = None) -> None:
        self.pieces, self.counts, self.text = pieces, counts, ""
        self.forward, self.into, self.weight = [0.0], [[]], [0.0]

    def to(self, word: str, times: int = 0) -> float:
        """Log of the summed probability of all segmentations of `word`."""
        text, same = START + word, 0
        for one, other in zip(self.text, text, strict=False):
            if one != other:
                break
            same += 1
        self.back_to(same)
        endings, forward = self.pieces.endings, self.forward
        for stop in range(same + 1, len(text) + 1):
            edges, logs = [], []
            for start in range(stop - 1, -1, -1):
                part = text[start:stop]
                if (known := endings.get(part)) is None:
                    break
                log, piece = known
                if piece is not None:
                    edges.append((start, log, piece))
                    logs.append(forward[start] + log)
            if (unknown := text[stop - 1]) not in self.pieces.letters:
                log = sum([self.pieces.bytes[byte][0] for byte in unknown.encode()])
                edges.append((stop - 1, log, unknown))
                logs.append(forward[stop - 1] + log)
            forward.append(_sum_of_logs(logs))
            if self.counts is not None:
                self.into.append(edges)
                self.weight.append(0.0)
        self.text = text
        self.weight[-1] += times
        return forward[-1]

    def back_to(self, place: int) -> None:
        """Leaves all places beyond the first `place` characters."""
        if self.counts is None:
            del self.forward[place + 1:]
            return
        while len(self.forward) > place + 1:
            here, weight = self.forward.pop(), self.weight.pop()
            for start, log, piece in self.into.pop():
                share = weight * math.exp(self.forward[start] + log - here)
                self.weight[start] += share
                if isinstance(piece, int):
                    self.counts[piece] += share
                else:
                    for byte in piece.encode():
                        self.counts[self.pieces.bytes[byte][1]] += share


def marginal(word: str, pieces: Pieces) -> float:
    return Walk(pieces).to(word)


def _expected(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size, end = shared.value
        counts = np.zeros(size)
        walk = Walk(pieces, counts)
        for batch in batches:
            for word, times in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if word == END:
                    counts[end] += times
                else:
                    walk.to(word, times)
        walk.back_to(0)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["piece", "expected"])

    return run


def learned_pieces(words: DataFrame, vocabulary: Vocabulary) -> Pieces:
    """Probabilities of pieces after `ROUNDS` rounds over all words (token, n)."""
    pieces, context = vocabulary.pieces(), words.sparkSession.sparkContext
    for _ in range(ROUNDS):
        shared = context.broadcast((pieces, len(vocabulary.weights), vocabulary.end))
        summed = words.where("n > 0").mapInArrow(_expected(shared), "piece long, expected double").groupBy("piece").agg(
            F.sum("expected").alias("expected")).toArrow()
        expected = np.zeros(len(vocabulary.weights))
        expected[summed["piece"].to_numpy()] = summed["expected"].to_numpy()
        pieces = vocabulary.pieces(expected)
    return pieces


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts in order, and the row of each."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), "[ \\t-\\r]+")
    rows, flat = pc.list_parent_indices(parts), pc.list_flatten(parts)
    real = pc.not_equal(flat, "")
    return rows.filter(real).to_numpy(), flat.filter(real)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of some rows and how often they stand in learning texts; END once for each such text."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            learns = part.column("learns").to_numpy(zero_copy_only=False)
            rows, words = _tokens(part.column("text"))
            coded = words.dictionary_encode()
            counts = np.bincount(coded.indices.to_numpy(), weights=learns[rows], minlength=len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([coded.dictionary, pa.array([END])]), pa.array(np.append(counts, int(learns.sum())))], names=["token", "n"])


def _with_marginals(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(shared.value)
        for batch in batches:
            logs = [walk.to(word) for word in batch.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(logs, pa.float64())], names=["token", "n", "marginal"])

    return run


def _looked_up(head):
    """mapInArrow function: sums over the words of each text that are in the head, and its other words with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, logs = head.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield _partial(batch.slice(start, ROWS), known, n, logs)

    return run


def _partial(part: pa.RecordBatch, known: pa.Array, n: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
    size = part.num_rows
    rows, words = _tokens(part.column("text"))
    coded = words.dictionary_encode()
    codes, places = coded.indices.to_numpy(), pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy()
    at = places[codes] if len(codes) else np.zeros(0, dtype=np.int32)
    inside, found = at >= 0, at[at >= 0]

    def summed(values: np.ndarray) -> np.ndarray:
        return np.bincount(rows[inside], weights=values, minlength=size).astype(float)

    pairs, times = np.unique(rows[~inside].astype(np.int64) * max(len(places), 1) + codes[~inside], return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(size + 1, dtype=np.int64) * max(len(places), 1)).astype(np.int32)
    tail = pa.StructArray.from_arrays(
        [coded.dictionary.take(pa.array(pairs % max(len(places), 1))), pa.array(times.astype(np.int32))], names=["token", "times"])
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(~part.column("learns").to_numpy(zero_copy_only=False)),
         pa.array(np.bincount(rows, minlength=size).astype(np.int64)), pa.array(summed(np.ones(len(found))).astype(np.int64)),
         pa.array(summed(np.log10(n[found] + ADDED))), pa.array(summed(logs[found])), pa.ListArray.from_arrays(pa.array(offsets), tail)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "base", "marginal", "tail"])


def _grade(n: Column) -> Column:
    """Counts in quarters of an octave, from 0 for one occurrence."""
    return F.when(n > 0, F.floor(4 * F.log2(n))).otherwise(F.lit(-1))


def _head(words: DataFrame) -> int:
    """The least grade from which on the words are at most `HEAD`."""
    total, least = 0, 1 << 20
    counts = words.groupBy(_grade(F.col("n")).alias("grade")).agg(F.count("*").alias("words")).where("grade >= 0").collect()
    for grade, count in sorted(counts, reverse=True):
        total += count
        if total > HEAD:
            break
        least = grade
    return least


def scored(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row of `docs`."""
    spark = docs.sparkSession
    learns = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != 0
    texts = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), learns.alias("learns"))
    words = kept(texts.select("text", "learns").mapInArrow(_counted, WORDS).groupBy("token").agg(F.sum("n").alias("n")).sortWithinPartitions("token"))
    total, distinct, ends = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.max(F.when(F.col("token") == END, F.col("n"))), F.lit(0))).first()
    pieces = learned_pieces(words, Vocabulary.read(path))
    learned = kept(words.where(F.col("token") != END).mapInArrow(_with_marginals(spark.sparkContext.broadcast(pieces)), LEARNED))
    least = _head(learned)
    # At most HEAD rows, whatever the corpus.
    head = learned.where(_grade(F.col("n")) >= least).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast((
        pa.concat_arrays(head["token"].chunks) if head.num_rows else pa.array([], pa.string()), head["n"].to_numpy(), head["marginal"].to_numpy()))
    partial = kept(texts.mapInArrow(_looked_up(shared), PARTIAL).withColumn("row", F.monotonically_increasing_id()))
    rare = partial.select("row", F.explode("tail").alias("word")).select("row", "word.token", "word.times").join(
        learned.where(_grade(F.col("n")) < least), "token").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + ADDED)).alias("more_base"), F.sum(F.col("times") * F.col("marginal")).alias("more_marginal"))
    one, nothing = F.col("n_tokens") + 1, F.lit(0.0)
    scale = math.log10(total + ADDED * (distinct + 1))
    end = math.log10(ends + ADDED)
    return partial.drop("tail").join(rare, "row", "left").select(
        "doc_id", "held_out", one.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", nothing) + end - one * scale).alias("base_score"),
        ((F.col("marginal") + F.coalesce("more_marginal", nothing) + pieces.end) / math.log(10)).alias("score"))
