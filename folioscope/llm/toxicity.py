"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Clues. In a sample of labelled training rows, the documents of either label that hold a word, or a word's first four
   letters, are counted in hash buckets; buckets found mostly in toxic rows become clues.
2. Voters, each firing or not on a document: two fixed lexicons, clue words, clue stems, several clues, and patterns
   (shouting, runs of exclamation marks, masked words, direct address).
3. Label model. All documents are counted by vote pattern (at most 2^voters rows). EM estimates how often each voter fires
   on toxic and on clean documents; voters that still move together within a class are correlated and get a joint table.
   Labelled training rows keep their label throughout. The result is a posterior for each pattern.
4. Classifier. Logistic regression on clues, lexicon words and their number, fitted to the posteriors of a sample of documents.

`LABELLED_ROWS` and `FITTED_ROWS` bound the two samples (by a hash threshold, so in expectation); everything else reads all
rows. Labels come only from rows whose crc32(doc_id as text) mod 4 is not 2; held-out rows are not fitted either. Scores
read the text alone.

Defined results: null and empty texts have no clues and get the score of such a document. A null doc_id is not held out
and has no label. A doc_id with contradicting labels is toxic. Repeated rows are scored each. Without labels only the
lexicons and patterns count, with `PRIOR` as the share of toxic documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slim, whole_text

LABELLED_ROWS = 50_000
FITTED_ROWS = 20_000
HALF = 1 << 17
STEM = 4
LEAST_TOXIC = 6
LEAST_SHARE = 0.65
REFUTED = 0.3
PRIOR = 0.05
CUT = 0.3
HELD_OUT = 2

# Fixed values.
LEXICON_NOUNS = (
    "idiot idiots moron morons loser losers scum clown clowns trash garbage imbecile imbeciles bastard bastards bitch asshole "
    "dumbass jackass vermin filth cretin dimwit creep pig whore slut retard scumbag").split()
LEXICON_ADJECTIVES = (
    "stupid pathetic worthless disgusting dumb idiotic moronic ugly useless vile repulsive despicable filthy brainless "
    "hateful fucking fuck shit damn crap sucks").split()
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\w[*#@$%]{2,}")
_ADDRESS = re.compile(r"\byou(?:'re| are| re)?\s+(?:are\s+)?(?:an?|such|all|so|just)\b|\byour\s+kind\b", re.I)

VOTERS = ("nouns", "adjectives", "clue words", "clue stems", "several clues", "shouting", "exclamation", "masked", "address")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def buckets_of(text: str) -> tuple[set[str], set[int]]:
    """Distinct words, and the buckets of words (below `HALF`) and of first letters (from `HALF` on)."""
    words = set(_WORD.findall(text.lower()))
    found = {zlib.crc32(word.encode()) % HALF for word in words}
    found.update(HALF + zlib.crc32(stem.encode()) % HALF for stem in {word[:STEM] for word in words if len(word) > STEM})
    return words, found


@dataclass
class Signs:
    """Clue buckets, and the lexicon words that labels do not refute, with the place of each as a feature."""

    clues: dict[int, int]
    lexicon: dict[str, int]

    @property
    def width(self) -> int:
        return len(self.clues) + len(self.lexicon)


@dataclass
class Model:
    """Signs, the posterior of each vote pattern, and the weights of the signs, of their number, and the bias."""

    signs: Signs
    posterior: np.ndarray
    weights: np.ndarray


def votes_of(text: str, signs: Signs) -> int:
    words, found = buckets_of(text)
    hits = [bucket for bucket in found if bucket in signs.clues]
    listed = {word for word in words if word in signs.lexicon}
    nouns, adjectives = bool(listed & _NOUNS), bool(listed & _ADJECTIVES)
    upper = len(_UPPER.findall(text))
    fired = (
        nouns, adjectives, any(bucket < HALF for bucket in hits), any(bucket >= HALF for bucket in hits),
        len(hits) + nouns + adjectives > 1, bool(text) and upper > 0.4 * len(text), "!!" in text,
        bool(_MASKED.search(text)), bool(_ADDRESS.search(text)))
    return sum(1 << place for place, on in enumerate(fired) if on)


_NOUNS, _ADJECTIVES = frozenset(LEXICON_NOUNS), frozenset(LEXICON_ADJECTIVES)


def features_of(text: str, signs: Signs) -> tuple[list[int], float]:
    """Places of the features present, and the number of distinct signs as a log."""
    words, found = buckets_of(text)
    places = [signs.clues[bucket] for bucket in found if bucket in signs.clues]
    places += [signs.lexicon[word] for word in words if word in signs.lexicon]
    return places, float(np.log1p(len(places)))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 2 * HALF), dtype=np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic, list(buckets_of(text)[1])] += 1
    cells = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(cells), pa.array(counts[0, cells]), pa.array(counts[1, cells])], names=["bucket", "clean", "toxic"])


def _below(key: Column, seed: int, share: float) -> Column:
    """A deterministic sample of about `share` of the rows."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(share, 1.0) * (1 << 30)))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of about `LABELLED_ROWS` training rows at most."""
    rows = slim(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    once = rows.groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return once.where(_below(F.col("label_id"), 11, LABELLED_ROWS / max(once.count(), 1)))


def find_signs(docs: DataFrame, labels: DataFrame) -> Signs:
    """Buckets that lie mostly in toxic rows, by the lower end of the share's confidence interval; lexicon words not refuted."""
    # The sample of labels has a stated bound, so it is broadcast.
    known = docs.join(F.broadcast(labels), F.col("doc_id") == F.col("label_id")).select(whole_text().alias("text"), "toxic")
    counts = known.mapInArrow(_class_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n, z = F.col("toxic") + F.col("clean"), 1.96
    share = F.col("toxic") / n
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    fixed = {zlib.crc32(word.encode()) % HALF: word for word in LEXICON_NOUNS + LEXICON_ADJECTIVES}
    judged = counts.withColumn("low", low).withColumn("fixed", F.col("bucket").isin(list(fixed)))
    # Bounded by the lexicon, and by the number of buckets (2 * `HALF`).
    refuted = {fixed[row["bucket"]] for row in judged.where(F.col("fixed") & (n >= LEAST_TOXIC) & (share < REFUTED)).select("bucket").collect()}
    strong = judged.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("low") >= LEAST_SHARE)).orderBy(
        F.col("low").desc(), F.col("toxic").desc(), "bucket").select("bucket").collect()
    clues = {row["bucket"]: place for place, row in enumerate(strong)}
    words = [word for word in LEXICON_NOUNS + LEXICON_ADJECTIVES if word not in refuted]
    return Signs(clues, {word: len(clues) + place for place, word in enumerate(words)})


def _cells(patterns: np.ndarray, clique: list[int]) -> np.ndarray:
    return sum(((patterns >> voter) & 1) << place for place, voter in enumerate(clique))


def _tables(patterns, weights, cliques):
    """P(votes of a clique | class) for both classes, smoothed."""
    tables = []
    for clique in cliques:
        cells = _cells(patterns, clique)
        table = np.stack([np.bincount(cells, weights=w, minlength=1 << len(clique)) + 0.1 for w in weights])
        tables.append(table / table.sum(axis=1, keepdims=True))
    return tables


def label_model(counts: dict[tuple[int, int], int], prior: float, rounds: int = 40) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Posterior of each vote pattern, the cliques of correlated voters, and each voter's firing rate on clean and toxic.

    `counts` has the number of documents by (pattern, label); label -1 is unknown.
    """
    size = 1 << len(VOTERS)
    by_label = {label: np.zeros(size) for label in (-1, 0, 1)}
    for (pattern, label), n in counts.items():
        by_label[label][pattern] += n
    patterns = np.arange(size)
    votes = (patterns[:, None] >> np.arange(len(VOTERS))) & 1
    cliques = [[voter] for voter in range(len(VOTERS))]
    labelled = by_label[0] + by_label[1]
    # The lexicons and clues start as signs of toxicity; labelled rows correct them.
    signs = votes[:, :5].sum(axis=1)
    posterior = np.where(labelled > 20, (by_label[1] + 0.5) / (labelled + 1), np.where(signs > 0, 0.9, prior / 2))

    def weights() -> tuple[np.ndarray, np.ndarray]:
        return by_label[-1] * (1 - posterior) + by_label[0], by_label[-1] * posterior + by_label[1]

    def fit() -> None:
        nonlocal posterior
        for _ in range(rounds):
            tables = _tables(patterns, weights(), cliques)
            logs = np.log([1 - prior, prior])[:, None] + sum(
                np.log(table[:, _cells(patterns, clique)]) for table, clique in zip(tables, cliques, strict=True))
            posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))

    fit()
    together = []
    for mass in weights():
        if mass.sum() < 50:
            continue
        rates = (votes * mass[:, None]).sum(axis=0) / mass.sum()
        spread = votes - rates
        moved = (spread * mass[:, None]).T @ spread / mass.sum()
        scale = np.sqrt(np.maximum(rates * (1 - rates), 1e-4))
        linked = np.abs(moved / np.outer(scale, scale))
        together += [(linked[i, j], i, j) for i in range(len(VOTERS)) for j in range(i) if linked[i, j] > 0.25]
    for _, i, j in sorted(together, reverse=True):
        left, right = (next(c for c in cliques if v in c) for v in (i, j))
        if left is not right and len(left) + len(right) <= 4:
            cliques.remove(right)
            left.extend(right)
    fit()
    rates = np.stack([(votes * mass[:, None]).sum(axis=0) / max(mass.sum(), 1) for mass in weights()])
    return posterior, cliques, rates


def fit_classifier(rows: list[tuple[list[int], float, float]], width: int, prior: float, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Logistic regression by Newton steps on soft labels: weights of `width` features, of the number of signs, and the bias.

    Features are held as the places that are present, and each step is solved by conjugate gradients, so that memory grows
    with the signs found in the rows and not with `width`.
    """
    w = np.zeros(width + 2)
    w[-1] = np.log(prior / (1 - prior))
    if not rows:
        w[width] = 3.0
        return w
    n = len(rows)
    sizes = [len(features) for features, _, _ in rows]
    row_at = np.repeat(np.arange(n), sizes)
    place_at = np.fromiter((place for features, _, _ in rows for place in features), dtype=np.int64, count=sum(sizes))
    number = np.array([row[1] for row in rows])
    y = np.array([row[2] for row in rows])

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row_at, weights=v[place_at], minlength=n) + number * v[width] + v[-1]

    def summed(u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(place_at, weights=u[row_at], minlength=width), [number @ u, u.sum()])

    keep = np.full(width + 2, ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        slope = summed(y - p) - keep * w
        spread = p * (1 - p)
        scale = np.append(np.bincount(place_at, weights=spread[row_at], minlength=width), [number * number @ spread, spread.sum()]) + keep
        step, left = np.zeros(width + 2), slope
        along = eased = left / scale
        for _ in range(200):
            if np.abs(left).max() < 1e-9:
                break
            bent = summed(spread * times(along)) + keep * along
            share = (left @ eased) / (along @ bent)
            step, rest = step + share * along, left - share * bent
            next_eased = rest / scale
            along = next_eased + (rest @ next_eased) / (left @ eased) * along
            left, eased = rest, next_eased
        w = w + step
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of `docs` (doc_id, text) and `labels` (doc_id, toxic)."""
    docs = slim(docs, "doc_id", "text")
    known = training_labels(labels)
    signs = find_signs(docs, known)

    def vote(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda text: votes_of(text, signs)).astype("int32")

    pattern = F.pandas_udf(vote, "int")(whole_text())
    marked = docs.join(F.broadcast(known), F.col("doc_id") == F.col("label_id"), "left")
    counts = marked.select(pattern.alias("pattern"), F.coalesce("toxic", F.lit(-1)).alias("label"), F.lit(1).alias("one")).groupBy(
        "pattern", "label").agg(F.sum("one").alias("n")).collect()  # at most 3 * 2^voters rows
    table = {(row["pattern"], row["label"]): row["n"] for row in counts}
    of_label = {label: sum(n for (_, known_), n in table.items() if known_ == label) for label in (0, 1)}
    prior = min(max((of_label[1] + 1) / (sum(of_label.values()) + 1 / PRIOR), 0.005), 0.5)
    posterior, _, _ = label_model(table, prior)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [features_of(text, signs) for text in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array([places for places, _ in found], pa.list_(pa.int32())), pa.array([number for _, number in found], pa.float64()),
                pa.array([float(posterior[votes_of(text, signs)]) for text in texts], pa.float64())], names=["places", "number", "label"])

    total = sum(table.values())
    fitted = docs.where(~held_out(F.col("doc_id"))).where(_below(F.coalesce("doc_id", F.lit(0)), 12, FITTED_ROWS / max(total, 1)))
    rows = fitted.select(whole_text().alias("text")).mapInArrow(sample, "places array<int>, number double, label double").collect()
    weights = fit_classifier([(row["places"], row["number"], row["label"]) for row in rows], signs.width, prior)
    return Model(signs, posterior, weights)


def score_of(text: str, model: Model) -> float:
    places, number = features_of(text, model.signs)
    logit = model.weights[-1] + model.weights[-2] * number + model.weights[places].sum()
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score`; a column of that name is replaced."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda text: score_of(text, model)).astype("float64")

    return docs.withColumn("score", F.pandas_udf(score, "double")(whole_text()))
