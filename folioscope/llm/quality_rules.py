"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text, beside plain text counts.

Words and word pairs (the last word pairs with the end) of every document fall into `BUCKETS` hash buckets. Two multinomials over the buckets are counted
over all rows: the raw corpus, and its rows with a trusted label. A document's score is the mean over its n-grams of
log(trusted share / raw share), so its length cancels out. `SMOOTHING` is added to the trusted count and to the count
expected from the raw share, which draws the ratio of rare buckets towards 1. It is kept at `threshold` or more, always by the same cut.

Defined results: a null or empty text has no words, counts of 0, score 0 and fails the base rules. Without any trusted
row both multinomials agree and every score is 0, which passes. Repeated rows are counted and judged each. A repeated or
contradicting label counts as trusted once any of its rows is. A null doc_id has no label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, slim, whole_text, words_of

BUCKETS = 1 << 16
THRESHOLD = -0.2
SMOOTHING = 10.0
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def joined(hashes: Column, reach: int) -> Column:
    """Each run's hash joined with that of the run `reach` items further on; the last `reach` stand alone."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(1 + reach), F.size(hashes)), lambda left, right: F.xxhash64(left, right))


def repeated_words(pairs: Column) -> Column:
    """Words that lie in a window of `WINDOW` words found twice or more in the text, from the hashes of its pairs."""
    width = WINDOW

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda key, at: F.struct(key.alias("key"), at.alias("at"))))
        starts = let(placed, lambda rows: F.array_sort(F.transform(
            F.filter(rows, lambda row, i: (
                (F.get(rows, i - 1)["key"] == row["key"]) | F.coalesce(F.get(rows, i + 1)["key"] == row["key"], F.lit(False)))),
            lambda row: row["at"])))
        return F.aggregate(
            starts, F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total")),
            lambda seen, at: F.struct(at.alias("last"), (seen["total"] + F.least(F.lit(width), at - seen["last"])).alias("total")),
            lambda seen: seen["total"])

    runs = let(joined(pairs, 2), lambda fours: joined(fours, 4))
    windows = F.slice(runs, F.lit(1), F.greatest(F.size(pairs) - F.lit(width - 1), F.lit(0)))
    return let(windows, lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys)))


def _counts(raw: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket with its raw and its trusted count, over all documents."""
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    # Merged at every size: the labels grow with the corpus.
    marked = slim(raw, "doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = marked.select(
        F.explode(let(word_hashes(words_of(whole_text())), lambda words: F.concat(words, joined(words, 1)))).alias("hash"),
        F.col("trusted_id").isNotNull().cast("long").alias("trusted"))
    return grams.select(F.pmod("hash", F.lit(buckets)).cast("int").alias("bucket"), "trusted").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted"))


def bucket_weights(raw: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: `weights`, the log ratio of each bucket in order. Its size is `buckets`, whatever the corpus."""
    counts = _counts(raw, trusted, buckets)
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("trusted", F.lit(0)).alias("trusted"))
    gathered = full.agg(
        F.sum("raw").alias("raw_total"), F.sum("trusted").alias("trusted_total"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("cells"))

    def ratio(cell: Column) -> Column:
        expected = cell["raw"] * (F.col("trusted_total") / F.col("raw_total"))
        return F.log((cell["trusted"] + F.lit(SMOOTHING)) / (expected + F.lit(SMOOTHING)))

    weights = F.transform("cells", lambda cell: F.when(F.col("trusted_total") == 0, F.lit(0.0)).otherwise(ratio(cell)))
    return gathered.select(weights.alias("weights"))


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """`docs` with a struct column `quality`: the base counts, `score`, `base_failed` and `kept`; replaces one of that name.

    `trusted` holds the doc_id of trusted rows.
    """
    # Named once, so that the projection below takes the scalar in itself and no row carries the array.
    weighted = docs.withColumn("__weights", bucket_weights(docs, trusted, buckets).scalar())
    weights = F.col("__weights")

    def score(words: Column, pairs: Column) -> Column:
        def add(total: Column, gram: Column) -> Column:
            return total + F.get(weights, F.pmod(gram, F.lit(buckets)).cast("int"))

        total = F.aggregate(pairs, F.aggregate(words, F.lit(0.0), add), add)
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(total / (2 * F.size(words)))

    def verdict(words: Column) -> Column:
        lines = F.filter(F.split(whole_text(), "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole_text(), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda rows: F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            let(word_hashes(words), lambda singles: let(joined(singles, 1), lambda pairs: F.struct(
                repeated_words(pairs).cast("long").alias("n_repeat_words"),
                score(singles, pairs).alias("score")))).alias("hashed"))

    def decided(counts: Column) -> Column:
        repeats, mean = counts["hashed"]["n_repeat_words"], counts["hashed"]["score"]
        failed = (counts["n_words"] < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * counts["n_words"])
        return F.struct(
            *[counts[name].alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
            repeats.alias("n_repeat_words"), mean.alias("score"),
            failed.alias("base_failed"), (~failed & (mean >= F.lit(threshold))).alias("kept"))

    return weighted.withColumn("quality", let(let(words_of(whole_text()), verdict), decided)).drop("__weights")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return slim(labels, "doc_id", "quality").where("quality = 1").select("doc_id")


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs`."""
    packed = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), "doc_id", "text")
    return judged(packed, trusted).where("quality.kept").select("row.*")
