"""Mixing sources to target weights by repeating documents.

Words are summed for each source; targets share all words by weight, stop at `MAX_REPEATS` times the source's words, and
what is above goes to the other sources by weight until none is above. A source's rate is target / words. Each document
is taken floor(rate) times, plus one hash-seeded Bernoulli copy with the fraction as its probability. The draws of one
source are systematic: documents stand in order of size, and document k takes the copy when floor((k + 1) f + u) exceeds
floor(k f + u), u being a hash of seed and source. Each document's probability is exactly f, and since neighbours have
like sizes, the words taken stay within about one document of the target, where free draws would stray by several percent.

Places in that order come from counts of (source, size, salt), summed in three steps, so no task holds a source.

Defined results: a null or empty text has size 0 and may be repeated like any other; a null source is a source, last in
order; a source without words has target 0, rate 0. Repeated rows are mixed each. A null doc_id stands first among its
size. An empty table stays empty. Extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, whole_text, words_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SALTS = 16
BANDS_PER_OCTAVE = 8
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size and target of each source; `sizes` has source and size of each document.

    Sources that stop at their cap come first by cap / weight. The level, words per weight, is that of the first source
    which stays under its cap when all before it have stopped.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).select(
        "source", "source_size", F.lit(max_repeats).cast("long").alias("times"),
        F.element_at(F.lit(list(weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).alias("weight"), "rank"
    ).withColumn("cap", F.col("source_size") * F.col("times"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = ranked.select(
        "*", F.row_number().over(by_cap).alias("place"),
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("level"))
    under = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("place"))
    chosen = levels.select(
        "*", F.min(under).over(everything).alias("first"),
        F.min_by("level", under).over(everything).alias("final_level"))
    return chosen.select(
        "source", "source_size",
        F.when(F.col("place") < F.coalesce("first", F.lit(1 << 30)), F.col("cap").cast("double"))
        .otherwise(F.col("final_level") * F.col("weight")).alias("target"))


def _seeded(source: Column, seed: str) -> Column:
    """A number of [0, 1) from seed and source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")), F.when(source.isNull(), F.lit("?")).otherwise(F.lit("."))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _starts(rows: DataFrame) -> DataFrame:
    """For each (source, size, salt) the number of documents of the source that stand before it."""
    keys = ["source", "size", "salt"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    band = F.floor(F.log2(F.col("size") + 1) * BANDS_PER_OCTAVE).alias("band")
    per_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n")).select("*", band)
    per_band = per_size.groupBy("source", "band").agg(F.sum("n").alias("n"))

    def running(frame: DataFrame, within: list[str], order: str, name: str) -> DataFrame:
        upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return frame.withColumn(name, F.sum("n").over(upto) - F.col("n"))

    salts = running(counts, ["source", "size"], "salt", "in_size")
    sizes = running(per_size, ["source", "band"], "size", "in_band")
    bands = running(per_band, ["source"], "band", "in_source").drop("n")
    of_size = sizes.alias("s").join(
        bands.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.band") == F.col("b.band"))
    ).select("s.source", "s.size", (F.col("in_band") + F.col("in_source")).alias("before"))
    return salts.alias("c").join(
        of_size.alias("o"), F.col("c.source").eqNullSafe(F.col("o.source")) & (F.col("c.size") == F.col("o.size"))
    ).select("c.source", "c.size", "c.salt", (F.col("before") + F.col("in_size")).alias("before"))


def copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """`rows` (doc_id, source, size, and a struct `row` if any) with source_size, target and the number of `copies`."""
    salted = rows.withColumn("salt", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALTS)).cast("int"))
    counted = kept(salted.select("doc_id", "source", "size", "salt"))  # sizes are read several times, texts once
    if set(rows.columns) == {"doc_id", "source", "size"}:
        salted = counted
    in_group = Window.partitionBy("source", "size", "salt").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    placed = salted.withColumn("in_group", F.row_number().over(in_group) - 1)
    known = placed.alias("p").join(
        _starts(counted).alias("q"),
        F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.size") == F.col("q.size")) & (F.col("p.salt") == F.col("q.salt"))
    ).select("p.*", "q.before")
    rated = known.alias("k").join(
        targets(counted, weights).alias("t"), F.col("k.source").eqNullSafe(F.col("t.source"))
    ).select("k.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    place = (F.col("before") + F.col("in_group")).cast("double")
    part, shift = F.col("rate") - F.floor("rate"), _seeded(F.col("source"), seed)
    drawn = F.floor((place + 1) * part + shift) - F.floor(place * part + shift)
    return rated.withColumn("rate", rate).withColumn("copies", (F.floor("rate") + drawn).cast("int")).drop("salt", "in_group", "before")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words_of(whole_text())).cast("long").alias("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """Every row of `docs` as often as the mix takes it, with the columns of `docs`."""
    packed = docs.select(
        "doc_id", "source", F.size(words_of(whole_text())).cast("long").alias("size"),
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    counted = copies(packed, weights, seed).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
