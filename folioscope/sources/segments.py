"""A positional index kept in numbered segments; readers merge them.

A segment holds the postings, term counts and document counts of some documents, and the ids of the documents that it
replaces in earlier segments. `gone` is written last and makes a segment visible, so readers never see half of one. An
update writes one segment and rewrites none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.inverted import BUCKETS, Index, positional_postings
from ..session import shuffles_dropped

# A document whose id stands before the first mark of the chunk's id is not written out; others are, as a list of one.
POSTINGS = "term string, chunk_id string, doc_id array<string>, chunk_len int, tf int, positions array<int>, following array<string>, bucket int"
TERMS = "term string, df long, bucket int"
DOCUMENTS = "doc_id string, n_chunks long, total_len long"
# Files of a bucket at least, so that a term of most chunks is not one task's; more where a file would hold more tokens than
# this: a part of the chunks then has about 3.2 million tokens at most, whose postings are sorted in memory.
SPREAD = 4
FILE_TOKENS = 400_000
# A part that a core of its own would be worth.
CORE_TOKENS = 250_000


def _chunk_document() -> Column:
    return F.substring_index("chunk_id", "#", 1)


def _numbers(spark: SparkSession, root: str, whole: bool = True) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("segment-") and (not whole or files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "gone/_SUCCESS"))):
            found.append(int(name.rpartition("-")[2]))
    return sorted(found)


def write_segment(chunks: DataFrame, root: str, replaced: DataFrame | None = None) -> None:
    """Adds the chunks (chunk_id, doc_id, tokens, chunk_len) as one segment; `replaced` (doc_id) leave earlier segments."""
    spark = chunks.sparkSession
    folder = f"{root}/segment-{max(_numbers(spark, root, whole=False), default=-1) + 1}"
    tokens = chunks.agg(F.coalesce(F.sum("chunk_len"), F.lit(0)).alias("tokens")).first().tokens
    cores = min(spark.sparkContext.defaultParallelism, -(-tokens // CORE_TOKENS))
    files = max(SPREAD, cores, -(-tokens // (BUCKETS * FILE_TOKENS)))
    slim = chunks.select("chunk_id", "doc_id", "tokens", "chunk_len")
    # Chunks that lie in fewer pieces are dealt out before postings are made of them, as tokens are far smaller. Postings come
    # sorted by term, block by block, so that parts sort them by folder alone.
    made = positional_postings(slim, files if slim.rdd.getNumPartitions() < files else None)
    written = made.withColumn("doc_id", F.when(F.col("doc_id").eqNullSafe(_chunk_document()), None).otherwise(F.array("doc_id")))
    with shuffles_dropped(spark):
        written.sortWithinPartitions("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
        stored = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
        counts = stored.groupBy("bucket", "term").agg(F.count("*").alias("df")).select("term", "df", "bucket")
        counts.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{folder}/terms")
        chunks.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(
            F.count("*").alias("n_chunks"), F.sum("chunk_len").cast("long").alias("total_len")).write.parquet(f"{folder}/documents")
    gone = spark.createDataFrame([], "doc_id string") if replaced is None else replaced.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    gone.write.parquet(f"{folder}/gone")


def read_index(spark: SparkSession, root: str) -> Index | None:
    """All segments as one index, without the documents that later segments replace."""
    numbers = _numbers(spark, root)
    if not numbers:
        return None

    def parts(name: str, schema: str) -> list[DataFrame]:
        return [spark.read.schema(schema).parquet(f"{root}/segment-{number}/{name}") for number in numbers]

    document = F.when(F.col("doc_id").isNull(), _chunk_document()).otherwise(F.get("doc_id", F.lit(0)))
    postings = [part.withColumn("doc_id", document) for part in parts("postings", POSTINGS)]
    terms, documents = parts("terms", TERMS), parts("documents", DOCUMENTS)
    if len(numbers) == 1:
        return Index(postings[0], terms[0], documents[0])
    gone = reduce(DataFrame.unionByName, [
        part.withColumn("until", F.lit(at)) for at, part in enumerate(parts("gone", "doc_id string"))]).groupBy("doc_id").agg(F.max("until").alias("until"))

    def standing(frames: list[DataFrame], how: str) -> DataFrame:
        joined = reduce(DataFrame.unionByName, [frame.withColumn("segment", F.lit(at)) for at, frame in enumerate(frames)])
        later = gone.select(F.col("doc_id").alias("gone_id"), "until")
        return joined.join(later, (F.col("doc_id") == F.col("gone_id")) & (F.col("segment") < F.col("until")), how).drop("segment")

    lost = standing(postings, "left_semi").groupBy("bucket", "term").agg((-F.count("*")).alias("df")).select("term", "df", "bucket")
    df = reduce(DataFrame.unionByName, [*terms, lost]).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
    return Index(standing(postings, "left_anti"), df, standing(documents, "left_anti"))

