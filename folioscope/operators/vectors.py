"""Exact nearest neighbours by Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from .search import blocks_of, keep_best

# Query vectors held by one scan: 1,024 vectors of 4,096 dimensions are 32 MB.
QUERY_BLOCK = 1024
_TOP_SCHEMA = "query_id string, chunk_id string, distance double"


def l2_distance(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left.cast("array<double>"), right.cast("array<double>"), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap))


def unpack_floats(blob: Column) -> Column:
    """ARRAY<FLOAT> out of little-endian float32 bytes."""

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda raw: None if raw is None else np.frombuffer(raw, dtype="<f4"))

    return unpack(blob)


def nearest(vectors: DataFrame, query: Sequence[float], limit: int = fixed.ROUTE_TOPK) -> DataFrame:
    """One query vector: each task keeps its own top rows, then one merge."""
    target = F.array(*[F.lit(float(value)) for value in query])
    scored = vectors.select("chunk_id", F.round(l2_distance(F.col("embedding"), target), 6).alias("distance"))
    top = scored.orderBy("distance", "chunk_id").limit(limit)
    rank = F.row_number().over(Window.orderBy("distance", "chunk_id")) - 1
    return top.withColumn("rank", rank.cast("int"))


def _block_scan(vectors: DataFrame, block: pd.DataFrame, limit: int) -> DataFrame:
    ids = block["query_id"].to_numpy()
    matrix = np.vstack(block["embedding"].to_numpy()).astype("float64")
    squares = (matrix**2).sum(axis=1)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, squares))

    def local_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, queries, query_squares = shared.value
        best = None
        for batch in batches:
            if batch.empty:
                continue
            rows = np.vstack(batch["embedding"].to_numpy()).astype("float64")
            squared = (rows**2).sum(axis=1)[:, None] + query_squares[None, :] - 2.0 * rows @ queries.T
            distances = np.round(np.sqrt(np.maximum(squared, 0.0)), 6)
            # Rows that tie with the last place stay, so that ids can settle it.
            last = min(limit, len(distances)) - 1
            edge = np.partition(distances, last, axis=0)[last]
            hit_row, hit_query = np.nonzero(distances <= edge[None, :])
            found = pd.DataFrame(
                {"query": hit_query, "chunk_id": batch["chunk_id"].to_numpy()[hit_row],
                 "value": distances[hit_row, hit_query]}
            )
            best = keep_best(found if best is None else pd.concat([best, found]), limit, descending=False)
        if best is not None:
            yield pd.DataFrame(
                {"query_id": [query_ids[code] for code in best["query"]], "chunk_id": best["chunk_id"].to_numpy(),
                 "distance": best["value"].to_numpy()}
            )

    return vectors.select("chunk_id", "embedding").mapInPandas(local_top, _TOP_SCHEMA)


def dense_search(vectors: DataFrame, queries: DataFrame, limit: int = fixed.ROUTE_TOPK) -> DataFrame:
    """Top rows for every query vector of (query_id, embedding).

    The vectors are scanned in place against a block of queries and each task returns
    only its own top rows, so the shuffle holds tasks x queries x limit rows. Query
    sets beyond one block are split by hash into blocks of bounded size, one scan each.
    """
    slim = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    typed = vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding")
    scans = []
    for part in blocks_of(slim, "query_id", slim.count(), QUERY_BLOCK):
        block = part.toPandas()
        if len(block):
            scans.append(_block_scan(typed, block, limit))
    spark = vectors.sparkSession
    merged = reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], _TOP_SCHEMA)
    window = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return (
        merged.withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= limit)
        .withColumn("rank", (F.col("rank") - 1).cast("int"))
    )
