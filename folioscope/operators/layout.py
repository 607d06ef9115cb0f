"""Decisions that depend on the size of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Below this much input per core a scan may sit in a few row groups and idle most cores.
SMALL_BYTES_PER_CORE = 64 * 1024 * 1024
# What one task of a spread input gets at most; the estimate counts the chosen columns of compressed files.
SPREAD_BYTES = 4 * 1024 * 1024
# Catalyst takes this size or more for frames it knows nothing about.
NO_ESTIMATE = 2**62
MOST_PIECES = 10_000


def estimated_bytes(frame: DataFrame) -> int:
    """Catalyst's own size estimate; no job runs."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Spreads a small input over all cores ahead of per-row text work.

    Inputs large enough to fill the cluster by their own splits stay where they are. Between the two the number of
    tasks grows with the input, so that a task's rows do not.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(frame)
    if size >= cores * SMALL_BYTES_PER_CORE:
        return frame
    return frame.repartition(max(cores, -(-size // SPREAD_BYTES)), *keys)


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together, in as many tasks as the input has pieces of SPREAD_BYTES: a task's rows do not grow with it.

    A frame without an estimate is left as it is.
    """
    size = estimated_bytes(frame)
    if size >= NO_ESTIMATE:
        return frame
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(min(MOST_PIECES, max(cores, -(-size // SPREAD_BYTES))), *keys)
