"""Shared column expressions and table access of the training-data operators.

A word is a maximal run of characters other than space and U+0009 to U+000D. A null text is an empty text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text in order; empty for an empty text."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once for `body`, since lambdas evaluate outer expressions again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slim(frame: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no extra column can clash with a working column."""
    return frame.select(*[F.col(f"`{name}`") for name in names])


def unused(frame: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `frame` has it."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def kept(frame: DataFrame) -> DataFrame:
    """`frame` written once to the folder that all executors share, and read from there."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside, so that long texts fit a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
