"""Line dedup by content-defined chunks, and by whole repeated runs of lines.

A text's lines are hashed; a rolling hash over the last `ROLL` line hashes ends a chunk, once it has two lines, so that
boundaries depend on nearby content alone and find themselves again after inserted or deleted lines. A line of
`LONG_WORDS` words or more is a chunk of its own: it stands for the several lines it would be wrapped to. Chunks of two
lines or more, or of a long line, that occur again anywhere are compared byte by byte with their first occurrence, by
doc_id and place, and removed where equal. The first occurrence stays.

A chunk at the edge of a passage holds foreign lines, so chunks alone keep much of short passages. With `run_words`, every
run of lines of that many words that occurs before, not overlapping it, is removed too, up to its first and last line.
Such runs are the unions of their smallest windows: from each line on, and up to each line, the fewest lines of
`run_words` words. Windows are counted as chunks are, by 128-bit digests of their bytes; equal digests count as equal.

Only digests are counted over the corpus. A table of `CELLS` bits, filled by repeated digests, tells the second reading
which chunks may be repeated, so only their bytes move; a full table lets more through and changes no result.

Defined results: null texts stay null, empty texts empty; both have one line or none and nothing to remove. A text whose
chunks all go becomes empty. Rows with the same doc_id and text count as one document and are treated alike; rows without
doc_id come first in order. Lines end at \\n only and are compared exactly. Columns named as those added are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, kept, whole_text

ROLL = 2
MEAN_LINES = 3
LONG_WORDS = 30
RUN_WORDS = 50
CELLS = 1 << 20
BATCH_ROWS = 2000


def chunks(text: str) -> list[tuple[int, int, bool]]:
    """(first line, lines, whether it may be removed) of each chunk, in order."""
    found, start, recent = [], 0, [0] * ROLL
    lines = text.split("\n")

    def close(upto: int) -> None:
        nonlocal start
        if upto > start:
            found.append((start, upto - start, upto - start > 1))
        start = upto

    for at, line in enumerate(lines):
        recent = [*recent[1:], zlib.crc32(line.encode())]
        if len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS:
            close(at)
            found.append((at, 1, True))
            start = at + 1
            continue
        rolled = 0
        for value in recent:
            rolled = (rolled * 0x9E3779B1 + value) & 0xFFFFFFFF
        if at - start >= 1 and (rolled >> 8) % MEAN_LINES == 0:
            close(at + 1)
    close(len(lines))
    return found


def windows(text: str, run_words: int) -> list[tuple[int, int]]:
    """(first line, lines) of the smallest runs of `run_words` words from each line on and up to each line, in order."""
    before = [0]
    for line in text.split("\n"):
        before.append(before[-1] + len(line.split()))
    found = set()
    low = 0
    for at in range(1, len(before)):  # the fewest lines up to each line
        while before[at] - before[low + 1] >= run_words:
            low += 1
        if before[at] - before[low] >= run_words:
            found.add((low, at - low))
    high = 0
    for at in range(len(before) - 1):  # the fewest lines from each line on
        while high < len(before) - 1 and before[high] - before[at] < run_words:
            high += 1
        if before[high] - before[at] >= run_words:
            found.add((at, high - at))
    return sorted(found)


def _window_rows(cells, run_words: int):
    """mapInArrow function: windows with their digests, all of them or those in marked cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = cells.value if cells is not None else None
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10).tolist()
                starts, ends = [0, *[end + 1 for end in ends]], [*ends, len(data)]
                for start, n in windows(text, run_words):
                    one, two = _digest(data[starts[start]:ends[start + n - 1]])
                    if marked is None or marked[one % CELLS]:
                        rows.append((doc_id, key, start, n, one, two))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(*column) for column in zip(columns, kinds, strict=True)], names=["doc_id", "row_key", "start", "n", "one", "two"])

    return run


def run_removals(docs: DataFrame, run_words: int) -> DataFrame:
    """doc_id, row_key, start and n of every window that occurs before without overlapping it; `docs` as for `removals`."""
    spark = docs.sparkSession
    place = F.struct("doc_id", "row_key", "start")
    digests = docs.select("doc_id", "row_key", "text").mapInArrow(_window_rows(None, run_words), _SLIM)
    repeated = kept(digests.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"))
    cells = np.zeros(CELLS, dtype=bool)
    # At most `CELLS` numbers.
    cells[repeated.select(F.pmod("one", F.lit(CELLS)).alias("cell")).distinct().toArrow()["cell"].to_numpy()] = True
    shared = spark.sparkContext.broadcast(cells)
    found = docs.select("doc_id", "row_key", "text").mapInArrow(_window_rows(shared, run_words), _SLIM)
    same_row = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.row_key") == F.col("row_key"))
    later = ~same_row | (F.col("start") >= F.col("first.start") + F.col("n"))
    return found.join(repeated.select("one", "two", "first"), ["one", "two"]).where(later).select("doc_id", "row_key", "start", "n").distinct()


def _digest(data: bytes) -> tuple[int, int]:
    whole = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def _chunk_rows(cells, with_bytes: bool):
    """mapInArrow function: removable chunks with their digests, all of them or those in marked cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = cells.value if cells is not None else None
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = text.split("\n")
                for start, n, removable in chunks(text):
                    if not removable:
                        continue
                    data = "\n".join(lines[start:start + n]).encode()
                    one, two = _digest(data)
                    if marked is None or marked[one % CELLS]:
                        rows.append((doc_id, key, start, n, one, two, data if with_bytes else None))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "row_key", "start", "n", "one", "two", "data")
            width = 7 if with_bytes else 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[i], kinds[i]) for i in range(width)], names=list(names[:width]))

    return run


_SLIM = "doc_id long, row_key long, start int, n int, one long, two long"


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, start and n of every chunk that repeats an earlier one; `docs` has doc_id, row_key and text."""
    spark = docs.sparkSession
    digests = docs.select("doc_id", "row_key", "text").mapInArrow(_chunk_rows(None, False), _SLIM)
    place = F.struct("doc_id", "row_key", "start")
    repeated = kept(digests.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"))
    cells = np.zeros(CELLS, dtype=bool)
    # At most `CELLS` numbers.
    marked = repeated.select(F.pmod("one", F.lit(CELLS)).alias("cell")).distinct().toArrow()["cell"].to_numpy()
    cells[marked] = True
    shared = spark.sparkContext.broadcast(cells)
    parts = docs.select("doc_id", "row_key", "text").mapInArrow(_chunk_rows(shared, True), _SLIM + ", data binary")
    known = kept(parts.join(repeated.select("one", "two", "first"), ["one", "two"]))
    is_first = F.col("first").eqNullSafe(place)
    firsts = known.where(is_first).select("one", "two", F.col("data").alias("first_data"))
    return known.where(~is_first).join(firsts, ["one", "two"]).where("data = first_data").select(
        "doc_id", "row_key", "start", "n").distinct()


def deduped(docs: DataFrame, run_words: int | None = None) -> DataFrame:
    """`docs` with repeated chunks, and runs of `run_words` words, taken out of `text`, and n_lines and n_removed_lines."""
    spark = docs.sparkSession
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    with batches_of(spark, BATCH_ROWS):
        texts = keyed.select("doc_id", F.col("__key").alias("row_key"), whole_text().alias("text"))
        gone = kept(removals(texts) if run_words is None else removals(texts).union(run_removals(texts, run_words)))
    # A document's own lines.
    lines = gone.groupBy(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__row")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
        F.sequence("start", F.col("start") + F.col("n") - 1))))).alias("__gone"))
    joined = keyed.join(lines.hint("merge"), F.col("__doc").eqNullSafe(F.col("doc_id")) & (F.col("__row") == F.col("__key")), "left")
    split = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    cut = F.element_at(F.transform(F.array(split), lambda all_: F.array_join(F.transform(left, lambda i: F.get(all_, i)), "\n")), 1)
    return joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long"),
        "n_removed_lines": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(cut),
    }).drop("__key", "__doc", "__row", "__gone")
