"""Streams in several batches, with repeats far apart and late rows."""

import datetime as dt

import pytest

from folioscope.streaming import logs

SCHEMA = "doc_id long, theme string, ts timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def stream(spark, folder, batches, schema=SCHEMA):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{number}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def heat(spark, folder, batches, by):
    counts = logs.theme_heat(stream(spark, folder / "in", batches), "7 days", by)
    logs.write_updates(counts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return {(row.start, row.theme): row.docs for row in logs.latest_heat(spark, f"{folder}/out", by).collect()}


@pytest.mark.parametrize("by", ["week", "month"])
def test_a_document_counts_once_in_a_window(spark, tmp_path, by):
    batches = [
        [(1, "a", at(0)), (1, "a", at(0, 5)), (2, "a", at(2)), (3, None, at(1))], [(1, "a", at(6)), (1, "b", at(4))],
        [(1, "a", at(19)), (2, "a", at(30)), (4, "a", at(24))], [(1, "a", at(33)), (2, "a", at(59)), (5, "a", at(55))]]
    def start(moment):
        return (moment - dt.timedelta(days=moment.weekday()) if by == "week" else moment.replace(day=1)).date()

    want = {}
    for doc, theme, moment in [row for rows in batches for row in rows]:
        want.setdefault((start(moment), theme), set()).add(doc)
    assert heat(spark, tmp_path, batches, by) == {key: len(docs) for key, docs in want.items()}


def test_late_rows_of_open_windows_count(spark, tmp_path):
    batches = [[(1, "a", at(8))], [(2, "a", at(1)), (1, "a", at(13))], [(3, "a", at(12))]]
    assert heat(spark, tmp_path, batches, "week") == {(at(0).date(), "a"): 1, (at(7).date(), "a"): 2}


def test_only_new_over_batches(spark, tmp_path):
    schema = "doc_id long, text string"
    batches = [[(1, "x"), (2, "y"), (2, "y")], [(2, "z"), (3, "x"), (None, "q")], [(1, "x"), (None, "q"), (4, "w")]]
    known = spark.createDataFrame([(3,), (9,)], "doc_id long")
    fresh = logs.only_new(stream(spark, tmp_path / "in", batches, schema), known)
    logs.write_append(fresh, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()
    assert sorted((row.doc_id or 0) for row in rows) == [0, 1, 2, 4]
