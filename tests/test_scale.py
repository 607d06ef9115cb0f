"""Plans whose cost grew faster than their input before."""

import re

from pyspark.sql import functions as F

from folioscope.functions.dates import as_of_reason
from folioscope.operators import drift, inverted, layout, search
from folioscope.plans import facts, indexing
from folioscope.sources import segments


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_spread_input_gets_more_tasks_as_it_grows(spark, monkeypatch, tmp_path):
    spark.range(50_000).write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    few = layout.spread(frame).rdd.getNumPartitions()
    monkeypatch.setattr(layout, "SPREAD_BYTES", layout.estimated_bytes(frame) // 20)
    assert few == spark.sparkContext.defaultParallelism and layout.spread(frame).rdd.getNumPartitions() >= 20


def test_an_atom_of_many_names_meets_candidates_as_one_row(spark):
    names = spark.createDataFrame([(f"alpha/n{i}", i) for i in range(40)] + [("alpha/nx", None), ("gamma", None)], "name string, position long")
    wanted = spark.createDataFrame([("alpha（beta）",), ("gamma",), ("delta",)], "candidate string")
    covered = drift.covering_segments(wanted, names)
    assert {tuple(row) for row in covered.collect()} == {("alpha（beta）", "alpha/n0"), ("gamma", None)}
    assert plan(covered).count("min_by(") == 2


def test_texts_stay_out_of_the_join_that_finds_missing_vectors(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a",)], "chunk_id string")
    cache = spark.createDataFrame([], "key string, embedding array<float>")

    class Model:
        model, dimensions = "model", 64

    _, wanted = indexing.embed_missing(chunks, vectors, cache, Model())
    assert [row.chunk_id for row in wanted.collect()] == ["b"]
    assert plan(wanted).index("LeftAnti") < plan(wanted).index("sha2(")


def test_answers_are_parsed_once(spark):
    rows = [("d1", None, '{"facts": [{"entity": "e", "value_num": "1"}, null], "themes": ["t", " "]}'), ("d2", None, "{}"), ("d3", None, None)]
    answers = spark.createDataFrame(rows, "doc_id string, report_date date, answer string")
    for made, key in ((facts.fact_rows(answers), "fact_id"), (facts.theme_rows(answers), "theme")):
        assert [row[key] for row in made.collect()] == [{"fact_id": "d1#0", "theme": "t"}[key]]
        assert "size(coalesce" not in plan(made) and plan(made).count("from_json") <= 3


def test_dates_of_a_complaint_are_read_once(spark):
    rows = [("1999-01", "1999-06-30"), ("1999-1-9", " 1999-06"), ("x", "1999-06-30"), (None, "1999-06-30"), ("1999-06", "1999-06-30")]
    frame = spark.createDataFrame(rows, "as_of string, report string")
    reason = as_of_reason(F.col("as_of"), F.col("report"), F.lit("目标价"))
    assert [row.r is not None for row in frame.select(reason.alias("r")).collect()] == [True, True, False, False, False]
    assert plan(frame.select(reason.alias("r"))).count("regexp_extract(trim(as_of") <= 2


def index_of(spark, root, texts):
    rows = [(f"{doc}#0", doc, text) for doc, text in texts]
    segments.write_segment(search.with_tokens(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")), root)
    return segments.read_index(spark, root)


def test_postings_are_made_inside_the_chunk(spark, tmp_path):
    rows = [("1#0", "1", "b a b"), ("2#0", "2", "a"), ("3#0", "3", "")]
    chunks = search.with_tokens(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string"))
    made = inverted.positional_postings(chunks)
    assert "Aggregate" not in plan(made)
    assert {(r.term, r.chunk_id, r.tf, tuple(r.positions)) for r in made.collect()} == {
        ("a", "1#0", 1, (1,)), ("b", "1#0", 2, (0, 2)), ("a", "2#0", 1, (0,))}
    twice = inverted.positional_postings(chunks.union(chunks)).where("term = 'b'").collect()
    assert [(r.tf, r.positions) for r in twice] == [(4, [0, 0, 2, 2])]


def test_files_of_a_bucket_grow_with_the_tokens(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(segments, "FILE_TOKENS", 1)
    texts = [(str(doc), "same word") for doc in range(160)]
    index = index_of(spark, str(tmp_path / "index"), texts)
    files = index.postings.where("term = 'same'").select(F.input_file_name().alias("file")).distinct().count()
    assert files > segments.SPREAD and index.postings.count() == 320


def test_postings_meet_shared_terms_where_they_are(spark, tmp_path):
    index = index_of(spark, str(tmp_path / "index"), [(str(doc), f"the w{doc % 7} end") for doc in range(90)])
    asked = spark.createDataFrame([("q", "the w1")], "query_id string, text string")
    ranked = inverted.ranked(index, asked, 5)
    assert "strategy=broadcast" in plan(ranked)
    # One move of the postings, to their chunk; the sums of all queries are made there.
    assert plan(ranked).count("RepartitionByExpression [chunk_id") == 1
    executed = ranked._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+, chunk_id", executed)


def test_phrases_meet_by_chunk_with_gaps_and_repeats(spark, tmp_path):
    texts = [("1", "a b c"), ("2", "a x b c"), ("3", "b a b"), ("4", "a b a b c"), ("5", "c"), ("6", "a b c"), ("6", "a b c")]
    index = index_of(spark, str(tmp_path / "index"), texts)
    phrases = spark.createDataFrame([("a b c",), ("b c",), ("a b",), ("c",), ("a a",), ("a zz",)], "phrase string")
    found = {tuple(row) for row in inverted.phrase_documents(index, phrases).collect()}
    assert found == {(phrase, doc) for phrase in ("a b c", "b c", "a b", "c", "a a") for doc, text in texts if f" {phrase} " in f" {text} "}
