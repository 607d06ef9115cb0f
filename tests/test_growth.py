"""Shuffles, work and memory that grew faster than the input."""

import random
import re

from pyspark.sql import functions as F

from folioscope.functions.text import INDEX_TOKEN, all_matches, folded, index_token_string
from folioscope.operators import drift, inverted, layout, search
from folioscope.plans.registry import retrieval
from folioscope.sources import segments


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def index_of(spark, root, texts):
    rows = [(f"{doc}#0", doc, text) for doc, text in texts]
    segments.write_segment(search.with_tokens(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")), root)
    return segments.read_index(spark, root)


def test_phrases_are_met_where_postings_lie(spark, tmp_path):
    draw = random.Random(11)
    texts = [(str(doc), " ".join(draw.choice("abcd") for _ in range(draw.randrange(14)))) for doc in range(60)]
    index = index_of(spark, str(tmp_path / "index"), texts)
    short = spark.createDataFrame([("a b",), ("c",), ("d d",)], "phrase string")
    assert "RepartitionByExpression" not in plan(inverted.phrase_documents(index, short))
    assert "collect_list" not in plan(inverted.phrase_documents(index, short))
    wanted = ["a", "a b", "a a a", "a b a b", "d c b a", "b b c", "a zz"]
    found = {tuple(row) for row in inverted.phrase_documents(index, spark.createDataFrame([(p,) for p in wanted], "phrase string")).collect()}
    assert found == {(p, doc) for p in wanted for doc, text in texts if f" {p} " in f" {text} "}


def test_postings_hold_the_word_that_follows(spark, tmp_path):
    index = index_of(spark, str(tmp_path / "index"), [("1", "b a b"), ("2", "a")])
    rows = {(r.term, r.chunk_id, tuple(r.positions), tuple(r.following)) for r in index.postings.collect()}
    assert rows == {("a", "1#0", (1,), ("b",)), ("b", "1#0", (0, 2), ("a", "")), ("a", "2#0", (0,), ("",))}


def test_the_vector_route_builds_no_postings(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "t", "src1", "en", 1), (100, "t", "src1", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0], 0), (100, [3.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "t")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def built(*_):
        raise AssertionError("postings were built")

    monkeypatch.setattr(retrieval.t, "text_postings", built)
    rows = retrieval.dense_filtered(spark, str(tmp_path)).collect()
    assert [(r.query_id, r.chunk_id, r.distance) for r in rows] == [("1", "100#0", 2.0)]


def test_tokens_without_cjk_are_not_listed_one_by_one(spark):
    texts = ["", "  ", "Été_1 ÀB  x-y\n\tZ", "½ ٣ ǅ e\u0301", "光刻 abc机def", "_", "a", "\u00a0a\u2003b\u00a0", "ſK İ 𝒜𝟙 😀x"]
    frame = spark.createDataFrame([(text,) for text in [*texts, None]], "text string")
    listed = F.array_join(all_matches(folded(F.col("text")), INDEX_TOKEN), " ")
    for row in frame.select(index_token_string(F.col("text")).alias("got"), listed.alias("wanted")).collect():
        assert row.got == row.wanted
    assert "regexp_replace" in plan(frame.select(index_token_string(F.col("text"))))


def test_tags_are_dealt_out_by_document_once(spark, monkeypatch, tmp_path):
    draw = random.Random(4)
    rows = [(doc, theme) for doc in range(300) for theme in draw.sample(["chip", "chip set", "ship", "set", "port"], draw.randrange(1, 5))]
    spark.createDataFrame(rows, "doc_id long, theme string").write.parquet(str(tmp_path / "tags"))
    tags = spark.read.parquet(str(tmp_path / "tags"))
    monkeypatch.setattr(layout, "SPREAD_BYTES", layout.estimated_bytes(tags) // 20)
    chains = spark.createDataFrame([("chip",), ("set",)], "theme string")
    pairs = drift.co_occurrence(drift.matching_themes(chains, tags), tags)
    executed = pairs._jdf.queryExecution().executedPlan().toString()
    assert executed.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in executed
    assert int(re.search(r"hashpartitioning\(doc_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", executed).group(1)) >= 20
    held = {}
    for doc, theme in rows:
        held.setdefault(doc, []).append(theme)
    wanted = {(chain, theme, doc) for doc, themes in held.items() for chain in ("chip", "set") for theme in themes
              if any(chain in other for other in themes if other != theme)}
    found = [tuple(row) for row in pairs.collect()]
    assert len(found) == len(wanted) and set(found) == wanted
