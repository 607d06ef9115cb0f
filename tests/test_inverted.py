"""The stored positional index: ranking against the scan, phrases against brute force, segments against a fresh index."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import inverted, retrieval, search
from folioscope.operators.filters import Filters
from folioscope.sources import segments


def chunks(spark, texts):
    rows = [(f"{doc}#{part}", doc, text) for doc, parts in texts.items() for part, text in enumerate(parts)]
    return search.with_tokens(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string"))


def invented(seed, documents):
    draw = random.Random(seed)
    return {str(doc): [" ".join(["the"] * draw.randrange(1, 9) + [f"w{int(draw.paretovariate(0.6)) % 60}" for _ in range(draw.randrange(20))])
                       for _ in range(draw.randrange(1, 3))] for doc in range(documents)}


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(str(i), f"the The w{i} w{i + 1}") for i in range(12)] + [("none", "?!"), ("rare", "zzz")], "query_id string, text string")


def hits(frame):
    return {(row.query_id, row["rank"]): (row.chunk_id, row.score) for row in frame.collect()}


def test_ranking_matches_the_scan(spark, queries, tmp_path):
    table = chunks(spark, {**invented(5, 150), "empty": [""]})
    segments.write_segment(table, str(tmp_path / "index"))
    index = segments.read_index(spark, str(tmp_path / "index"))
    for limit in (1, 15, 1000):
        assert hits(inverted.ranked(index, queries, limit)) == hits(search.lexical_search(table, queries, limit))
    some = table.select("doc_id").where("try_cast(doc_id AS INT) % 7 = 0").distinct()
    eligible = table.join(some, "doc_id", "left_semi")
    assert hits(inverted.ranked(index, queries, 15, some)) == hits(search.lexical_search(table, queries, 15, eligible))


def test_light_terms_are_probed_only_where_they_can_matter(spark, tmp_path):
    """The term of all chunks is light once rarer terms fill the list, and still counts in every score."""
    texts = {str(doc): ["the the rare word" if doc < 60 else "the other"] for doc in range(300)}
    segments.write_segment(chunks(spark, texts), str(tmp_path / "index"))
    index = segments.read_index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([("q", "the rare")], "query_id string, text string")
    weights = inverted.weighted_terms(index, asked)
    floors = inverted.score_floors(index.postings, weights, inverted._share(index), 40).collect()
    the = weights.where("term = 'the'").first().idf
    assert len(floors) == 1 and the * 2.5 < floors[0].floor
    rows = inverted.ranked(index, asked, 40).collect()
    assert len(rows) == 40 and {row.score for row in rows} == {row.score for row in search.lexical_search(chunks(spark, texts), asked, 40).collect()}


def test_only_folders_of_asked_terms_are_read(spark, tmp_path):
    segments.write_segment(chunks(spark, invented(6, 40)), str(tmp_path / "index"))
    index = segments.read_index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([("q", "w1")], "query_id string, text string")
    frame = inverted._bucketed(search.query_terms(asked)).join(index.terms, ["bucket", "term"])
    assert "dynamicpruning" in frame._jdf.queryExecution().toString()


def test_later_segments_replace_documents(spark, queries, tmp_path):
    root, old = str(tmp_path / "index"), invented(7, 60)
    new = {doc: parts for doc, parts in invented(8, 90).items() if int(doc) % 3 == 0}
    gone = spark.createDataFrame([(doc,) for doc in [*new, "59"]], "doc_id string")
    segments.write_segment(chunks(spark, old), root)
    before = {path: path.stat().st_mtime_ns for path in (tmp_path / "index").rglob("*.parquet")}
    segments.write_segment(chunks(spark, new), root, gone)
    assert before == {path: path.stat().st_mtime_ns for path in before}
    fresh = chunks(spark, {**{doc: parts for doc, parts in old.items() if doc != "59"}, **new})
    index = segments.read_index(spark, root)
    assert hits(inverted.ranked(index, queries, 15)) == hits(search.lexical_search(fresh, queries, 15))
    df = {row.term: row.df for row in index.terms.collect()}
    assert df == {row.term: row.df for row in search.term_statistics(fresh).collect()}
    segments.write_segment(chunks(spark, {}), root, spark.createDataFrame([("0",)], "doc_id string"))
    assert segments.read_index(spark, root).documents.where("doc_id = '0'").isEmpty()


def test_unfinished_segments_are_not_seen(spark, tmp_path):
    root = tmp_path / "index"
    assert segments.read_index(spark, str(root)) is None
    (root / "segment-0" / "postings").mkdir(parents=True)
    assert segments.read_index(spark, str(root)) is None
    segments.write_segment(chunks(spark, {"1": ["alpha"]}), str(root))
    assert segments.read_index(spark, str(root)).documents.count() == 1 and (root / "segment-1").exists()


def test_phrases_match_brute_force(spark, tmp_path):
    draw = random.Random(3)
    texts = {str(doc): [" ".join(draw.choice("a b c d 光刻 É".split()) for _ in range(draw.randrange(30))) for _ in range(2)] for doc in range(40)}
    table = chunks(spark, texts)
    segments.write_segment(table, str(tmp_path / "index"))
    wanted = ["a", "a b", "a a", "b a b", "a b c d", "光 刻", "e e", "a missing", "c d a a"]
    phrases = spark.createDataFrame([(phrase,) for phrase in wanted], "phrase string")
    got = {tuple(row) for row in inverted.phrase_documents(segments.read_index(spark, str(tmp_path / "index")), phrases).collect()}
    assert got == {(phrase, row.doc_id) for row in table.collect() for phrase in wanted if f" {phrase} " in f" {row.tokens} "}


def test_modes_and_filters(spark, queries, tmp_path):
    texts = invented(9, 50)
    segments.write_segment(chunks(spark, texts), str(tmp_path / "index"))
    index = segments.read_index(spark, str(tmp_path / "index"))
    documents = spark.createDataFrame([(doc, "en" if int(doc) % 2 else "zh") for doc in texts], "doc_id string, lang string")
    vectors = spark.createDataFrame([(f"{doc}#0", doc, [float(int(doc) % 9), float(doc)]) for doc in texts], "chunk_id string, doc_id string, embedding array<float>")
    asked = queries.select("query_id", F.array(F.lit(1.0), F.lit(3.0)).alias("embedding"))

    def found(mode, **filters):
        return {row.chunk_id.split("#")[0] for row in retrieval.retrieve(
            index, vectors, documents, queries, asked, Filters(**filters), mode, 10, 30).collect()}

    for mode in retrieval.MODES:
        assert all(int(doc) % 2 for doc in found(mode, lang="en")) and len(found(mode, lang="en")) >= 10
        assert any(int(doc) % 2 == 0 for doc in found(mode))
    assert found("vector", lang="en") <= found("hybrid", lang="en")
    with pytest.raises(ValueError):
        retrieval.retrieve(index, vectors, documents, queries, asked, mode="both")
