"""Postings made and met without a row of work for each query, and evidence that moves once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions.like import substring_join
from folioscope.operators import chains, inverted, search
from folioscope.sources import segments


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def chunk_table(spark, rows):
    return search.with_tokens(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string"))


def invented(seed, chunks):
    draw = random.Random(seed)
    return [(f"{n // 2}#{n % 2}", str(n // 2), " ".join(f"w{int(draw.paretovariate(0.7)) % 40}" for _ in range(draw.randrange(25)))) for n in range(chunks)]


def expected(rows):
    """Postings of chunks by brute force; words of chunks with one key belong together."""
    held = {}
    for chunk, doc, text in rows:
        words = text.split()
        for place, word in enumerate(words):
            after = words[place + 1] if place + 1 < len(words) else ""
            held.setdefault((word, chunk, doc, len(words)), []).append((place, after))
    return {(*key, len(found), tuple(p for p, _ in sorted(found)), tuple(a for _, a in sorted(found))) for key, found in held.items()}


def postings(frame):
    rows = frame.collect()
    found = {(r.term, r.chunk_id, r.doc_id, r.chunk_len, r.tf, tuple(r.positions), tuple(r.following)) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("block", [1, 40, 10**6])
def test_postings_are_made_of_numbers_block_by_block(spark, monkeypatch, block):
    monkeypatch.setattr(inverted, "BLOCK_TOKENS", block)
    plain = [*invented(1, 60), ("x#0", "x", ""), ("y#0", "y", "光刻 É e")]
    made = inverted.positional_postings(chunk_table(spark, plain))
    assert "MapInArrow" in plan(made) and "zip_with" not in plan(made)
    assert postings(made) == expected([*plain[:-1], ("y#0", "y", "光 刻 e e")])
    odd = [*invented(2, 40), *invented(2, 30), ("0", None, "a b"), ("0", None, "b a"), ("0", None, "a b c"), ("0", "0", "a b")]
    assert postings(inverted.positional_postings(chunk_table(spark, odd))) == expected(odd)
    buckets = inverted.positional_postings(chunk_table(spark, odd)).select("bucket", inverted.bucket_of("term").alias("wanted"))
    assert buckets.where("bucket <> wanted").isEmpty()


def test_postings_leave_a_block_in_pieces(monkeypatch):
    monkeypatch.setattr(inverted, "ROWS_AT_ONCE", 3)
    rows = invented(3, 30)
    rows = [row for row in rows if row[2]]
    block = pa.table({"chunk_id": [r[0] for r in rows], "doc_id": [r[1] for r in rows],
                      "chunk_len": pa.array([len(r[2].split()) for r in rows], pa.int32()), "tokens": [r[2] for r in rows]})
    pieces = list(inverted._block_postings(block, ["chunk_id", "doc_id", "chunk_len"]))
    found = [tuple(tuple(v) if isinstance(v, list) else v for v in row.values()) for piece in pieces for row in piece.to_pylist()]
    assert max(map(len, pieces)) == 3 and set(found) == expected(rows) and [(r[0], r[1]) for r in found] == sorted((r[0], r[1]) for r in found)


def hits(frame):
    return {(row.query_id, row["rank"]): (row.chunk_id, row.score) for row in frame.collect()}


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(str(i), f"w{i} w{i + 1} w1 w{i * 3}") for i in range(14)], "query_id string, text string")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root, table = str(tmp_path_factory.mktemp("index") / "index"), chunk_table(spark, invented(4, 200))
    segments.write_segment(table, root)
    return segments.read_index(spark, root), table


def test_queries_are_not_joined_with_postings(spark, monkeypatch, stored, asked):
    index, table = stored
    ranked = inverted.ranked(index, asked, 7)
    assert "MapInArrow" in plan(ranked) and "Aggregate [query_id" not in plan(ranked)
    wanted = hits(search.lexical_search(table, asked, 7))
    assert hits(ranked) == wanted
    monkeypatch.setattr(inverted, "QUERY_BLOCK", 3)
    monkeypatch.setattr(inverted, "SCORE_CELLS", 1)
    assert hits(inverted.ranked(index, asked, 7)) == wanted
    monkeypatch.setattr(inverted, "WEIGHT_BLOCK", 10)
    assert hits(inverted.ranked(index, asked, 7)) == wanted


def test_chunks_of_one_id_are_scored_together(spark, tmp_path):
    """As where documents without an id number their chunks alike."""
    segments.write_segment(chunk_table(spark, [("0", None, "a b"), ("0", None, "a c d"), ("0", "0", "a"), ("1#0", "1", "a a a b")]), str(tmp_path / "index"))
    index = segments.read_index(spark, str(tmp_path / "index"))
    found = inverted.ranked(index, spark.createDataFrame([("q", "a")], "query_id string, text string"), 5).collect()
    share = inverted._share(index)
    summed = index.postings.where("term = 'a'").withColumn("idf", F.lit(1e-6)).groupBy("chunk_id").agg(F.round(F.sum(share), 6).alias("score"))
    assert {(r.chunk_id, r.score) for r in found} == {tuple(r) for r in summed.collect()} and len(found) == 2


def test_a_filter_meets_postings_where_they_lie(spark, monkeypatch, stored, asked):
    index, table = stored
    some = spark.createDataFrame([(str(doc),) for doc in range(0, 100, 3)] * 2 + [(None,), ("none",)], "doc_id string")
    narrowed = search.lexical_search(table, asked, 7, table.join(some, "doc_id", "left_semi"))
    ranked = inverted.ranked(index, asked, 7, some)
    assert plan(ranked).count("RepartitionByExpression") == 1 and plan(ranked).count("strategy=broadcast") == 2
    assert "positions" not in plan(ranked).split("LeftSemi")[1].split("Relation")[0]
    assert hits(ranked) == hits(narrowed)
    monkeypatch.setattr(inverted, "DOCUMENT_BLOCK", 0)
    beyond = inverted.ranked(index, asked, 7, some)
    assert plan(beyond).count("strategy=broadcast") == 1 and hits(beyond) == hits(narrowed)


def test_evidence_moves_once_to_its_document(spark, stored):
    index, _ = stored
    nodes = spark.createDataFrame(
        [("t", "g", "group", None, None), ("t", "n1", "segment", "g", ["w1 w2", "w2", "Title"]), ("t", "n2", "segment", "g", ["w2", "tag"])],
        "theme string, node_id string, node_type string, parent_id string, keywords array<string>")
    documents = spark.createDataFrame([(str(doc), f"title {doc}" if doc < 3 else None, "en") for doc in range(100)], "doc_id string, title string, lang string")
    tags = spark.createDataFrame([("5", "a tag"), (None, "tag"), (None, "tag")], "doc_id string, theme string")
    evidence = chains.segment_documents(nodes, index, documents, tags)
    assert plan(evidence).count("RepartitionByExpression [doc_id") == 1
    split = chains.segment_split(nodes.withColumn("seq", F.lit(1)).withColumn("name", F.col("node_id")), evidence, documents)
    executed = split._jdf.queryExecution().executedPlan().toString()
    # Neither the distinct rows nor the join with the documents move them again.
    assert "REPARTITION_BY_COL" in executed and executed.count("hashpartitioning(theme") == 0
    words = {}
    for chunk, doc, text in invented(4, 200):
        for phrase in ("w1 w2", "w2"):
            if f" {phrase} " in f" {text} ":
                words.setdefault(phrase, set()).add(doc)
    first = words.get("w1 w2", set()) | words["w2"] | {"0", "1", "2"}
    second = words["w2"] | {"5", None}
    rows = evidence.collect()
    assert len(rows) == len(first) + len(second) and {tuple(r) for r in rows} == {("t", "n1", d) for d in first} | {("t", "n2", d) for d in second}


def test_keys_of_a_text_are_found_by_search(spark):
    texts = spark.createDataFrame([(t,) for t in ["", "a", "alpha\nbeta 光刻机", "é😀x😀y", None, "aaaaaa", "50% off_x"]], "t string")
    patterns = spark.createDataFrame([(p,) for p in ["", "a", "aaaa", "a\nbeta", "光刻", "😀x😀", "😀", "50%x", "_x", "ALPHA", "?x"]], "p string")
    met = substring_join(texts, "t", patterns, "p")
    assert "zip_with" not in plan(met)
    rows, asked = [r.t for r in texts.collect()], [r.p for r in patterns.collect()]
    special = {("50%x", "50% off_x")} | {("_x", t) for t in rows if t and "x" in t[1:]}
    wanted = {(p, t) for p in asked if p not in ("50%x", "_x") for t in rows if t is not None and p.lower() in t.lower()} | special
    assert {(r.p, r.t) for r in met.collect()} == wanted
