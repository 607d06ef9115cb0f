import datetime as dt

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.operators import chains, cleaning, drift, records, search, vectors
from folioscope.operators.chunking import chunk_documents, split_sections

PROMO = fixed.PROMO_PHRASES[3]


def test_sections(spark):
    frame = spark.createDataFrame([("# A\nx\n## B\ny\n# C\nz",)], "t string")
    sections = frame.select(F.explode(split_sections(F.col("t"))).alias("s")).select("s.*").collect()
    assert [(s.heading_path, s.body.strip()) for s in sections] == [("A", "x"), ("A > B", "y"), ("C", "z")]


def test_captions_reach_their_images(spark):
    body = "Exhibit 1 sales\n![](images/a.jpg)\n![](images/b.jpg)\n" + "w " * 50
    refs = chunk_documents(spark.createDataFrame([("d", body)], "doc_id string, text string")).first().image_refs
    assert [(r.path, r.caption) for r in refs] == [("images/a.jpg", "Exhibit 1 sales"), ("images/b.jpg", "Exhibit 1 sales")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["# ", "## ", "", "\n\n"]), st.integers(1, 3000)), min_size=1, max_size=6))
def test_chunks_cover_and_stay_bounded(spark, parts):
    words = iter(range(10**6))
    text = ""
    for mark, size in parts:
        body = " ".join(f"w{next(words)}" for _ in range(max(1, size // 6)))
        text += mark + (f"t{next(words)}\n" if mark.startswith("#") else "") + body + "\n"
    chunks = chunk_documents(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("seq").collect()
    assert [chunk.seq for chunk in chunks] == list(range(len(chunks)))
    assert all(len(chunk.text) / 1.6 <= fixed.MAX_TOKENS + fixed.MIN_TOKENS + 1 for chunk in chunks)
    held = set(" ".join(chunk.text for chunk in chunks).split())
    wanted = {word for line in text.splitlines() if not line.startswith("#") for word in line.split()}
    cut = [word for word in wanted - held if not any(word[:3] in other for other in held)]
    assert not cut


def test_cleaning(spark):
    source = f"# 每日报告\n正文\n\n{PROMO}\n  \nabc\n![](images/q.jpg)\n![](images/k.jpg)\nn item efect of EFECT\nExhibit 3: efect\nprefecture\n## START YOUR FINANCE\nzzz"
    frame = spark.createDataFrame([("d", source)], "doc_id string, text string")
    cleaned = cleaning.normalize_documents(frame).first().text
    assert cleaned == "正文\nabc\n![](images/k.jpg)\n- item effect of Effect\nExhibit 3: efect\nprefecture\n"
    assert frame.select(cleaning.clean_change_count(F.col("text"))).first()[0] == 5


def test_fusion(spark):
    lexical = spark.createDataFrame([("q", "a", 0)], "query_id string, chunk_id string, rank int")
    dense = spark.createDataFrame([("q", "b", 0), ("q", "a", 2)], "query_id string, chunk_id string, rank int")
    rows = search.fuse_ranks(lexical, dense).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [("a", round(1 / 60 + 1 / 62, 9)), ("b", round(1 / 60, 9))]


def test_interleave(spark):
    lists = [["1", "2", "3"], ["2", "4"], ["5"]]
    rows = [(0, n, rank, chunk) for n, chunks in enumerate(lists) for rank, chunk in enumerate(chunks)]
    frame = spark.createDataFrame(rows, "analysis_id int, list_no int, rank int, chunk_id string")
    assert [r.chunk_id for r in search.interleave(frame).orderBy("position").collect()] == ["1", "2", "5", "4", "3"]
    assert search.interleave(frame, cap=2).count() == 2


def test_budget_keeps_the_first_row(spark):
    frame = spark.createDataFrame([("q", 0, 50), ("q", 1, 5), ("r", 0, 5), ("r", 1, 4), ("r", 2, 9)], "query_id string, rank int, n int")
    kept = search.within_budget(frame, ["query_id"], "rank", "n", 10).collect()
    assert sorted((r.query_id, r["rank"]) for r in kept) == [("q", 0), ("r", 0), ("r", 1)]


def _index(spark, texts):
    frame = spark.createDataFrame([(f"{i:03d}#0", str(i), text) for i, text in enumerate(texts)], "chunk_id string, doc_id string, text string")
    return search.with_tokens(frame)


def test_scan_and_postings_agree_under_skew(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["the " * int(rng.integers(1, 9)) + " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 20) % 50) for _ in range(200)]
    index = _index(spark, texts)
    queries = spark.createDataFrame([(str(i), f"the The w{i} w{i + 1}") for i in range(12)], "query_id string, text string")
    by_postings = search.top_ranked(
        search.bm25_from_postings(search.build_postings(index), index, queries), [F.desc("score")], 15
    )
    want = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in by_postings.collect()}
    for block in (search.WEIGHT_BLOCK, 8):
        monkeypatch.setattr(search, "WEIGHT_BLOCK", block)
        rows = search.lexical_search(index, queries, 15).collect()
        assert {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in rows} == want


def test_phrases(spark):
    index = _index(spark, ["alpha beta gamma", "beta alpha gamma", "alpha beta delta gamma", "光刻胶 材料"])
    keywords = spark.createDataFrame([("Alpha Beta",), ("alpha beta gamma",), ("光刻",), ("gamma",), ("?!",)], "keyword string")
    rows = search.phrase_hits(index, search.keyword_phrases(keywords)).collect()
    assert sorted((r.phrase, r.doc_id) for r in rows) == sorted(
        [("alpha beta", "0"), ("alpha beta", "2"), ("alpha beta gamma", "0"), ("光 刻", "3"), ("gamma", "0"), ("gamma", "1"), ("gamma", "2")])


def test_dense_blocks_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(120, 8)).astype("float32")
    points[7] = points[3]
    rows = [(f"c{i:03d}", points[i].tolist()) for i in range(120)]
    frame = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", points[i].tolist()) for i in range(20)], "query_id string, embedding array<float>")
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 6)
    got = {(r.query_id, r["rank"]): r.chunk_id for r in vectors.dense_search(frame, queries, 10).collect()}
    exact = points.astype("float64")
    for i in range(20):
        distance = np.round(np.sqrt(((exact - exact[i]) ** 2).sum(axis=1)), 6)
        order = sorted(range(120), key=lambda j: (distance[j], f"c{j:03d}"))[:10]
        assert [got[(f"q{i}", rank)] for rank in range(10)] == [f"c{j:03d}" for j in order]


def test_candidates_keep_decisions(spark):
    current = spark.createDataFrame([("t", "k", "old", 1, "rejected", "noise", None)], "theme string, cand_key string, name string, doc_count int, status string, note string, reviewed_at timestamp")
    seen = spark.createDataFrame([("t", "k", "new", 9), ("t", "n", "other", 2)], "theme string, cand_key string, name string, doc_count int")
    rows = {r.cand_key: r for r in records.merge_candidates(current, seen).collect()}
    assert (rows["k"].doc_count, rows["k"].status, rows["k"].note) == (9, "rejected", "noise")
    assert rows["n"].status == "watching"


def test_peers(spark):
    trees = spark.createDataFrame([("AI算力数据中心",), ("铜",)], "theme string")
    keys = spark.createDataFrame([("算力",), ("光模块",), ("铜箔",)], "cand_key string")
    assert sorted(r.cand_key for r in drift.without_peers(keys, trees).collect()) == ["光模块", "铜箔"]


def test_drift_reports_what_trees_lack(spark):
    day = dt.date(2026, 7, 1)
    documents = spark.createDataFrame([(i, f"t{i}", f"inst{i % 4}", day) for i in range(40)], "doc_id int, title string, institution string, report_date date")
    tags = [(i, "锂电池") for i in range(12)] + [(i, "复合集流体") for i in range(12)] + [(i, "隔膜") for i in range(12)]
    tags += [(i, "出海") for i in range(12)] + [(i, "其他") for i in range(12, 40)]
    doc_themes = spark.createDataFrame(tags, "doc_id int, theme string")
    nodes = spark.createDataFrame([("锂电池", "segment", "锂电隔膜"), ("锂电池", "group", "材料")], "theme string, node_type string, name string")
    rows = drift.detect_drift(documents, doc_themes, nodes, dt.date(2026, 8, 1)).collect()
    assert [(r.name, r.doc_count, r.inst_count) for r in rows] == [("复合集流体", 12, 4)]


def test_keywords_merge(spark):
    frame = spark.createDataFrame([(" CPO ", ["cpo", "光电", " ", "光电"])], "n string, k array<string>")
    assert frame.select(chains.merged_keywords(F.col("n"), F.col("k"))).first()[0] == ["CPO", "光电"]
