"""Cases that gave wrong answers before."""

import datetime as dt

from pyspark.sql import functions as F

from folioscope.functions import like
from folioscope.functions.names import parsed_name
from folioscope.operators import drift, records
from folioscope.plans import facts
from folioscope.streaming import logs


def test_old_themes_go_with_a_new_extraction(spark):
    answers = spark.createDataFrame([("d1", dt.date(2024, 1, 1), '{"facts": [], "themes": ["new"]}', None)], "doc_id string, report_date date, answer string, error string")
    themes = spark.createDataFrame([("d1", "old"), ("d2", "kept")], "doc_id string, theme string")
    empty_facts = facts.fact_rows(answers).where("false")
    log = spark.createDataFrame([], "doc_id string, model string, schema_ver int, fact_count int, theme_count int, extracted_at timestamp")
    _, after, _ = facts.apply_extraction(answers, empty_facts, themes, log, "m", 1, F.lit(None).cast("timestamp"))
    assert {tuple(row) for row in after.select("doc_id", "theme").collect()} == {("d1", "new"), ("d2", "kept")}


def test_long_texts_are_extracted_whole(spark, monkeypatch):
    monkeypatch.setattr(facts.fixed, "EXTRACTION_CHARS", 3)

    class Echo:
        model = "echo"

        def extract(self, meta, body):
            return '{"facts": [], "themes": ["t' + body + '"]}'

    documents = spark.createDataFrame(
        [("d1", "aaabbbcc", "i", "t", None, "c"), ("d2", None, "i", "t", None, "c")],
        "doc_id string, text string, institution string, title string, report_date date, category string")
    answers = facts.extract_answers(documents, Echo(), 2)
    rows = answers.withColumn("report_date", F.lit(None).cast("date"))
    assert {row.theme for row in facts.theme_rows(rows.where("doc_id = 'd1'")).collect()} == {"taaa", "tbbb", "tcc"}
    assert {row.doc_id for row in answers.where("error IS NULL").collect()} == {"d1", "d2"}


def test_undated_collections_have_no_cutoff(spark):
    undated = spark.createDataFrame([(None,)], "report_date date")
    assert undated.select(drift.recency_cutoff(undated, dt.date(2024, 1, 1), 60).alias("c")).first().c is None


def test_peers_with_a_percent_sign(spark):
    candidates = spark.createDataFrame([("100%国产电池",), ("other",)], "cand_key string")
    themes = spark.createDataFrame([("100%国产",)], "theme string")
    assert [row.cand_key for row in drift.without_peers(candidates, themes).collect()] == ["other"]


def test_patterns_with_quotes_inside(spark):
    frame = spark.createDataFrame([(r"a\Eb.c",), ("abc",)], "v string")
    assert [row.v for row in frame.where(like.contains_like(F.col("v"), r"\Eb.")).collect()] == [r"a\Eb.c"]


def test_one_result_per_record(spark):
    kept = spark.createDataFrame([("1", "in/a.pdf"), ("2", "in/b.pdf")], "doc_id string, source string")
    items = spark.createDataFrame(
        [(0, None, "a.pdf", "x", "first"), (1, None, "a.pdf", "x", "last"), (2, "2", "", "b.pdf", "id")],
        "position int, data_id string, file_name string, name string, state string")
    got = records.match_results(kept, items).select("doc_id", "item.state").collect()
    assert sorted(map(tuple, got)) == [("1", "last"), ("2", "id")]


def test_undated_rows_are_quarantined(spark):
    reports = spark.createDataFrame([(None,), (dt.datetime(2024, 1, 1),), (dt.datetime(2030, 1, 1),)], "ts timestamp")
    trusted, held = logs.split_future(reports, dt.date(2024, 1, 2))
    assert (trusted.count(), held.count()) == (1, 2)


def test_names_with_several_dates_and_stray_percent(spark):
    rows = spark.createDataFrame([("中信-题目-240101-240202.pdf",), ("100%国产-电池-240101-机构.pdf",), ("仅标题.pdf",), ("",)], "v string")
    got = [row.p.asDict() for row in rows.select(parsed_name(F.col("v")).alias("p")).collect()]
    assert got[0]["yymmdd"] == "240202" and got[0]["institution"] == "中信" and got[0]["title"] == "题目-240101"
    assert got[1]["institution"] == "机构" and got[1]["title"] == "100%国产-电池" and got[2]["title"] == "仅标题"
    assert got[3]["institution"] == "未知" and got[3]["yymmdd"] is None


def test_a_broken_archive_does_not_stop_the_others(spark, tmp_path):
    import zipfile

    from folioscope.sources import files

    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as archive:
        archive.writestr("doc/full.md", "text")
    rows = {row.archive.rpartition("/")[2]: row for row in files.extract_archives(spark, str(tmp_path)).collect()}
    assert rows["good.zip"].content == b"text" and rows["good.zip"].error is None
    assert rows["bad.zip"].content is None and rows["bad.zip"].error
