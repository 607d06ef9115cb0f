import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope.functions import amounts, dates, fixed, names, records, segments, text
from folioscope.functions.like import contains_any, like, substring_join


def values(spark, column, *inputs, schema="v string"):
    frame = spark.createDataFrame([(value,) for value in inputs], schema)
    return [row[0] for row in frame.select(column).collect()]


def test_repairs_all_double_their_only_f():
    assert all(wrong.count("f") == 1 and wrong.replace("f", "ff") == right for wrong, right in fixed.LIGATURE_FIXES.items())


def test_segment_atoms(spark):
    got = values(spark, F.array_sort(segments.name_atoms(F.col("v"))), "AI服务器/整机", "CXO（CRO/CDMO）", "结构件/箔材", None)
    assert got == [["ai服务器"], ["cxo"], ["箔材", "结构件"], []] or got == [["ai服务器"], ["cxo"], ["结构件", "箔材"], []]


def test_segment_canonical_names(spark):
    got = values(spark, segments.canonical_name(F.col("v")), "ＯＰＴＩＣＡＬ　Module", "AI 服务器 环节", "铜箔", None)
    assert got == ["光模块", "ai服务器", "铜箔", ""]


def test_dates(spark):
    assert values(spark, dates.iso_from_yymmdd(F.col("v")), "260626", "270730", "991231", "261332", None) == [
        "2026-06-26", "2027-07-30", None, None, None]
    day = F.col("v").cast("date")
    assert values(spark, dates.week_bucket(day), "2026-01-01", "2024-01-01", None) == ["2026-W00", "2024-W01", "未知"]
    reasons = values(spark, dates.date_reason(F.col("v"), dt.date(2026, 7, 31)), "2026-08-07", "2027-07-30", "2026-7", "")
    assert reasons[0] is None and "未来" in reasons[1]
    assert reasons[2:] == [fixed.REASON_DATE_MALFORMED, fixed.REASON_DATE_MISSING]


def test_as_of_dates(spark):
    frame = spark.createDataFrame(
        [("2026-01", "2026-07-02", "目标价"), ("2026-01", "2026-07-02", "营收"), ("2027-06", "2026-07-02", "目标价"),
         ("2026-04", "2026-07-02", "股价")], "a string, r string, m string")
    got = [row[0] for row in frame.select(dates.as_of_reason(F.col("a"), F.col("r"), F.col("m"))).collect()]
    assert "6 个月" in got[0] and got[1:] == [None, None, None]


def test_file_names(spark):
    inputs = ["甲证券-行业周报(600519)-260626.pdf", "行业周报-260626-乙证券-12页.pdf", "随笔.pdf", "甲证券-增长18%-260626.pdf", "A-b%2bc-260626.pdf"]
    got = values(spark, names.parsed_name(F.col("v")), *inputs)
    assert (got[0].institution, got[0].stock_code, got[0].yymmdd) == ("甲证券", "600519", "260626")
    assert (got[1].institution, got[1].title, got[1].page_count) == ("乙证券", "行业周报", 12)
    assert (got[2].institution, got[2].yymmdd, got[2].reason) == ("未知", None, fixed.REASON_INSTITUTION_MISSING)
    assert got[3].title == "增长18%" and got[4].title == "b+c"


def test_paths(spark):
    path = "2026年7月\\第一周\\02_国内券商报告-1份\\x.pdf"
    column = F.struct(names.week_from_path(F.col("v")), names.month_from_path(F.col("v")), names.category_from_path(F.col("v")))
    assert tuple(values(spark, column, path)[0]) == ("第一周", "2026年7月", "国内券商报告")


def test_language_and_tokens(spark):
    assert values(spark, text.detect_language(F.col("v")), "中" * 20 + "a" * 80, "中" * 19 + "a" * 81, "123", "") == ["zh", "en", "und", "und"]
    assert values(spark, text.raw_tokens(F.col("v")), "茅台A股_x 1650.5元")[0] == ["茅", "台", "A", "股", "_x", "1650", "5", "元"]
    assert values(spark, text.index_tokens(F.col("v")), "Foo_Bar 白酒", "!?") == [["foo", "bar", "白", "酒"], []]
    assert values(spark, text.estimated_tokens(F.length("v")), "", "a" * 7, "a" * 16) == [1, 4, 10]
    pieces = values(spark, text.windows(F.col("v")), "".join(chr(97 + i % 26) for i in range(3000)))[0]
    assert [len(piece) for piece in pieces] == [1600, 1592, 184]


def test_lines_keep_every_kind_of_end(spark):
    sample = "a\r\nb\rc\x0bd e\n\nf"
    assert values(spark, text.lines_with_ends(F.col("v")), sample, "x\ny\n") == [sample.splitlines(keepends=True), ["x\n", "y\n"]]


def test_amounts(spark):
    frame = spark.createDataFrame([(250.0, "百万元"), (3.0, "万亿元"), (468.0, "美元"), (12.0, "%"), (None, "亿元")], "n double, u string")
    assert [row[0] for row in frame.select(amounts.canonical_amount(F.col("n"), F.col("u"))).collect()] == [2.5, 30000.0, None, None, None]


def test_value_status(spark):
    frame = spark.createDataFrame(
        [("2030年1.67万亿元", 1.67), ("CNY255,926mn", 2559.26), ("5", 777777.0), ("abc", 3.0), ("0", 0.0), ("1,200", None), ("约1200", None)],
        "t string, n double")
    got = [row[0] for row in frame.select(amounts.value_status(F.col("t"), F.col("n"))).collect()]
    assert got == [None, None, "scale_mismatch", None, None, "fillable", None]


def test_entities(spark):
    assert values(spark, amounts.canonical_entity(F.col("v")), " tsmc ", "Unknown", None) == ["台积电", "Unknown", None]
    assert "TSMC" in amounts.entity_spellings("台积电") and amounts.entity_spellings("foo") == ["foo"]


def test_like(spark):
    assert values(spark, like(F.col("v"), "a_C%"), "AbCx", "abd", "xabc") == [True, False, False]
    assert values(spark, contains_any(F.col("v"), ["RING", "é"]), "blue ring", "É") == [True, False]


@pytest.mark.parametrize("pattern,expected", [("b%d", ["abcd", "B--D"]), ("BC", ["abcd"]), ("%", ["abcd", "B--D", "x\\y"]), ("x\\y", ["x\\y"]), ("_-_", ["B--D"])])
def test_substring_join(spark, pattern, expected):
    texts = spark.createDataFrame([("abcd",), ("B--D",), ("x\\y",)], "t string")
    patterns = spark.createDataFrame([(pattern,)], "p string")
    assert sorted(row.t for row in substring_join(texts, "t", patterns, "p").collect()) == sorted(expected)


def test_loose_json(spark):
    got = values(spark, records.parse_loose_json(F.col("v"), "a int"), '{"a":1}', 'x ```json\n{"a":2}\n``` y', 'so {"a":3} ok', "nothing")
    assert [row.a if row else None for row in got] == [1, 2, 3, None]


def test_sub_query_lines(spark):
    got = values(spark, records.sub_query_lines(F.col("v"), F.lit("q")), "- one\n·two\n\none\nq\n" + "\n".join(f"s{i}" for i in range(30)))[0]
    assert got[:3] == ["q", "one", "two"] and len(got) == 33
    few = values(spark, records.sub_query_lines(F.col("v"), F.lit("q"), 2), "one\ntwo\nthree")[0]
    assert few == ["q", "one"]
