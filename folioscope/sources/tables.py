"""The supplied tables read as the engine's own entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed
from ..functions.text import index_tokens
from ..operators.chunking import chunk_documents
from ..operators.cleaning import normalize_documents
from ..operators.inverted import Index
from ..operators.layout import spread
from ..operators.search import with_tokens
from ..session import shared_dir
from .segments import read_index, write_segment
from .sinks import file_fingerprint, read_snapshot, write_snapshot


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents: the first line is the title, the source is the institution."""
    raw = table(spark, folder, "documents")
    return raw.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "text",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("institution"),
        F.when(F.col("lang") == "en", "foreign").otherwise("domestic").alias("category"),
        "lang",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")).alias("report_date"),
        F.col("n_chars").alias("char_count"),
    )


def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned documents cut into chunks."""
    documents = spread(text_documents(spark, folder).select("doc_id", "text"), "doc_id")
    return chunk_documents(normalize_documents(documents))


def text_index(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with their tokens, as a table built once per state of the documents file."""
    return derived(spark, folder, "text-index", ["documents"], lambda: with_tokens(text_chunks(spark, folder)))


def text_postings(spark: SparkSession, folder: str) -> Index:
    """The stored positional index of the text documents, built once per state of the documents file."""
    root = f"{shared_dir(spark)}/text-segments-{BUILD}-{file_fingerprint(spark, f'{folder}/documents.parquet')}"
    stored = read_index(spark, root)
    if stored is None:
        write_segment(text_index(spark, folder), root)
        stored = read_index(spark, root)
    return stored


# Raised whenever cleaning, chunking, tokens or trees change, so that no kept table outlives its code.
BUILD = 4


def derived(
    spark: SparkSession, folder: str, name: str, inputs: list[str], build: Callable[[], DataFrame]
) -> DataFrame:
    """A table the engine keeps, written once per state of the files it comes from."""
    states = "-".join(file_fingerprint(spark, f"{folder}/{table_name}.parquet") for table_name in inputs)
    root = f"{shared_dir(spark)}/{name}-{BUILD}-{states}"
    stored = read_snapshot(spark, root)
    return write_snapshot(build(), root) if stored is None else stored


def text_themes(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of the text documents: their source and the marks in labels."""
    sources = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("theme")
    )
    marks = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.explode(
            F.array(
                F.concat(F.lit("quality "), F.col("quality").cast("string")),
                F.concat(F.lit("toxic "), F.col("toxic").cast("string")),
            )
        ).alias("theme"),
    )
    return sources.unionByName(marks).distinct()


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each query's vector: the embedding with the query's number."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return vectors.join(text_queries(spark, folder).select("query_id"), "query_id", "left_semi")


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's vector belongs to its first chunk."""
    return table(spark, folder, "embeddings").select(
        F.concat(F.col("vec_id").cast("string"), F.lit("#0")).alias("chunk_id"), "embedding", "label"
    )


def order_reports(spark: SparkSession, folder: str) -> DataFrame:
    """orders as dated reports; the customer's nation is the institution."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    joined = orders.join(customers, "o_custkey").join(nations, "c_nationkey")
    return joined.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("n_name").alias("institution"),
        F.when(F.col("n_regionkey") % 2 == 0, "zh").otherwise("en").alias("lang"),
        F.col("o_orderdate").cast("date").alias("report_date"),
    )


def order_themes(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of the order reports: brands and names of the parts they hold."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p_partkey"))
    lines = spread(lines)
    parts = table(spark, folder, "part").select("p_partkey", F.explode(F.array("p_brand", "p_name")).alias("theme"))
    return lines.join(parts, "p_partkey").select("doc_id", "theme").distinct()


def tag_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same tags as a kept table, for queries that read them several times."""
    return derived(spark, folder, "order-tags", ["lineitem", "part"], lambda: order_themes(spark, folder))


def line_facts(spark: SparkSession, folder: str, entity: str = "p_name") -> DataFrame:
    """Three facts per order line: price, quantity and discount."""
    lines = spread(
        table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
            "l_returnflag", "l_linestatus", "l_shipdate",
        )
    )
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = lines.join(parts, "l_partkey").join(orders, "l_orderkey")
    price_unit = (
        F.when(F.col("l_returnflag") == "A", "万元").when(F.col("l_returnflag") == "N", "百万元").otherwise("亿元")
    )
    # Whole numbers as text; every seventh line quotes a figure of another magnitude.
    price_text = F.format_string("%d", F.floor("l_extendedprice").cast("bigint"))
    odd = (F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0
    values = F.array(
        F.struct(
            F.lit("目标价").alias("metric"), F.col("l_extendedprice").alias("value_num"),
            F.when(odd, "0.0013").otherwise(price_text).alias("value_text"), price_unit.alias("unit"), F.lit(1).alias("n"),
        ),
        F.struct(
            F.lit("营收").alias("metric"), F.when(odd, F.lit(None)).otherwise(F.col("l_quantity")).alias("value_num"),
            F.col("l_quantity").cast("int").cast("string").alias("value_text"), F.lit("台").alias("unit"), F.lit(2).alias("n"),
        ),
        F.struct(
            F.lit("折扣率").alias("metric"), (F.col("l_discount") * 100).alias("value_num"),
            F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("value_text"),
            F.lit("%").alias("unit"), F.lit(3).alias("n"),
        ),
    )
    exploded = joined.withColumn("fact", F.explode(values))
    return exploded.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
                    F.lpad(F.col("l_partkey").cast("string"), 10, "0"), F.col("fact.n").cast("string")).alias("fact_id"),
        F.col("l_orderkey").alias("doc_id"),
        F.col("o_orderdate").cast("date").alias("report_date"),
        F.col(entity).alias("entity"),
        "fact.metric", "fact.value_num", "fact.value_text", "fact.unit",
        F.when(F.col("l_linestatus") == "O", "up").otherwise("down").alias("direction"),
        F.date_format("l_shipdate", "yyyy-MM").alias("as_of_date"),
    )


def brand_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Line facts whose entity is the brand, two brands under aliased company names."""
    company = F.when(F.col("entity") == "Brand#1", "TSMC").when(F.col("entity") == "Brand#2", "台积电")
    return line_facts(spark, folder, "p_brand").withColumn("entity", company.otherwise(F.col("entity")))


def brand_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Trees (theme, groups): brand > part type > its part names, most frequent first."""
    counts = table(spark, folder, "part").groupBy("p_brand", "p_type", "p_name").agg(F.count("*").alias("n"))
    window = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("n"), "p_name")
    top = counts.withColumn("place", F.row_number().over(window))
    segment = F.struct(
        "place",
        F.struct(
            F.col("p_name").alias("name"),
            F.concat(F.lit("parts "), F.col("n").cast("string")).alias("summary"),
            F.array(
                F.struct(F.col("p_name").alias("name"), F.lit("").alias("code"), F.lit("part").alias("role"))
            ).alias("tickers"),
            F.split("p_name", " ").alias("keywords"),
        ).alias("segment"),
    )
    groups = top.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(segment)).alias("ranked"))
    group = F.struct(
        F.col("p_type").alias("name"), F.lit("中游").alias("stage"), F.lit("").alias("summary"),
        F.transform("ranked", lambda entry: entry["segment"]).alias("segments"),
    )
    return groups.groupBy(F.col("p_brand").alias("theme")).agg(F.array_sort(F.collect_list(group)).alias("groups"))


QUERY_TREE_GROUPS = 4


def query_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Tree nodes over the text documents: every benchmark passage is one segment.

    Its keywords are the passage's word pairs in order, so they search as phrases.
    """
    tokens = table(spark, folder, "benchmark").select(
        "item_id", index_tokens(F.col("text")).alias("tokens")
    )
    pairs = F.zip_with(
        F.col("tokens"), F.slice("tokens", F.lit(2), F.size("tokens")),
        lambda left, right: F.when(right.isNull(), left).otherwise(F.concat_ws(" ", left, right)),
    )
    theme = F.concat(F.lit("tree "), (F.col("item_id") % 5).cast("string"))
    group = (F.col("item_id") % QUERY_TREE_GROUPS).cast("string")
    base = tokens.select("item_id", theme.alias("theme"), group.alias("group_no"), pairs.alias("keywords"))
    parent = F.concat_ws("|", slug_of("theme"), F.col("group_no"))
    segments = base.select(
        F.concat_ws("|", parent, F.col("item_id").cast("string")).alias("node_id"), "theme",
        F.lit("segment").alias("node_type"), parent.alias("parent_id"), F.col("item_id").cast("int").alias("seq"),
        F.concat(F.lit("passage "), F.col("item_id").cast("string")).alias("name"), "keywords",
    )
    groups = base.select("theme", "group_no").distinct().select(
        parent.alias("node_id"), "theme", F.lit("group").alias("node_type"),
        F.lit(None).cast("string").alias("parent_id"), F.col("group_no").cast("int").alias("seq"),
        F.concat(F.lit("group "), F.col("group_no")).alias("name"), F.lit(None).cast("array<string>").alias("keywords"),
    )
    return segments.unionByName(groups).withColumn("stage", F.lit(None).cast("string")).withColumn(
        "summary", F.lit(None).cast("string")
    )


def slug_of(name: str) -> Column:
    return F.replace(F.col(name), F.lit(" "), F.lit("-"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """events as an append-only processing log of one file per user."""
    status = (
        F.when(F.col("event_type") == "purchase", "success")
        .when(F.col("event_type") == "signup", "submitted")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("submitting")
    )
    return table(spark, folder, "events").select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("sha256"),
        "user_id", "event_id", "ts", status.alias("status"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("batch-"), F.get_json_object("props", "$.k"))).alias("batch_id"),
        F.col("value").alias("size"),
    )


def archive_names(spark: SparkSession, folder: str) -> DataFrame:
    """Archive paths and file names spelled out of the orders, in every known layout."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyMMdd")
    code = F.lpad((key % 1000000).cast("string"), 6, "0")
    firm = F.concat(F.lit("机构"), (F.col("o_custkey") % 40).cast("string"))
    subject = F.concat(F.lit("行业跟踪"), F.col("o_orderpriority"))
    name = (
        F.when(key % 6 == 0, F.concat(firm, F.lit("-"), subject, F.lit("（"), code, F.lit("）-"), stamp, F.lit(".pdf")))
        .when(key % 6 == 1, F.concat(subject, F.lit("-"), stamp, F.lit("-"), firm, F.lit("-"), (key % 90 + 1).cast("string"), F.lit("页.pdf")))
        .when(key % 6 == 2, F.concat(firm, F.lit("-增长%2b18%-"), stamp, F.lit(".pdf")))
        .when(key % 6 == 3, F.concat(F.lit("随笔"), key.cast("string"), F.lit(".pdf")))
        .when(key % 6 == 4, F.concat(F.lit("要点：增长-"), subject, F.lit("-991332.pdf")))
        .otherwise(F.concat(F.lit("Bank "), (F.col("o_custkey") % 7).cast("string"), F.lit("-Outlook "), subject, F.lit("-"), stamp, F.lit(".pdf")))
    )
    shelf = F.when(key % 3 == 0, "02_国内券商报告-9份").when(key % 3 == 1, "03_投行报告-5份").otherwise("04_其他")
    week = F.concat(F.lit("第"), F.element_at(F.array(*[F.lit(c) for c in "一二三四五"]), (key % 5 + 1).cast("int")), F.lit("周"))
    month = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("年"), F.month("o_orderdate").cast("string"), F.lit("月"))
    return orders.select(
        F.col("o_orderkey").alias("file_no"), name.alias("file_name"),
        F.concat_ws("\\", month, week, shelf, name).alias("source_relative"),
    )


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents rewritten as Markdown: headings, captions, images, promotional lines, misspellings."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, index: F.when(index % 9 == 0, F.concat(F.lit("# "), F.substring(line, 1, 20), F.lit("\n"), line))
        .when(index % 9 == 3, F.concat(F.lit("## "), F.substring(line, 1, 15), F.lit("\nn point: efect of diferent ofers\n"), line))
        .when(index % 9 == 5, F.concat(F.lit("Exhibit "), index.cast("string"), F.lit(" efect\n![](images/"), index.cast("string"), F.lit(".jpg)\n"), line))
        .when(index % 9 == 7, F.concat(F.lit(fixed.PROMO_PHRASES[3]), F.lit("\n![](images/code.jpg)\n\n"), line))
        .otherwise(line),
    )
    documents = spread(text_documents(spark, folder).select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", F.array_join(lines, "\n").alias("text"))
