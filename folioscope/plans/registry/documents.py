"""Cleaning, chunking, language, file names: one row per document or chunk."""

import datetime as dt

from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.dates import date_reason, iso_from_yymmdd
from ...functions.names import parsed_name
from ...functions.text import detect_language, estimated_tokens, index_tokens, raw_tokens, slug, windows
from ...operators import chunking, cleaning
from ...operators.filters import Filters
from ...plans.catalog import describe_files
from ...sources import tables as t
from . import REGISTRY
from .views import CHUNKS, DOCS, RAW_TOKEN, TOKEN, markdown, quoted, repaired

TODAY = dt.date(2000, 1, 1)


@REGISTRY.add(
    "doc_filter",
    f"""WITH {DOCS} SELECT doc_id, institution, lang, report_date, char_count FROM docs
WHERE report_date >= DATE '2024-02-01' AND report_date <= DATE '2024-10-31' AND lower(institution) LIKE '%src1%' AND category = 'foreign' AND lang = 'en'""",
)
def doc_filter(spark, sf):
    wanted = Filters("2024-02-01", "2024-10-31", "SRC1", "foreign", None, "en")
    return wanted.apply(t.text_documents(spark, sf)).select("doc_id", "institution", "lang", "report_date", "char_count")


@REGISTRY.add(
    "lang_detect",
    """WITH counted AS (
  SELECT doc_id, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS cjk,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM (
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, 'e', '研报', 'g') WHEN doc_id % 7 = 1 THEN '12 34' ELSE text END AS text
    FROM documents))
SELECT doc_id, CASE WHEN cjk + latin = 0 THEN 'und' WHEN cjk::DOUBLE / (cjk + latin) >= 0.2 THEN 'zh' ELSE 'en' END AS lang FROM counted""",
)
def lang_detect(spark, sf):
    """Every third document gets CJK words for one of its letters, some keep digits only."""
    mixed = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("研报"))).when(
        F.col("doc_id") % 7 == 1, "12 34"
    ).otherwise(F.col("text"))
    return t.table(spark, sf, "documents").select("doc_id", detect_language(mixed).alias("lang"))


@REGISTRY.add(
    "token_estimate",
    "SELECT doc_id, greatest(1, CAST(floor(length(text) / 1.6::DOUBLE) AS INTEGER)) AS token_est FROM documents",
)
def token_estimate(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", estimated_tokens(F.length("text")).alias("token_est"))


@REGISTRY.add(
    "chunk_windows",
    """SELECT doc_id, CAST(s // 1408 AS BIGINT) AS piece, CAST(length(substr(text, CAST(s AS INTEGER) + 1, 1600)) AS BIGINT) AS n_chars,
       sha256(substr(text, CAST(s AS INTEGER) + 1, 1600)) AS text_hash
FROM documents, generate_series(0, greatest(length(text) - 1, 0), 1408) AS g(s)""",
)
def chunk_windows(spark, sf):
    pieces = t.table(spark, sf, "documents").select("doc_id", F.posexplode(windows(F.col("text"))).alias("piece", "text"))
    return pieces.select(
        "doc_id", F.col("piece").cast("bigint").alias("piece"), F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("text", 256).alias("text_hash"),
    )


@REGISTRY.add(
    "chunk_documents",
    f"""WITH {CHUNKS} SELECT chunk_id, doc_id, CAST(seq AS BIGINT) AS seq, char_start, char_end,
CAST(greatest(1, floor(length(text) / 1.6::DOUBLE)) AS BIGINT) AS token_est, sha256(text) AS text_hash FROM chunks""",
)
def chunk_documents(spark, sf):
    long = [F.col(name).cast("bigint").alias(name) for name in ("seq", "char_start", "char_end", "token_est")]
    return t.text_chunks(spark, sf).select("chunk_id", "doc_id", *long, F.sha2("text", 256).alias("text_hash"))


@REGISTRY.add(
    "tokenize_stats",
    f"""SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct, len(regexp_extract_all(text, '{RAW_TOKEN}')) AS n_raw,
       sha256(array_to_string(toks, ' ')) AS token_hash
FROM (SELECT doc_id, text, list_transform(regexp_extract_all(strip_accents(text), '{TOKEN}'), lambda x: lower(x)) AS toks FROM documents)""",
)
def tokenize_stats(spark, sf):
    tokens = t.table(spark, sf, "documents").select("doc_id", "text", index_tokens(F.col("text")).alias("toks"))
    return tokens.select(
        "doc_id", F.size("toks").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("toks")).cast("bigint").alias("n_distinct"),
        F.size(raw_tokens(F.col("text"))).cast("bigint").alias("n_raw"),
        F.sha2(F.array_join("toks", " "), 256).alias("token_hash"),
    )


PROMO = quoted(fixed.PROMO_PHRASES[3])
# Lines numbered; promotional lines and blanks go, and so does the image after a promotional line.
CLEANED = f"""{markdown()}, split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM marked
), judged AS (
  SELECT *, line = {PROMO} AS promo,
         regexp_matches(line, '^\\s*!?\\[[^\\]]*\\]\\(images/[^)]+\\)\\s*$') AND coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) = {PROMO}, false) AS badge
  FROM split
), fixed_lines AS (
  SELECT *, CASE WHEN regexp_matches(line, '^\\s*(Exhibit|Figure|Table)\\s*[0-9]') OR regexp_matches(line, '^\\s*!\\[') THEN line
    ELSE {repaired("regexp_replace(line, '^n[ ]+', '- ')")} END AS repaired
  FROM judged WHERE NOT promo AND NOT badge AND trim(line) <> ''
)"""


@REGISTRY.add(
    "markdown_clean",
    f"""WITH {CLEANED}, texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS body, max(line_no) AS last_kept FROM fixed_lines GROUP BY doc_id
), totals AS (SELECT doc_id, max(line_no) AS n, count(*) FILTER (promo OR badge) AS changes FROM judged GROUP BY doc_id)
SELECT doc_id, sha256(body || CASE WHEN last_kept < n THEN chr(10) ELSE '' END) AS text_hash, changes FROM texts JOIN totals USING (doc_id)""",
)
def markdown_clean(spark, sf):
    return t.markdown_documents(spark, sf).select(
        "doc_id", F.sha2(cleaning.clean_markdown(F.col("text")), 256).alias("text_hash"),
        cleaning.clean_change_count(F.col("text")).cast("bigint").alias("changes"),
    )


@REGISTRY.add(
    "markdown_repair",
    f"""WITH {CLEANED}, texts AS (
  SELECT doc_id, string_agg(repaired, chr(10) ORDER BY line_no) AS body, max(line_no) AS last_kept,
         sum(CASE WHEN repaired <> line THEN 1 ELSE 0 END) AS changed FROM fixed_lines GROUP BY doc_id
), totals AS (SELECT doc_id, max(line_no) AS n FROM judged GROUP BY doc_id),
words AS (SELECT doc_id, sum(CASE WHEN repaired <> line THEN length(repaired) - length(regexp_replace(line, '^n[ ]+', '- ')) ELSE 0 END) AS words FROM fixed_lines GROUP BY doc_id)
SELECT doc_id, sha256(body || CASE WHEN last_kept < n THEN chr(10) ELSE '' END) AS text_hash, CAST(words + changed AS BIGINT) AS changes
FROM texts JOIN totals USING (doc_id) JOIN words USING (doc_id)""",
)
def markdown_repair(spark, sf):
    cleaned = t.markdown_documents(spark, sf).withColumn("text", cleaning.clean_markdown(F.col("text")))
    return cleaned.select(
        "doc_id", F.sha2(cleaning.repair_lines(F.col("text")), 256).alias("text_hash"),
        cleaning.repair_change_count(F.col("text")).cast("bigint").alias("changes"),
    )


# Levels are one and two only: a path is the last first-level title plus, below it, the last second-level one.
SECTIONS = f"""{markdown()}, split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM marked
), levels AS (
  SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}[ \\t]+') THEN length(regexp_extract(line, '^#+')) END AS level,
         trim(regexp_replace(line, '^#+[ \\t]+', '')) AS title FROM split
), numbered AS (
  SELECT *, count(level) OVER w AS section,
         last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS top_title,
         max(CASE WHEN level = 1 THEN line_no END) OVER w AS top_line,
         last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS sub_title,
         max(CASE WHEN level = 2 THEN line_no END) OVER w AS sub_line,
         sum(length(line) + 1) OVER w AS ends
  FROM levels WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), bodies AS (
  SELECT doc_id, section, max(CASE WHEN level IS NOT NULL THEN ends END) AS char_start,
         any_value(concat_ws(' > ', top_title, CASE WHEN sub_line > coalesce(top_line, 0) THEN sub_title END)) AS heading_path,
         string_agg(line, chr(10) ORDER BY line_no) FILTER (level IS NULL) AS body
  FROM numbered GROUP BY doc_id, section
)"""


@REGISTRY.add(
    "markdown_sections",
    f"""WITH {SECTIONS} SELECT doc_id, heading_path, CAST(coalesce(char_start, 0) AS BIGINT) AS char_start,
sha256(trim(body, ' ' || chr(10))) AS body_hash FROM bodies WHERE trim(body, ' ' || chr(10)) <> ''""",
)
def markdown_sections(spark, sf):
    sections = t.markdown_documents(spark, sf).select("doc_id", F.explode(chunking.split_sections(F.col("text"))).alias("s"))
    return sections.select(
        "doc_id", "s.heading_path", F.col("s.char_start").cast("bigint").alias("char_start"),
        F.sha2(F.trim(F.col("s.body"), F.lit(" \n")), 256).alias("body_hash"),
    )


@REGISTRY.add("markdown_chunks")
def markdown_chunks(spark, sf):
    chunks = chunking.chunk_documents(cleaning.normalize_documents(t.markdown_documents(spark, sf)))
    return chunks.select(
        "chunk_id", "doc_id", "seq", "heading_path", "char_start", "char_end", "token_est",
        F.size("image_refs").alias("images"), F.sha2("text", 256).alias("text_hash"),
    )


@REGISTRY.add(
    "markdown_images",
    f"""WITH {markdown()}, split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM marked
), captioned AS (
  SELECT *, last_value(CASE WHEN regexp_matches(line, '(?i)(?:Exhibit|Figure|Table|图表?|表)\\s*[\\d\\-.]+') THEN trim(line) END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY line_no) AS caption FROM split
)
SELECT doc_id, regexp_extract(line, '\\((images/[^)]+)\\)', 1) AS path, caption, count(*) AS n FROM captioned
WHERE regexp_matches(line, '!\\[[^\\]]*\\]\\(images/[^)]+\\)') GROUP BY ALL""",
)
def markdown_images(spark, sf):
    images = t.markdown_documents(spark, sf).select("doc_id", F.explode(chunking.collect_images(F.col("text"))).alias("i"))
    return images.groupBy("doc_id", "i.path", "i.caption").agg(F.count("*").alias("n"))


ARCHIVE = """orders_named AS (
  SELECT o_orderkey AS k, strftime(o_orderdate, '%y%m%d') AS stamp, CAST(o_orderdate AS DATE) AS d,
         lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS code, '机构' || o_custkey % 40 AS firm,
         '行业跟踪' || o_orderpriority AS subject, o_custkey FROM orders
), parsed AS (
  SELECT k, d,
    CASE k % 6 WHEN 0 THEN firm WHEN 1 THEN firm WHEN 2 THEN firm WHEN 3 THEN '未知' WHEN 4 THEN '要点：增长' ELSE 'Bank ' || o_custkey % 7 END AS institution,
    CASE k % 6 WHEN 0 THEN subject || '（' || code || '）' WHEN 1 THEN subject WHEN 2 THEN '增长+18%' WHEN 3 THEN '随笔' || k
               WHEN 4 THEN subject ELSE 'Outlook ' || subject END AS title,
    CASE k % 6 WHEN 3 THEN NULL WHEN 4 THEN '991332' ELSE stamp END AS yymmdd,
    CASE k % 6 WHEN 0 THEN code END AS stock_code,
    CASE k % 6 WHEN 1 THEN CAST(k % 90 + 1 AS INTEGER) END AS page_count,
    CASE k % 6 WHEN 3 THEN '机构未能从文件名解析' WHEN 4 THEN '机构解析存疑（疑似含标题）' END AS reason
  FROM orders_named
), dated AS (
  SELECT *, CASE WHEN k % 6 IN (3, 4) OR d < DATE '2000-01-01' THEN NULL ELSE d END AS report_date,
         CASE k % 3 WHEN 0 THEN '国内券商报告' WHEN 1 THEN '投行报告' END AS category,
         '第' || ['一', '二', '三', '四', '五'][k % 5 + 1] || '周' AS week, year(d) || '年' || month(d) || '月' AS month
  FROM parsed
)"""


@REGISTRY.add(
    "filename_parse",
    f"""WITH {ARCHIVE} SELECT k AS file_no, institution, title, yymmdd, stock_code, page_count, reason,
CASE WHEN report_date IS NULL THEN NULL ELSE strftime(report_date, '%Y-%m-%d') END AS iso_date FROM dated""",
)
def filename_parse(spark, sf):
    parsed = t.archive_names(spark, sf).select("file_no", parsed_name(F.col("file_name")).alias("p"))
    return parsed.select("file_no", "p.*", iso_from_yymmdd(F.col("p.yymmdd")).alias("iso_date"))


@REGISTRY.add(
    "catalog_rows",
    f"""WITH {ARCHIVE} SELECT k AS file_no, institution, title, category, report_date, week, month, stock_code, page_count,
nullif(concat_ws('; ', reason, CASE WHEN report_date IS NULL THEN 'report_date 未能解析'
  WHEN report_date > DATE '{TODAY}' + 7 THEN 'report_date 为未来日期（' || strftime(report_date, '%Y-%m-%d') || '），疑似文件名年份手误' END,
  CASE WHEN category IS NULL THEN 'category 未能从路径匹配' END), '') AS review_reason,
(reason IS NOT NULL OR report_date IS NULL OR report_date > DATE '{TODAY}' + 7 OR category IS NULL) AS needs_review FROM dated""",
)
def catalog_rows(spark, sf):
    return describe_files(t.archive_names(spark, sf), TODAY).drop("file_name", "source_relative")


@REGISTRY.add(
    "date_reasons",
    f"""WITH dated AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m') || '-32' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders)
SELECT o_orderkey, CASE WHEN iso IS NULL THEN 'report_date 未能解析' WHEN TRY_CAST(iso AS DATE) IS NULL OR iso LIKE '%/%' THEN 'report_date 格式非法'
  WHEN TRY_CAST(iso AS DATE) > DATE '{TODAY}' + 7 THEN 'report_date 为未来日期（' || iso || '），疑似文件名年份手误' END AS reason FROM dated""",
)
def date_reasons(spark, sf):
    key = F.col("o_orderkey") % 5
    iso = (
        F.when(key == 0, F.lit(None).cast("string"))
        .when(key == 1, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(key == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-32")))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    dated = t.table(spark, sf, "orders").select("o_orderkey", iso.alias("iso"))
    return dated.select("o_orderkey", date_reason(F.col("iso"), TODAY).alias("reason"))


@REGISTRY.add(
    "slugs",
    """SELECT p_partkey, substr(regexp_replace(trim(p_name || ' / ' || p_brand || '!'), '[^A-Za-z0-9_]+', '-', 'g')
       .trim('-'), 1, 40) AS slug FROM part""",
)
def slugs(spark, sf):
    raw = F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))
    return t.table(spark, sf, "part").select("p_partkey", slug(raw).alias("slug"))
