"""Registered queries of the training-data operators, each over its whole table, and their DuckDB texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import shared_dir

from . import conversation_trie, decontamination, fill_in_middle, html_extraction, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, secret_scan, sharding, toxicity, url_filters
from .common import slim, table, whole_text

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = slim(table(spark, folder, "documents"), "doc_id", "text")
    rows = quality_rules.judged(docs, quality_rules.trusted_ids(table(spark, folder, "labels")))
    return rows.select("doc_id", *[f"quality.{name}" for name in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.round("quality.score", 6).alias("score"))


# The host rules, and the globs that decide where none of them fits.
HOST_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
GLOBS = [
    url_filters.Glob("*.adult-**", "block"), url_filters.Glob("*.spam-**", "block"),
    url_filters.Glob("**/login?**", "block"), url_filters.Glob("**utm_source=feed**", "block"),
    url_filters.Glob("*.example.org/**.html", "allow"), url_filters.Glob("**.exe", "block")]

_LIKE = {"*.adult-**": r"^[^/?]*\.adult-", "*.spam-**": r"^[^/?]*\.spam-", "**/login?**": r"/login.",
         "**utm_source=feed**": "utm_source=feed", "*.example.org/**.html": r"^[^/?]*\.example\.org/.*\.html$", "**.exe": r"\.exe$"}


def _glob_choice_sql(column: str) -> str:
    ranked = sorted(GLOBS, key=lambda glob: (-len(glob.pattern), glob.verdict != "block"))
    return "CASE " + " ".join(
        f"WHEN regexp_matches(canonical, '{_LIKE[glob.pattern]}', 's') THEN '{getattr(glob, column)}'" for glob in ranked) + " END"


@query("op1_url_filters", rf"""
WITH parted AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query, contains(coalesce(url, ''), '://') AS whole FROM pages),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
        CASE WHEN whole THEN '.' || host || path || query ELSE '' END AS canonical FROM parted)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        ELSE coalesce({_glob_choice_sql("verdict")}, 'allow') END AS verdict,
    CASE WHEN rule IS NULL THEN {_glob_choice_sql("pattern")} END AS pattern
FROM ruled""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = slim(table(spark, folder, "pages"), "page_id", "url")
    return url_filters.filtered(pages, HOST_RULES, GLOBS).select("page_id", "host", "path", "rule", "verdict", "pattern")


@query("op2_sharding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = slim(table(spark, folder, "documents"), "doc_id", "text")
    slot_map = sharding.balanced_map(docs, f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}")
    rows = sharding.sharded(docs, slot_map).select(
        "doc_id", "virtual_slot", "shard", sharding.row_bytes(whole_text()).alias("size"),
        sharding.text_crc(whole_text()).alias("text_crc32"))
    return sharding.places(rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op3_html_extraction")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pages = html_extraction.extracted(slim(table(spark, folder, "pages"), "page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = slim(table(spark, folder, "documents"), "doc_id", "text")
    rows = toxicity.scored(docs, toxicity.train(docs, table(spark, folder, "labels")))
    return rows.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@query("op5_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_ngram_join", r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
shingled AS MATERIALIZED (
    SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [hash(array_to_string(words, ' '))]
        ELSE [hash(array_to_string(words[i:i + 4], ' ')) FOR i IN range(1, len(words) - 3)] END) AS shingles FROM worded),
sizes AS MATERIALIZED (SELECT doc_id, len(shingles)::BIGINT AS n FROM shingled),
rows AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS shingle FROM shingled),
shared AS MATERIALIZED (
    SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS o FROM rows l JOIN rows r ON l.shingle = r.shingle AND l.doc_id <> r.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.joined(table(spark, folder, "documents"))


@query("op8_mixing", r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per_source AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM per_source),
levels AS (
    SELECT *, row_number() OVER by_cap AS place, (sum(source_size) OVER ())::DOUBLE AS everything,
        (sum(weight) OVER ())::DOUBLE AS all_weight,
        coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cap_before,
        coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS weight_before
    FROM weighed WINDOW by_cap AS (ORDER BY cap::DOUBLE / weight, rank)),
levelled AS (SELECT *, (everything - cap_before) / (all_weight - weight_before) AS level FROM levels),
first_under AS (SELECT place, level FROM levelled WHERE level * weight <= cap ORDER BY place LIMIT 1),
targets AS (
    SELECT source, source_size,
        CASE WHEN place < coalesce((SELECT place FROM first_under), 1000000000) THEN cap::DOUBLE
             ELSE (SELECT level FROM first_under) * weight END AS target
    FROM levelled),
placed AS (
    SELECT s.*, t.source_size, t.target,
        CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
        (row_number() OVER (PARTITION BY s.source ORDER BY s.size, coalesce(s.doc_id, 0) % 16, md5(s.doc_id::VARCHAR), s.doc_id) - 1)::DOUBLE AS place,
        ('0x' || substr(md5('mix-1:' || coalesce(s.source, '') || CASE WHEN s.source IS NULL THEN '?' ELSE '.' END), 1, 8))::BIGINT
            / 4294967296.0::DOUBLE AS shift
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parted AS (SELECT *, rate - floor(rate) AS part FROM placed)
SELECT doc_id, size, source_size, target,
    (size * (floor(rate) + floor((place + 1) * part + shift) - floor(place * part + shift)))::BIGINT AS taken, source
FROM parted""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.sized(slim(table(spark, folder, "documents"), "doc_id", "source", "text"))
    return mixing.copies(rows).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def _spans_sql(rules) -> str:
    parts = []
    for order, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{rule.kind}' AS name, {order} AS kind, {rule.least} AS least,
            regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {rule.group}) AS asked,
            regexp_split_to_array(text, '{pattern}') AS gaps FROM texts""")
    return " UNION ALL ".join(parts)


@query("op9_secret_scan", f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({_spans_sql(secret_scan.RULES)}),
steps AS (
    SELECT doc_id, name, kind, least, unnest(found) AS match, unnest(asked) AS part, unnest(gaps[1:len(found)]) AS gap,
        unnest(range(len(found))) AS i FROM matched WHERE len(found) > 0),
placed AS (
    SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM steps),
spans AS (
    SELECT doc_id, kind, stop - length(match) AS start, name || ':' || (stop - length(match))::BIGINT || ':' || stop::BIGINT AS span
    FROM placed WHERE length(part) >= least),
told AS (
    SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (doc_id)""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = secret_scan.scanned(slim(table(spark, folder, "documents"), "doc_id", "text"))
    base = F.filter("secrets", lambda span: span["kind"] < len(secret_scan.BASE))

    def count(kind: int):
        return F.size(F.filter("secrets", lambda span: span["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.described(base), 256).alias("base_sha256"), secret_scan.described(F.col("secrets")).alias("spans"))


@query("op10_line_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.deduped(slim(table(spark, folder, "documents"), "doc_id", "text"), line_dedup.RUN_WORDS)


@query("op11_lm_scoring")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.scored(table(spark, folder, "documents"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII text, bit by bit; DuckDB has no function for it."""
    table = "list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda one, bit: xor(one >> 1, 3988292384 * (one & 1)))"
    codes = f"[ord(letter)::BIGINT FOR letter IN string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, byte: {table}), 4294967295)"


@query("op12_conversation_trie", f"""
WITH turns AS (
    SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
        strlen(coalesce(text, ''))::BIGINT AS bytes FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32_sql("conv_id::VARCHAR")} % 9 AS h,
        list(key ORDER BY turn NULLS FIRST, key) AS keys, list(bytes ORDER BY turn NULLS FIRST, key) AS bytes FROM turns GROUP BY conv_id),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.keys, [])[1:c.h], c.keys[c.h + 1:]) AS keys,
        list_concat(coalesce(b.bytes, [])[1:c.h], c.bytes[c.h + 1:]) AS bytes FROM own c LEFT JOIN own b ON b.conv_id = c.base),
steps AS (SELECT conv_id, keys, bytes, unnest(range(len(keys) + 1)) AS d FROM rebuilt),
nodes AS (
    SELECT array_to_string(keys[1:d], '') AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(CASE WHEN d > 0 THEN bytes[d] ELSE 0 END) AS bytes,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(keys)), '') AS ends FROM steps GROUP BY ALL),
children AS (SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
told AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
above AS (SELECT *, unnest(range(depth + 1)) AS a FROM told),
sums AS (
    SELECT left(node, 32 * a) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, sha256(t.ends) AS ends_sha256
FROM told t JOIN sums USING (node) LEFT JOIN told p ON t.depth > 0 AND p.node = left(t.node, 32 * (t.depth - 1)::INT)""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.nodes(conversation_trie.rebuilt(table(spark, folder, "conversations")))


@query("op13_fill_in_middle", r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
        sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM documents),
drawn AS (
    SELECT *, len(units)::BIGINT AS n, ('0x' || hash[1:8])::BIGINT AS h1, ('0x' || hash[9:16])::BIGINT AS h2,
        ('0x' || hash[17:24])::BIGINT AS h3, ('0x' || hash[25:32])::BIGINT AS h4 FROM texts),
cut AS (
    SELECT *, coalesce(list_sum([length(unit) FOR unit IN units[:least(h1 % (n + 1), h2 % (n + 1))]]), 0)::BIGINT AS start,
        coalesce(list_sum([length(unit) FOR unit IN units[:greatest(h1 % (n + 1), h2 % (n + 1))]]), 0)::BIGINT AS stop,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
            WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parted AS (
    SELECT *, substring(text, 1, start) AS prefix, substring(text, start + 1, stop - start) AS middle, substring(text, stop + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN start END AS prefix_chars, CASE WHEN form <> 'plain' THEN stop - start END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parted""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = fill_in_middle.transformed(slim(table(spark, folder, "documents"), "doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
