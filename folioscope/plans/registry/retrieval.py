"""Search over the text documents: statistics, BM25, vectors, fusion, analysis, context."""

from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.records import sub_query_lines
from ...functions.text import INDEX_TOKEN, all_matches, folded
from ...operators import inverted, retrieval, search, vectors
from ...operators.filters import Filters
from ...sources import tables as t
from . import REGISTRY
from .views import CHUNKS, DENSE, DOCS, FUSED, LEXICAL, POSTINGS, TOKEN


@REGISTRY.add("term_df", f"WITH {CHUNKS}, {POSTINGS} SELECT term, df FROM dfs")
def term_df(spark, sf):
    return search.term_statistics(t.text_index(spark, sf))


@REGISTRY.add("corpus_stats", f"WITH {CHUNKS}, {POSTINGS} SELECT n AS n_chunks, round(avgdl, 6) AS avg_len FROM corpus")
def corpus_stats(spark, sf):
    corpus = search.corpus_statistics(t.text_index(spark, sf))
    return corpus.select("n_chunks", F.round("avg_len", 6).alias("avg_len"))


def _lexical(spark, sf, limit=fixed.ROUTE_TOPK):
    return search.lexical_search(t.text_index(spark, sf), t.text_queries(spark, sf), limit)


@REGISTRY.add(
    "bm25_top",
    f"WITH {CHUNKS}, {POSTINGS}, {LEXICAL.format(limit=40)} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM lexical",
)
def bm25_top(spark, sf):
    return _lexical(spark, sf)


def _eligible(spark, sf):
    return Filters(date_from="2024-03-01", institution="SRC1", lang="en").apply(t.text_documents(spark, sf)).select("doc_id")


@REGISTRY.add(
    "bm25_filtered",
    f"""WITH {DOCS}, {CHUNKS}, {POSTINGS}, {LEXICAL.replace('FROM scored)', '''FROM scored WHERE split_part(chunk_id, '#', 1) IN (
  SELECT doc_id FROM docs WHERE report_date >= DATE '2024-03-01' AND lower(institution) LIKE '%src1%' AND lang = 'en'))''').format(limit=40)}
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM lexical""",
)
def bm25_filtered(spark, sf):
    index = t.text_index(spark, sf)
    eligible = index.join(_eligible(spark, sf), "doc_id", "left_semi")
    return search.lexical_search(index, t.text_queries(spark, sf), eligible=eligible)


@REGISTRY.add(
    "bm25_postings",
    f"WITH {CHUNKS}, {POSTINGS}, {LEXICAL.format(limit=40)} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM lexical",
)
def bm25_postings(spark, sf):
    """All queries answered from the stored postings."""
    return inverted.ranked(t.text_postings(spark, sf), t.text_queries(spark, sf))


@REGISTRY.add(
    "phrase_hits",
    f"""WITH {CHUNKS}, phrases AS (
  SELECT DISTINCT toks[1] || ' ' || toks[2] AS phrase FROM (
    SELECT list_transform(regexp_extract_all(strip_accents(text), '{TOKEN}'), lambda x: lower(x)) AS toks FROM benchmark) WHERE len(toks) > 1 AND toks[1] <> toks[2]
), folded AS (
  SELECT doc_id, ' ' || array_to_string(list_transform(regexp_extract_all(strip_accents(text), '{TOKEN}'), lambda x: lower(x)), ' ') || ' ' AS toks FROM chunks
)
SELECT DISTINCT phrase, doc_id FROM phrases JOIN folded ON contains(toks, ' ' || phrase || ' ')""",
)
def phrase_hits(spark, sf):
    words = t.text_queries(spark, sf).select(all_matches(F.col("text"), INDEX_TOKEN).alias("w"))
    keywords = words.where((F.size("w") > 1) & (folded(F.get("w", F.lit(0))) != folded(F.get("w", F.lit(1)))))
    keywords = keywords.select(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("keyword")).distinct()
    return inverted.phrase_documents(t.text_postings(spark, sf), search.keyword_phrases(keywords))


FIRST_VECTOR = "(SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) FROM embeddings)"


def _knn_sql(condition: str) -> str:
    return f"""SELECT chunk_id, distance, CAST(row_number() OVER (ORDER BY distance, chunk_id) - 1 AS INTEGER) AS rank FROM (
  SELECT vec_id || '#0' AS chunk_id, round(list_distance(CAST(embedding AS DOUBLE[]), {FIRST_VECTOR}), 6) AS distance
  FROM embeddings {condition} ORDER BY distance, chunk_id LIMIT 40)"""


def _first_vector(spark, sf):
    return t.table(spark, sf, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0]


@REGISTRY.add("dense_knn", _knn_sql(""))
def dense_knn(spark, sf):
    return vectors.nearest(t.chunk_vectors(spark, sf), _first_vector(spark, sf))


@REGISTRY.add("dense_knn_filtered", _knn_sql("WHERE label IN (1, 3, 5)"))
def dense_knn_filtered(spark, sf):
    chosen = t.chunk_vectors(spark, sf).where(F.col("label").isin(1, 3, 5))
    return vectors.nearest(chosen, _first_vector(spark, sf))


def _dense(spark, sf):
    return vectors.dense_search(t.chunk_vectors(spark, sf), t.query_vectors(spark, sf))


@REGISTRY.add("dense_batch", f"WITH {DENSE} SELECT query_id, chunk_id, distance, CAST(rank AS INTEGER) AS rank FROM dense")
def dense_batch(spark, sf):
    return _dense(spark, sf)


@REGISTRY.add(
    "hybrid_rrf",
    f"""WITH {CHUNKS}, {POSTINGS}, {LEXICAL.format(limit=40)}, {DENSE}, {FUSED.format(limit=30)}
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, score, CAST(bm25_rank AS INTEGER) AS bm25_rank,
       CAST(dense_rank AS INTEGER) AS dense_rank FROM fused""",
)
def hybrid_rrf(spark, sf):
    return search.fuse_ranks(_lexical(spark, sf), _dense(spark, sf))


WITHIN = """(SELECT doc_id FROM docs WHERE report_date >= DATE '2024-03-01' AND lower(institution) LIKE '%src1%' AND lang = 'en')"""
LEXICAL_WITHIN = LEXICAL.replace("FROM scored)", f"FROM scored WHERE split_part(chunk_id, '#', 1) IN {WITHIN})")
DENSE_WITHIN = DENSE.replace(
    "WHERE q.vec_id IN (SELECT item_id FROM benchmark)",
    f"WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND CAST(v.vec_id AS VARCHAR) IN {WITHIN}")


def _retrieved(spark, sf, mode):
    vectors_of = t.chunk_vectors(spark, sf).withColumn("doc_id", F.substring_index("chunk_id", "#", 1))
    # The vector route reads no postings, so none are built for it.
    index = None if mode == "vector" else t.text_postings(spark, sf)
    return retrieval.retrieve(
        index, vectors_of, t.text_documents(spark, sf), t.text_queries(spark, sf), t.query_vectors(spark, sf),
        Filters(date_from="2024-03-01", institution="SRC1", lang="en"), mode)


@REGISTRY.add(
    "dense_filtered", f"WITH {DOCS}, {DENSE_WITHIN} SELECT query_id, chunk_id, distance, CAST(rank AS INTEGER) AS rank FROM dense")
def dense_filtered(spark, sf):
    return _retrieved(spark, sf, "vector")


@REGISTRY.add(
    "hybrid_filtered",
    f"""WITH {DOCS}, {CHUNKS}, {POSTINGS}, {LEXICAL_WITHIN.format(limit=40)}, {DENSE_WITHIN}, {FUSED.format(limit=30)}
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, score, CAST(bm25_rank AS INTEGER) AS bm25_rank,
       CAST(dense_rank AS INTEGER) AS dense_rank FROM fused""",
)
def hybrid_filtered(spark, sf):
    return _retrieved(spark, sf, "hybrid")


def _fused(spark, sf, limit):
    return search.fuse_ranks(_lexical(spark, sf), _dense(spark, sf), limit)


# An embedding without a chunk of its own is no hit.
HYDRATED = "hits AS (SELECT f.*, c.text, c.doc_id, title, institution, report_date FROM fused f JOIN chunks c USING (chunk_id) JOIN docs USING (doc_id))"


@REGISTRY.add(
    "hybrid_hydrated",
    f"""WITH {DOCS}, {CHUNKS}, {POSTINGS}, {LEXICAL.format(limit=40)}, {DENSE}, {FUSED.format(limit=30)}, {HYDRATED}
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, doc_id, title, institution, report_date, sha256(text) AS text_hash FROM hits""",
)
def hybrid_hydrated(spark, sf):
    hits = search.hydrate(_fused(spark, sf, fixed.FUSED_LIMIT), t.text_index(spark, sf), t.text_documents(spark, sf))
    return hits.select(
        "query_id", "chunk_id", "rank", "doc_id", "title", "institution", "report_date", F.sha2("text", 256).alias("text_hash")
    )


@REGISTRY.add(
    "context_budget",
    f"""WITH {DOCS}, {CHUNKS}, {POSTINGS}, {LEXICAL.format(limit=40)}, {DENSE}, {FUSED.format(limit=12)}, {HYDRATED}, blocks AS (
  SELECT query_id, chunk_id, rank, length('[' || (rank + 1) || '] 出处：' || concat_ws(' > ', nullif(institution, ''), nullif(title, ''),
    strftime(report_date, '%Y-%m-%d')) || chr(10) || trim(text, ' ' || chr(10)) || chr(10)) AS block_chars FROM hits
), summed AS (
  SELECT *, sum(block_chars) OVER w AS used, row_number() OVER w AS ref FROM blocks WINDOW w AS (PARTITION BY query_id ORDER BY rank)
)
SELECT query_id, chunk_id, CAST(ref AS BIGINT) AS ref, CAST(block_chars AS BIGINT) AS block_chars, CAST(used AS BIGINT) AS used_chars
FROM summed WHERE ref = 1 OR used <= 6000""",
)
def context_budget(spark, sf):
    """The twelve best hits of every query, cut at 6,000 characters."""
    hits = search.hydrate(_fused(spark, sf, fixed.ASK_LIMIT), t.text_index(spark, sf), t.text_documents(spark, sf))
    context = search.build_context(hits.withColumn("heading_path", F.lit("")), 6000)
    return context.select(
        "query_id", "chunk_id", *[F.col(name).cast("bigint").alias(name) for name in ("ref", "block_chars", "used_chars")]
    )


# Analyses take sixteen queries each, in order; their lists interleave.
ANALYSES = "analyses AS (SELECT CAST(item_id AS VARCHAR) AS query_id, item_id // 16 AS analysis_id, item_id % 16 AS list_no FROM benchmark)"


@REGISTRY.add(
    "subquery_interleave",
    f"""WITH {CHUNKS}, {POSTINGS}, {LEXICAL.format(limit=10)}, {ANALYSES}, firsts AS (
  SELECT analysis_id, chunk_id, min((rank, list_no)) AS turn FROM lexical JOIN analyses USING (query_id) GROUP BY ALL
), placed AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY turn) AS position FROM firsts)
SELECT CAST(analysis_id AS BIGINT) AS analysis_id, CAST(position AS BIGINT) AS position, chunk_id FROM placed WHERE position <= 72""",
)
def subquery_interleave(spark, sf):
    item = F.col("query_id").cast("bigint")
    lists = _lexical(spark, sf, fixed.PER_SUBQUERY_LIMIT).select(
        F.floor(item / fixed.SUBQUERY_CAP).alias("analysis_id"), (item % fixed.SUBQUERY_CAP).alias("list_no"), "rank", "chunk_id"
    )
    merged = search.interleave(lists)
    return merged.select("analysis_id", F.col("position").cast("bigint").alias("position"), "chunk_id")


@REGISTRY.add(
    "sub_queries",
    """WITH lines AS (
  SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda l: trim(l, ' -·•' || chr(9) || '　')) AS cleaned, role FROM conversations
), whole AS (SELECT conv_id, turn, list_filter(list_concat([role], cleaned), lambda l: l <> '') AS wanted FROM lines),
numbered AS (SELECT conv_id, turn, unnest(wanted) AS line, unnest(range(1, len(wanted) + 1)) AS pos FROM whole),
firsts AS (SELECT conv_id, turn, line, min(pos) AS pos FROM numbered GROUP BY ALL)
SELECT conv_id, turn, line, CAST(place AS BIGINT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS place FROM firsts) WHERE place <= 16""",
)
def sub_queries(spark, sf):
    """Every turn read as an answer with one sub-query per line; its role stands for the question."""
    turns = t.table(spark, sf, "conversations")
    lines = turns.select("conv_id", "turn", F.posexplode(sub_query_lines(F.col("text"), F.col("role"))).alias("pos", "line"))
    return lines.select("conv_id", "turn", "line", (F.col("pos") + 1).cast("bigint").alias("place"))
