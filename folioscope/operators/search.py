"""Ranked retrieval: token index, postings, BM25, phrase hits, fusion, interleaving, budgets.

Queries are a DataFrame (query_id, text), so one plan answers any number of them.
The index is a chunk table with two more columns: `tokens` (folded tokens joined by one
blank) and `chunk_len` (how many there are).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.text import INDEX_TOKEN, all_matches, folded, index_token_string, query_tokens

# Query-term weights one scan holds: a million rows are a few tens of megabytes.
WEIGHT_BLOCK = 1_000_000
# Cells of the dense chunk-by-term block a task scores at a time (32 MB).
SCORE_CELLS = 4_000_000
_SCORED = "query_id string, chunk_id string, score double"


def with_tokens(chunks: DataFrame, text: str = "text") -> DataFrame:
    tokens = chunks.withColumn("tokens", index_token_string(F.col(text)))
    blanks = F.length("tokens") - F.length(F.replace("tokens", F.lit(" "), F.lit("")))
    return tokens.withColumn("chunk_len", F.when(F.col("tokens") == "", 0).otherwise(blanks + 1))


def build_postings(index: DataFrame) -> DataFrame:
    """(chunk_id, chunk_len, term, tf). Counting starts before the shuffle, inside each chunk's task."""
    tokens = index.where(F.col("chunk_len") > 0).select(
        "chunk_id", "chunk_len", F.explode(F.split("tokens", " ")).alias("term")
    )
    return tokens.groupBy("chunk_id", "chunk_len", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term, weight): spellings that fold to the same term add up."""
    raw = queries.select("query_id", F.explode(query_tokens(F.col(text))).alias("token"))
    terms = raw.select("query_id", F.explode(all_matches(folded(F.col("token")), INDEX_TOKEN)).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def term_statistics(index: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(term, df). A term in a third of all chunks is counted down inside every task first."""
    terms = index.where(F.col("chunk_len") > 0).select(
        F.explode(F.array_distinct(F.split("tokens", " "))).alias("term")
    )
    if vocabulary is not None:
        terms = terms.join(vocabulary.select("term").distinct(), "term", "left_semi")
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("n_chunks"), (F.sum("chunk_len") / F.count("*")).alias("avg_len")
    )


def inverse_document_frequency(n_chunks: Column, df: Column) -> Column:
    idf = F.log((n_chunks - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, fixed.BM25_MIN_IDF).otherwise(idf)


def term_weights(wanted: DataFrame, statistics: DataFrame, n_chunks: Column) -> DataFrame:
    """(query_id, term, idf), the idf times the query's own weight of the term."""
    idf = F.col("weight") * inverse_document_frequency(n_chunks, F.col("df"))
    return wanted.join(statistics, "term").select("query_id", "term", idf.alias("idf"))


def bm25_from_postings(
    postings: DataFrame, index: DataFrame, queries: DataFrame, eligible: DataFrame | None = None
) -> DataFrame:
    """(query_id, chunk_id, score) for a few queries, touching only their terms' postings.

    Stored postings are ordered by term, so the scan skips files without a wanted term.
    Statistics always describe the whole index; `eligible` only narrows what is scored.
    """
    wanted = query_terms(queries)
    matching = postings.join(wanted.select("term").distinct(), "term", "left_semi")
    corpus = corpus_statistics(index)
    n_chunks, avg_len = corpus.select("n_chunks").scalar(), corpus.select("avg_len").scalar()
    weights = term_weights(wanted, matching.groupBy("term").agg(F.count("*").alias("df")), n_chunks)
    if eligible is not None:
        matching = matching.join(eligible.select("chunk_id"), "chunk_id", "left_semi")
    tf, k1, b = F.col("tf"), fixed.BM25_K1, fixed.BM25_B
    saturated = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("chunk_len") / avg_len))
    return (
        matching.join(weights, "term")
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(F.col("idf") * saturated), 6).alias("score"))
    )


def keep_best(best: pd.DataFrame, limit: int, descending: bool) -> pd.DataFrame:
    """Top rows per query of (query, chunk_id, value), ties by chunk_id."""
    ordered = best.sort_values(["query", "value", "chunk_id"], ascending=[True, not descending, True])
    return ordered.groupby("query", sort=False).head(limit)


class BestRows:
    """Top rows per query (query, chunk_id, value) of score blocks that come one after another, ties by chunk_id."""

    def __init__(self, queries: int, limit: int) -> None:
        self.floor, self.limit, self.rows = np.full(queries, -np.inf), limit, None

    def add(self, chunk_ids: np.ndarray, exact: np.ndarray) -> None:
        """Takes in a block of chunks x queries."""
        rounded, limit = np.round(exact, 6), self.limit
        # Rows that tie with the last place stay, so that ids can settle it.
        edge = self.floor
        if len(rounded) > limit:
            edge = np.maximum(edge, np.partition(rounded, len(rounded) - limit, axis=0)[len(rounded) - limit])
        hit_row, hit_query = np.nonzero((exact > 0) & (rounded >= edge[None, :]))
        if not len(hit_row):
            return
        found = pd.DataFrame({"query": hit_query, "chunk_id": chunk_ids[hit_row], "value": rounded[hit_row, hit_query]})
        self.rows = keep_best(found if self.rows is None else pd.concat([self.rows, found]), limit, descending=True)
        full = self.rows.groupby("query")["value"].agg(["size", "min"])
        full = full[full["size"] >= limit]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()


def _scan_block(index: DataFrame, block: pd.DataFrame, avg_len: float, limit: int) -> DataFrame:
    """Scores every chunk in its own task against one block of queries."""
    query_codes, query_ids = pd.factorize(block["query_id"])
    term_codes, terms = pd.factorize(block["term"])
    shared = index.sparkSession.sparkContext.broadcast(
        (list(query_ids), {term: code for code, term in enumerate(terms)}, query_codes, term_codes,
         block["idf"].to_numpy(dtype="float64"))
    )
    k1, b = fixed.BM25_K1, fixed.BM25_B

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vocabulary, of_query, of_term, idf = shared.value
        weights = np.zeros((len(vocabulary), len(ids)))
        weights[of_term, of_query] = idf
        rows_at_once = max(64, SCORE_CELLS // max(1, len(vocabulary)))
        best = BestRows(len(ids), limit)
        for batch in batches:
            for first in range(0, len(batch), rows_at_once):
                part = batch.iloc[first : first + rows_at_once]
                split = [text.split(" ") for text in part["tokens"]]
                sizes = np.fromiter((len(tokens) for tokens in split), dtype=np.int64, count=len(split))
                codes = np.array([vocabulary.get(token, -1) for tokens in split for token in tokens], dtype=np.int64)
                rows = np.repeat(np.arange(len(split)), sizes)[codes >= 0]
                codes = codes[codes >= 0]
                if not len(codes):
                    continue
                cells, tf = np.unique(rows * len(vocabulary) + codes, return_counts=True)
                row, term = np.divmod(cells, len(vocabulary))
                length = part["chunk_len"].to_numpy(dtype="float64")[row]
                used, column = np.unique(term, return_inverse=True)
                dense = np.zeros((len(split), len(used)))
                dense[row, column] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
                exact = dense @ weights[used]
                best.add(part["chunk_id"].to_numpy(), exact)
        if best.rows is not None:
            yield pd.DataFrame(
                {"query_id": [ids[code] for code in best.rows["query"]], "chunk_id": best.rows["chunk_id"].to_numpy(),
                 "score": best.rows["value"].to_numpy()}
            )

    return index.select("chunk_id", "chunk_len", "tokens").mapInPandas(score, _SCORED)


def blocks_of(frame: DataFrame, key: str, rows: int, block: int) -> list[DataFrame]:
    """The frame as it is, or split by key hash into pieces of about half a block each."""
    if rows <= block:
        return [frame]
    pieces = -(-rows // (block // 2))
    return [frame.where(F.pmod(F.xxhash64(key), F.lit(pieces)) == piece) for piece in range(pieces)]


def lexical_search(
    index: DataFrame, queries: DataFrame, limit: int = fixed.ROUTE_TOPK, eligible: DataFrame | None = None
) -> DataFrame:
    """BM25 top rows for many queries: one pass for statistics, one for scores.

    A term that most chunks hold would pair every chunk with every query, so the pairs are
    never formed: each task scores its own chunks and returns only its top rows. The
    shuffle holds tasks x queries x limit rows. The query side is counted before it
    is shared; beyond one block, blocks of queries take one scan each.
    """
    from ..session import checkpointed

    slim = queries.select(F.col("query_id").cast("string").alias("query_id"), "text")
    wanted = query_terms(slim)
    n_chunks, avg_len = corpus_statistics(index).first()
    weights = checkpointed(term_weights(wanted, term_statistics(index, wanted), F.lit(n_chunks)))
    candidates = index if eligible is None else index.join(eligible.select("chunk_id"), "chunk_id", "left_semi")
    scans = []
    for block in blocks_of(weights, "query_id", weights.count(), WEIGHT_BLOCK):
        held = block.toPandas()
        if len(held):
            scans.append(_scan_block(candidates, held, float(avg_len), limit))
    merged = reduce(DataFrame.unionByName, scans) if scans else index.sparkSession.createDataFrame([], _SCORED)
    return top_ranked(merged, [F.desc("score")], limit)


def top_ranked(scored: DataFrame, order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """0-based rank within each query; Spark prunes to the limit before it shuffles."""
    window = Window.partitionBy("query_id").orderBy(*order, F.col("chunk_id"))
    return (
        scored.withColumn(rank, F.row_number().over(window))
        .where(F.col(rank) <= limit)
        .withColumn(rank, (F.col(rank) - 1).cast("int"))
    )


def fuse_ranks(lexical: DataFrame, dense: DataFrame, limit: int = fixed.FUSED_LIMIT) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per query, ties by chunk_id."""
    first = lexical.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    second = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (fixed.RRF_K + F.col(rank)), F.lit(0.0))

    merged = first.join(second, ["query_id", "chunk_id"], "full_outer").withColumn(
        "score", F.round(share("bm25_rank") + share("dense_rank"), 9)
    )
    return top_ranked(merged, [F.desc("score")], limit)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Ranked hits with their chunk text and document metadata."""
    return hits.join(chunks, "chunk_id").join(
        documents.select("doc_id", "title", "institution", "category", "report_date"), "doc_id"
    )


def interleave(hits: DataFrame, cap: int = fixed.INTERLEAVE_CAP) -> DataFrame:
    """Round-robin over the lists of one analysis: (analysis_id, list_no, rank, chunk_id).

    A chunk counts where it first turns up; the cap is per analysis.
    """
    firsts = hits.groupBy("analysis_id", "chunk_id").agg(F.min(F.struct("rank", "list_no")).alias("turn"))
    window = Window.partitionBy("analysis_id").orderBy("turn")
    return (
        firsts.withColumn("position", F.row_number().over(window))
        .where(F.col("position") <= cap)
        .select(
            "analysis_id", "position", "chunk_id",
            F.col("turn.rank").alias("rank"), F.col("turn.list_no").alias("list_no"),
        )
    )


def context_block(ref: Column) -> Column:
    """Numbered source block of one hit."""
    parts = [F.nullif(F.col(name).cast("string"), F.lit("")) for name in
             ("institution", "title", "report_date", "heading_path")]
    head = F.concat_ws(" > ", *parts)
    source = F.when(head == "", F.col("doc_id").cast("string")).otherwise(head)
    body = F.regexp_replace(F.col("text"), r"(?U)^\s+|\s+$", "")
    return F.concat(F.lit("["), ref.cast("string"), F.lit("] 出处："), source, F.lit("\n"), body, F.lit("\n"))


def within_budget(blocks: DataFrame, keys: list[str], order: str, length: str, budget: int) -> DataFrame:
    """Leading rows per key whose running length fits; the first row always stays.

    Lengths are positive, so the running sum crosses the budget once and stays over it.
    """
    window = Window.partitionBy(*keys).orderBy(order)
    running = F.sum(length).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return (
        blocks.withColumn("used_chars", running)
        .withColumn("ref", F.row_number().over(window))
        .where((F.col("ref") == 1) | (F.col("used_chars") <= budget))
    )


def build_context(hits: DataFrame, budget: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """Numbered blocks per query, cut at the character budget. Expects hydrated hits."""
    numbered = hits.withColumn("block", context_block(F.col("rank") + 1))
    sized = numbered.withColumn("block_chars", F.length("block"))
    return within_budget(sized, ["query_id"], "rank", "block_chars", budget)


def keyword_phrases(keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """Adds the folded phrase of each keyword and its leading word pair; keywords without tokens go."""
    phrase = F.array_join(
        F.flatten(
            F.transform(query_tokens(F.col(keyword)), lambda token: all_matches(folded(token), INDEX_TOKEN))
        ),
        " ",
    )
    return keywords.withColumn("phrase", phrase).where(F.col("phrase") != "").withColumn(
        "lead", F.substring_index("phrase", " ", 2)
    )


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Distinct (phrase, doc_id) where a chunk holds the phrase's tokens side by side.

    Chunks and phrases meet on single words and adjacent word pairs; only phrases of
    three words and more need a look at the neighbours that follow.
    """
    wanted = phrases.select("phrase", "lead").distinct()
    words = F.split("tokens", " ")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    leads = index.where(F.col("chunk_len") > 0).select(
        "doc_id", "tokens", F.explode(F.array_distinct(F.concat(words, F.array_compact(pairs)))).alias("lead")
    )
    adjacent = (F.col("phrase") == F.col("lead")) | F.concat(F.lit(" "), "tokens", F.lit(" ")).contains(
        F.concat(F.lit(" "), "phrase", F.lit(" "))
    )
    return leads.join(wanted, "lead").where(adjacent).select("phrase", "doc_id").distinct()
