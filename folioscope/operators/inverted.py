"""Ranked and phrase search through a stored positional index.

Postings are rows (term, chunk_id, doc_id, chunk_len, tf, positions, following) in folders by a hash of the term, sorted by
term in runs of about a million words; `following` holds the word after each position, blank at the end. A search joins them on
folder and term, so that only the folders of its terms are read. The terms of a search are counted first and shared where they
fit one block, so that postings meet them where they are stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..session import checkpointed
from .search import SCORE_CELLS, WEIGHT_BLOCK, BestRows, blocks_of, inverse_document_frequency, query_terms, top_ranked

BUCKETS = 8
# Words that a task turns into postings at a time, and rows that it hands over at a time.
BLOCK_TOKENS = 1_000_000
ROWS_AT_ONCE = 50_000
_MADE = "term string, chunk_id string, doc_id string, chunk_len int, tf int, positions array<int>, following array<string>"
_SCORED = "query_id string, chunk_id string, score double"
_GATHERED = "chunk_id string, chunk_len int, numbers binary, tfs binary"
# Postings that a task of a ranked search gathers by chunk at a time.
GATHERED_ROWS = 500_000
# Chunks whose postings one task of a ranked search gathers, and queries that it scores at a time.
TASK_CHUNKS = 20_000
QUERY_BLOCK = 256
# Documents of a filter that are shared with every task; more meet the postings by shuffle.
DOCUMENT_BLOCK = 500_000
_TERM = ["bucket", "term"]
# Rows of query terms or phrases that are shared with every task; more are joined by shuffle.
TERM_BLOCK = 200_000


class Index(NamedTuple):
    """postings; terms (bucket, term, df); documents (doc_id, n_chunks, total_len)."""

    postings: DataFrame
    terms: DataFrame
    documents: DataFrame


def bucket_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def positional_postings(chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """Postings of a chunk table with tokens, made by each task of its own chunks, block by block: no posting is shuffled.
    `parts` deals the chunks out first. Where chunks repeat, their words of a term are merged."""
    key = ["chunk_id", "doc_id", "chunk_len"]
    held = chunks.where(F.col("chunk_len") > 0).select(
        "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_len").cast("int").alias("chunk_len"), "tokens")
    repeats = not chunks.groupBy(*key).count().where("count > 1").isEmpty()
    if parts is not None or repeats:
        held = held.repartition(*([] if parts is None else [parts]), "chunk_id")
    if repeats:
        held = held.sortWithinPartitions(*key)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words = [], 0
        for batch in batches:
            block.append(batch)
            words += pc.sum(batch.column("chunk_len")).as_py() or 0
            if words < BLOCK_TOKENS:
                continue
            whole = pa.Table.from_batches(block).combine_chunks()
            # Repeats of the last chunk may follow in the next batch.
            cut = int(np.flatnonzero(_opens(whole, key))[-1]) if repeats else len(whole)
            if cut:
                yield from _block_postings(whole.slice(0, cut), key)
                block, words = whole.slice(cut).to_batches(), 0
        if block:
            yield from _block_postings(pa.Table.from_batches(block), key)

    return held.mapInArrow(made, _MADE).select("*", bucket_of("term"))


def _opens(rows: pa.Table, key: list[str]) -> np.ndarray:
    """Whether a row's key differs from that of the row before it; nulls are alike."""
    opens = np.zeros(len(rows), dtype=bool)
    opens[:1] = True
    for name in key:
        codes = rows.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        opens[1:] |= codes[1:] != codes[:-1]
    return opens


def _block_postings(block: pa.Table, key: list[str]) -> Iterator[pa.RecordBatch]:
    """Postings of a block of chunks, by term and chunk: words become numbers, which are sorted with their places."""
    block = block.sort_by([(name, "ascending") for name in key]).combine_chunks()
    opens = _opens(block, key)
    listed = pc.split_pattern(block.column("tokens").combine_chunks(), " ")
    sizes = pc.list_value_length(listed).to_numpy().astype(np.int64)
    coded = listed.flatten().dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary)
    # Number 0 is the blank behind a chunk's last word.
    number = np.empty(len(coded.dictionary), dtype=np.int64)
    number[by_name.to_numpy()] = np.arange(1, len(number) + 1)
    names = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.take(by_name).cast(pa.string())])
    word = number[coded.indices.to_numpy()]
    ends = np.cumsum(sizes)
    place = np.arange(len(word)) - np.repeat(ends - sizes, sizes)
    after = np.append(word[1:], 0)
    after[ends - 1] = 0
    chunk = np.repeat(np.cumsum(opens) - 1, sizes)
    posting = word * len(block) + chunk
    order = np.argsort(posting, kind="stable") if opens.all() else np.lexsort((after, place, posting))
    posting = posting[order]
    starts = np.flatnonzero(np.append(True, posting[1:] != posting[:-1]))
    offsets = np.append(starts, len(posting)).astype(np.int32)
    entries, place, after = order[starts], place[order].astype(np.int32), after[order]
    kept = block.select(key).filter(pa.array(opens)).combine_chunks()
    for first in range(0, len(starts), ROWS_AT_ONCE):
        rows = slice(first, first + ROWS_AT_ONCE)
        bounds = offsets[first : first + ROWS_AT_ONCE + 1]
        of_chunk, inner = kept.take(pa.array(chunk[entries[rows]])), slice(bounds[0], bounds[-1])
        lists = pa.array(bounds - bounds[0])
        yield pa.RecordBatch.from_arrays([
            names.take(pa.array(word[entries[rows]])), *[column.combine_chunks() for column in of_chunk.columns], pa.array(np.diff(bounds)),
            pa.ListArray.from_arrays(lists, pa.array(place[inner])), pa.ListArray.from_arrays(lists, names.take(pa.array(after[inner]))),
        ], names=["term", *key, "tf", "positions", "following"])


def _bucketed(terms: DataFrame) -> DataFrame:
    """Query terms with their folder; the filter lets Spark prune folders by them at run time."""
    return terms.where(F.length("term") > 0).withColumn("bucket", bucket_of("term"))


def shared(terms: DataFrame) -> DataFrame:
    """The query side written out and counted, and shared if it fits one block."""
    held = checkpointed(terms)
    return F.broadcast(held) if held.count() <= TERM_BLOCK else held


def weighted_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, bucket, term, df, idf), the idf times the query's own weight of the term; corpus counts are subqueries."""
    n_chunks = index.documents.agg(F.sum("n_chunks").alias("n")).select("n").scalar()
    idf = F.col("weight") * inverse_document_frequency(n_chunks, F.col("df"))
    return _bucketed(query_terms(queries)).join(index.terms, _TERM).select("query_id", *_TERM, "df", idf.alias("idf"))


def _share(index: Index) -> Column:
    """What a posting adds to the score of its chunk."""
    average = index.documents.agg((F.sum("total_len") / F.sum("n_chunks")).alias("mean")).select("mean").scalar()
    tf, k1, b = F.col("tf"), fixed.BM25_K1, fixed.BM25_B
    return F.col("idf") * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("chunk_len") / average)))


def score_floors(postings: DataFrame, weights: DataFrame, share: Column, limit: int) -> DataFrame:
    """(query_id, floor): what `limit` chunks reach by the query's rarest term that stands in as many chunks. Queries
    without such a term have none. A ranked search needs none, as its tasks keep their own top rows."""
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    first = weights.where(F.col("df") >= limit).withColumn("turn", F.row_number().over(rarest)).where("turn = 1")
    seeds = postings.select(*_TERM, "chunk_id", "chunk_len", "tf").join(first, _TERM).select("query_id", "chunk_id", share.alias("score"))
    best = top_ranked(seeds, [F.desc("score")], limit)
    return best.groupBy("query_id").agg(F.count("*").alias("held"), F.min("score").alias("floor")).where(F.col("held") == limit).select(
        "query_id", "floor")


def ranked(index: Index, queries: DataFrame, limit: int = fixed.ROUTE_TOPK, eligible: DataFrame | None = None) -> DataFrame:
    """BM25 top rows (query_id, chunk_id, score, rank) for many queries; `eligible` (doc_id) narrows what is ranked.

    The postings of all wanted terms are read once, however many queries share a term, and move once, to their chunk, as
    lists of numbers. Each task then scores its own chunks for all queries and returns only its own top rows. Exact.
    """
    slim = queries.select(F.col("query_id").cast("string").alias("query_id"), "text")
    weights = checkpointed(weighted_terms(index, slim))
    corpus = index.documents.agg(F.sum("n_chunks").alias("n_chunks"), F.sum("total_len").alias("total_len")).first()
    if eligible is not None:
        eligible = checkpointed(eligible.select(F.col("doc_id").cast("string").alias("doc_id")).distinct())
        eligible = F.broadcast(eligible) if eligible.count() <= DOCUMENT_BLOCK else eligible
    scans = []
    for block in blocks_of(weights, "query_id", weights.count(), WEIGHT_BLOCK):
        held = block.toPandas()
        if len(held):
            scans.append(_scan_postings(index.postings, held, corpus.n_chunks, corpus.total_len / corpus.n_chunks, limit, eligible))
    merged = reduce(DataFrame.unionByName, scans) if scans else queries.sparkSession.createDataFrame([], _SCORED)
    return top_ranked(merged, [F.desc("score")], limit)


def _scan_postings(postings: DataFrame, held: pd.DataFrame, n_chunks: int, average: float, limit: int, eligible: DataFrame | None) -> DataFrame:
    """Top rows of each task's chunks for the queries of one block of weights."""
    spark = postings.sparkSession
    vocabulary = held[_TERM].drop_duplicates()
    numbers = {term: number for number, term in enumerate(vocabulary["term"])}
    query_codes, query_ids = pd.factorize(held["query_id"], use_na_sentinel=False)
    held_weights = spark.sparkContext.broadcast((list(query_ids), query_codes, held["term"].map(numbers).to_numpy(), held["idf"].to_numpy(dtype="float64")))
    coded = spark.createDataFrame(pa.table({
        "bucket": pa.array(vocabulary["bucket"], pa.int32()), "term": pa.array(vocabulary["term"], pa.string()), "number": pa.array(range(len(vocabulary)), pa.int32())}))
    coded = F.broadcast(coded) if len(vocabulary) <= TERM_BLOCK else coded
    folders = sorted(map(int, vocabulary["bucket"].unique()))
    met = postings.where(F.col("bucket").isin(folders)).select(*_TERM, "chunk_id", "doc_id", "chunk_len", "tf").join(coded, _TERM)
    if eligible is not None:
        met = met.select("chunk_id", "doc_id", "number", "chunk_len", "tf").join(eligible, "doc_id", "left_semi")
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_chunks // TASK_CHUNKS))
    k1, b = fixed.BM25_K1, fixed.BM25_B

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if len(batch)]
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        ids, of_query, of_term, idf = held_weights.value
        coded = rows.column("chunk_id").combine_chunks().dictionary_encode(null_encoding="encode")
        # Numbers and counts of a row are as many, so that both are cut out of one run of bytes for all rows.
        term, tf = (np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype="<i4") for name in ("numbers", "tfs"))
        of_row = np.repeat(np.arange(len(rows)), pc.binary_length(rows.column("tfs")).to_numpy() // 4)
        chunk = coded.indices.to_numpy()[of_row]
        order = np.argsort(chunk, kind="stable")
        chunk, term, tf = chunk[order], term[order], tf[order].astype("float64")
        length = rows.column("chunk_len").to_numpy()[of_row][order].astype("float64")
        share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
        chunk_ids = np.array(coded.dictionary.to_pylist(), dtype=object)
        firsts = np.searchsorted(chunk, np.arange(len(chunk_ids) + 1))
        for first_query in range(0, len(ids), QUERY_BLOCK):
            mine = (of_query >= first_query) & (of_query < first_query + QUERY_BLOCK)
            used, column = np.unique(of_term[mine], return_inverse=True)
            weights = np.zeros((len(used), min(QUERY_BLOCK, len(ids) - first_query)))
            weights[column, of_query[mine] - first_query] = idf[mine]
            best = BestRows(weights.shape[1], limit)
            where = np.searchsorted(used, term).clip(max=len(used) - 1)
            asked = used[where] == term
            at_once = max(64, SCORE_CELLS // len(used))
            for first in range(0, len(chunk_ids), at_once):
                part, count = slice(firsts[first], firsts[min(first + at_once, len(chunk_ids))]), min(at_once, len(chunk_ids) - first)
                cells = ((chunk[part] - first) * len(used) + where[part])[asked[part]]
                dense = np.bincount(cells, share[part][asked[part]], count * len(used)).reshape(count, len(used))
                best.add(chunk_ids[first : first + count], dense @ weights)
            if best.rows is not None:
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[first_query + code] for code in best.rows["query"]], pa.string(), from_pandas=True),
                    pa.array(best.rows["chunk_id"], pa.string()), pa.array(best.rows["value"], pa.float64()),
                ], names=["query_id", "chunk_id", "score"])

    gathered = met.select("chunk_id", "chunk_len", "number", "tf").mapInArrow(_by_chunk, _GATHERED)
    return gathered.repartition(tasks, "chunk_id").mapInArrow(score, _SCORED)


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task holds of a chunk, as one row: the numbers of its terms and how often each stands in it."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= GATHERED_ROWS:
            yield _gathered(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield _gathered(pa.Table.from_batches(held))


def _gathered(rows: pa.Table) -> pa.RecordBatch:
    chunk = rows.column("chunk_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    length = rows.column("chunk_len").to_numpy()
    order = np.lexsort((length, chunk))
    chunk, length = chunk[order], length[order]
    starts = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (length[1:] != length[:-1])))
    bounds = pa.py_buffer((np.append(starts, len(order)) * 4).astype("<i4"))

    def packed(name: str) -> pa.Array:
        data = pa.py_buffer(rows.column(name).to_numpy()[order].astype("<i4"))
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, data])

    return pa.RecordBatch.from_arrays([
        rows.column("chunk_id").combine_chunks().take(pa.array(order[starts])), pa.array(length[starts]), packed("number"), packed("tf"),
    ], names=["chunk_id", "chunk_len", "numbers", "tfs"])


def phrase_documents(index: Index, phrases: DataFrame) -> DataFrame:
    """Distinct (phrase, doc_id) where a chunk holds the phrase's tokens side by side.

    A posting holds the words after its own, so two words meet a phrase where the posting lies and postings do not move.
    A longer phrase is met pair by pair; only where a pair was found, its start in the chunk moves to those of the others.
    """
    parts = phrases.select("phrase").distinct().select("phrase", F.explode(F.split("phrase", " ")).alias("term"))
    known = _bucketed(parts.distinct()).join(index.terms, _TERM, "left_semi")
    words = F.split("phrase", " ")
    whole = known.groupBy("phrase").agg(F.count("*").alias("held")).where(F.col("held") == F.size(F.array_distinct(words)))
    placed = whole.select("phrase", F.greatest(F.size(words) - 1, F.lit(1)).alias("pairs"), words.alias("words")).select(
        "*", F.posexplode(F.slice("words", F.lit(1), F.col("pairs"))).alias("at", "term"))
    # A single word is followed by the blank that every posting is given.
    pairs = checkpointed(_bucketed(placed.select("phrase", "pairs", "at", "term", F.coalesce(F.get("words", F.col("at") + 1), F.lit("")).alias("after"))))
    terms = shared(pairs.select(*_TERM).distinct())

    def met(wanted: DataFrame) -> DataFrame:
        held = index.postings.select(*_TERM, "chunk_id", "doc_id", "chunk_len", "positions", "following").join(terms, _TERM, "left_semi")
        after = F.explode(F.array_distinct(F.concat(F.array(F.lit("")), "following"))).alias("after")
        return held.select("*", after).join(shared(wanted), [*_TERM, "after"])

    short = met(pairs.where("pairs = 1")).select("phrase", "doc_id").distinct()
    long = pairs.where("pairs > 1")
    if long.isEmpty():
        return short
    here = F.filter(F.arrays_zip("positions", "following"), lambda entry: entry["following"] == F.col("after"))
    starts = met(long).select("phrase", "pairs", "at", "chunk_id", "doc_id", "chunk_len", F.explode(here["positions"]).alias("place"))
    run = starts.groupBy("phrase", "pairs", "chunk_id", "doc_id", "chunk_len", (F.col("place") - F.col("at")).alias("start"))
    found = run.agg(F.count_distinct("at").alias("held")).where(F.col("held") == F.col("pairs"))
    return short.unionByName(found.select("phrase", "doc_id")).distinct()
