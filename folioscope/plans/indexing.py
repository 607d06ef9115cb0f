"""Chunks, postings and vectors, for all documents or only new ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import embed_key
from ..operators.chunking import chunk_documents
from ..operators.cleaning import normalize_documents
from ..operators.records import only_new, replace_documents
from ..operators.search import build_postings

# Texts per provider call.
EMBED_BATCH = 20


class EmbeddingProvider(Protocol):
    """Turns texts into vectors; must be picklable, called inside tasks."""

    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def documents_to_index(
    texts: DataFrame, chunks: DataFrame | None = None, doc_id: str | None = None, new_only: bool = False
) -> DataFrame:
    """One document, the documents without chunks, or all of them."""
    if doc_id:
        return texts.where(F.col("doc_id") == doc_id)
    if new_only and chunks is not None:
        return only_new(texts, chunks)
    return texts


def index_chunks(texts: DataFrame, current: DataFrame | None = None, new_only: bool = False) -> DataFrame:
    """The chunk table after indexing `texts` (doc_id, text)."""
    todo = documents_to_index(texts, current, new_only=new_only)
    fresh = chunk_documents(normalize_documents(todo.select("doc_id", "text")))
    return fresh if current is None else replace_documents(current, fresh, todo)


def index_postings(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """Postings laid out for term lookups: ranged and sorted by term, so a reader skips
    files by their min/max terms. A frequent term spans several ranges because the chunk
    id is part of the range key."""
    postings = build_postings(index)
    ranged = (
        postings.repartitionByRange(partitions, "term", "chunk_id")
        if partitions
        else postings.repartitionByRange("term", "chunk_id")
    )
    return ranged.sortWithinPartitions("term", "chunk_id")


def _embedded(provider: EmbeddingProvider) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), EMBED_BATCH):
                rows = batch.iloc[start : start + EMBED_BATCH]
                texts = list(rows["text"])
                try:
                    answers = [(vector, None) for vector in provider.embed(texts)]
                except Exception:  # one bad row must not cost its whole batch
                    answers = []
                    for text in texts:
                        try:
                            answers.append((provider.embed([text])[0], None))
                        except Exception as failure:
                            answers.append((None, f"{type(failure).__name__}: {failure}"))
                yield pd.DataFrame(
                    {
                        "key": list(rows["key"]),
                        "embedding": [vector for vector, _ in answers],
                        "error": [error for _, error in answers],
                    }
                )

    return run


def embed_missing(
    chunks: DataFrame, vectors: DataFrame, cache: DataFrame, provider: EmbeddingProvider
) -> tuple[DataFrame, DataFrame]:
    """(new cache rows, new vector rows) for the chunks that have no vector yet.

    Each distinct text is embedded once, and not at all when the cache knows it. Write the
    first result before reading the second, which joins against it. Keys are made before the join, so that texts stay out
    of its shuffle where only keys are asked for.
    """
    keyed = chunks.select("chunk_id", "text", embed_key(F.col("text"), provider.model, provider.dimensions).alias("key"))
    todo = keyed.join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    distinct = todo.groupBy("key").agg(F.first("text").alias("text"))
    unknown = distinct.join(cache.select("key"), "key", "left_anti")
    fresh = unknown.mapInPandas(_embedded(provider), "key string, embedding array<float>, error string")
    return fresh, todo.select("chunk_id", "key")


def vectors_from_cache(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    known = cache.where(F.col("embedding").isNotNull()).select("key", "embedding")
    return wanted.join(known, "key").select("chunk_id", "embedding")
