"""One retrieval over both routes, with document filters and a mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fixed
from .filters import Filters
from .inverted import Index, ranked
from .search import fuse_ranks
from .vectors import dense_search

MODES = ("hybrid", "bm25", "vector")


def retrieve(
    index: Index | None, vectors: DataFrame, documents: DataFrame, queries: DataFrame, query_vectors: DataFrame,
    filters: Filters | None = None, mode: str = "hybrid", route_limit: int = fixed.ROUTE_TOPK, limit: int = fixed.FUSED_LIMIT,
) -> DataFrame:
    """Ranked chunks of the documents that pass `filters`, by one route or by both fused.

    The filters narrow postings and vectors (chunk_id, doc_id, embedding) before anything is ranked, so a narrow filter
    still fills its lists. One route alone returns its own list and score or distance; the vector route needs no index.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    eligible = None
    if filters is not None and filters.condition() is not None:
        eligible = filters.apply(documents).select("doc_id")
        vectors = vectors.join(eligible, "doc_id", "left_semi")
    if mode == "vector":
        return dense_search(vectors, query_vectors, route_limit)
    lexical = ranked(index, queries, route_limit, eligible)
    return lexical if mode == "bm25" else fuse_ranks(lexical, dense_search(vectors, query_vectors, route_limit), limit)
