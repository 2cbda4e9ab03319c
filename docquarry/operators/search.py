"""Hybrid search as one plan: both retrievers, fusion, late fetch of texts, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators import fts, fusion, vectors

HIT = "chunk_id long, document_id long, document_name string, document_path string, score double, snippet string, breadcrumbs array<string>"


def search(
    query: str,
    query_vector: list[float],
    index: fts.Index,
    vector_table: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    top_k: int = 20,
    retrieval_k: int = 200,
    scorer=None,
    near: Callable[[list[float], int], DataFrame] | None = None,
) -> DataFrame:
    """Hits in the columns of HIT, best first; a blank query gives none.  An index that can not be read is an error: hits of vectors alone would look like all.

    near(query vector, k) gives (id, distance) in place of exact search over the vector table, as from an index.
    """
    if not (query or "").strip():
        return chunks.sparkSession.createDataFrame([], HIT)
    hits = near(query_vector, retrieval_k) if near else vectors.knn(vector_table, query_vector, retrieval_k, "chunk_id", "vector")
    by_vector = fusion.ranked(hits, F.asc("distance"), F.asc("id"))
    text = fusion.ranked(fts.bm25(index, query, retrieval_k), F.asc("score"), F.asc("id"))
    pool = fusion.reciprocal_rank_fusion(by_vector, text)
    best = fusion.rerank(fusion.fetch(pool, chunks, documents), query, top_k, scorer)
    return best.select(
        F.col("id").alias("chunk_id"), "document_id", "document_name", "document_path", "score", X.snippet(F.col("raw_text")).alias("snippet"), "breadcrumbs"
    )
