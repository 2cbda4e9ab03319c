"""Reciprocal rank fusion, metadata fetch and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docquarry.functions import text as X

RRF_K = 60
POOL = 50


def ranked(hits: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """(id, rank from 1) of a retriever's hits; they are few, bounded by its limit."""
    return hits.select("id", F.row_number().over(W.orderBy(*order)).cast("long").alias(name))


def reciprocal_rank_fusion(vector: DataFrame, fts: DataFrame, pool: int = POOL) -> DataFrame:
    """(id, rrf, rrf_rank) of the best `pool` ids; vector(id, rank), fts(id, rank).

    Equal sums keep the order vector hits by rank, then full-text hits by rank.
    """
    v, f = vector.select("id", F.col("rank").alias("vr")), fts.select("id", F.col("rank").alias("fr"))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col(r).cast("double")), F.lit(0.0))
    both = v.join(f, "id", "full_outer").withColumn("rrf", F.round(part("vr") + part("fr"), 9))
    order = [F.desc("rrf"), F.asc_nulls_last("vr"), F.asc_nulls_last("fr")]
    top = both.orderBy(*order).limit(pool)
    return top.select("id", "rrf", F.row_number().over(W.orderBy(*order)).cast("long").alias("rrf_rank"))


def fetch(pool: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Pool rows that still have a chunk and its document, with their metadata; the pool's order is in rrf_rank."""
    c = chunks.select(F.col("id"), "document_id", "breadcrumbs", "raw_text")
    d = documents.select(F.col("id").alias("document_id"), F.col("name").alias("document_name"), "document_path")
    return F.broadcast(pool).join(c, "id").join(d, "document_id")


def lexical_score(text: Column, query: str) -> Column:
    """Default reranker: share of the query's distinct words in the text plus a little for how often they come."""
    words = sorted({t for p in X.query_phrases(query) for t in p})
    if not words:
        return F.lit(0.0)
    hits = F.filter(X.tokens(text), lambda x: x.isin(words))
    held = F.size(F.array_distinct(hits)) / F.lit(float(len(words)))
    return F.round(held + F.size(hits) / (F.lit(100.0) + F.size(hits)), 9)


#: Weight of the proximity of the query's words beside how many there are.
NEARNESS = 0.5


def smallest_window(text: Column, words: list[str]) -> Column:
    """Tokens in the smallest stretch of the text that holds all the words; null if there is none.  One sweep over the tokens keeps the last place of each word."""
    start = F.struct(F.array(*[F.lit(-1)] * len(words)).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state, x):
        last = F.array(*[F.when(x["t"] == w, x["i"]).otherwise(F.get(state["last"], F.lit(k))) for k, w in enumerate(words)])
        width = F.when(F.array_min(last) >= 0, x["i"] - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(state["best"], width).alias("best"))

    hits = F.filter(F.transform(X.tokens(text), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(words))
    return F.aggregate(hits, start, step, lambda s: s["best"])


def proximity_score(text: Column, query: str) -> Column:
    """A reranker: lexical_score, and more the closer together the query's distinct words stand; NEARNESS where they are side by side."""
    words = sorted({t for p in X.query_phrases(query) for t in p})
    if not words:
        return F.lit(0.0)
    return F.round(lexical_score(text, query) + F.coalesce(F.lit(NEARNESS * len(words)) / smallest_window(text, words), F.lit(0.0)), 9)


def rerank(pool: DataFrame, query: str, top_k: int = 20, scorer: Callable[[Column, str], Column] | None = None) -> DataFrame:
    """The top_k rows by score; equal scores keep the pool's order.  scorer may wrap a pandas UDF around a model."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    score = (scorer or lexical_score)(F.col("raw_text"), query)
    return pool.withColumn("score", score).orderBy(F.desc("score"), "rrf_rank").limit(top_k)
