"""Vector search: exact cosine top-k, batch top-k, and a hashed embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docquarry.functions import text as X


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n)


def knn(vectors: DataFrame, query: list[float], k: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest rows; equal distances go by id."""
    if k < 1:
        raise ValueError("k must be positive")
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.round(cosine_distance(doubles(F.col(vector_col)), q), 9)
    return vectors.select(F.col(id_col).alias("id"), d.alias("distance")).filter("distance IS NOT NULL").orderBy("distance", "id").limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", most_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of each query.

    Queries are collected if their size allows and scored against each Arrow batch as one matrix product; each batch sends
    on at most k rows a query, so what is ranked in the end does not grow with the vectors' rows but with their batches.
    Larger query sets are taken in blocks.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vector_col)).alias("v"))
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), doubles(F.col(vector_col)).alias("q"))
    spark = v.sparkSession
    n, dim = q.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    blocks = max(1, -(-(n * (dim + 1) * 8) // most_bytes))
    out = None
    for i in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").collect()
        ids = np.array([r[0] for r in rows], np.int64)
        if not rows:
            continue
        m = np.array([r[1] for r in rows], float)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((ids, m))
        part = v.mapInPandas(_nearest(sent, k), "query_id long, id long, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def nearest_cells(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each unit vector, nearest centre first."""
    return np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1, kind="stable")


def nearest_cell(q: np.ndarray, centres: np.ndarray, most_bytes: int = 16 << 20) -> np.ndarray:
    """The nearest centre of each unit vector, some vectors at a time."""
    n = max(1, most_bytes // (8 * len(centres)))
    return np.concatenate([((centres**2).sum(1) - 2 * q[a : a + n] @ centres.T).argmin(axis=1) for a in range(0, len(q), n)])


def _nearest(sent, k: int):
    def ranked(ids, q, own, x):
        n = max(1, (2 << 20) // len(x))  # queries at a time: their distances to a batch take 16 MB
        for a in range(0, len(q), n):
            yield from some(ids[a : a + n], np.round(1 - q[a : a + n] @ x.T, 9), own)

    def some(ids, d, own):
        for i, row in enumerate(d):
            # every row as near as the k-th, so that ties are settled by id in the end
            near = np.flatnonzero(row <= np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1])
            near = near[np.lexsort((own[near], row[near]))][:k]
            yield pd.DataFrame({"query_id": ids[i], "id": own[near], "distance": row[near]})

    def run(batches):
        ids, q = sent.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            x = np.stack(pdf["v"].to_numpy())
            length = np.linalg.norm(x, axis=1)
            ok = length > 0
            if ok.any():
                yield from ranked(ids, q, pdf["id"].to_numpy()[ok], x[ok] / length[ok, None])

    return run


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic bag of tokens: each token adds 1 or -1 at a hashed place; unit length."""
    t = X.tokens(text)
    h = lambda x: F.xxhash64(x)
    signed = F.transform(t, lambda x: F.struct(F.pmod(h(x), F.lit(dim)).cast("int").alias("i"), F.when(h(x).bitwiseAND(1 << 40) == 0, 1.0).otherwise(-1.0).alias("s")))
    zeros = F.array_repeat(F.lit(0.0), dim)
    raw = F.aggregate(signed, zeros, lambda acc, x: F.transform(acc, lambda y, i: y + F.when(i == x["i"], x["s"]).otherwise(0.0)))
    return normalise(raw)
