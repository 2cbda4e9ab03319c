"""An embedder learned from the texts: the right singular vectors of their tf-idf matrix, by randomised subspace iteration.

Words are dealt to `width` columns by a hash, so a model has one size whatever the corpus.  A round multiplies the matrix and its transpose with a block of
`rank` + OVER vectors: every task sums its rows' products, Spark adds the tasks' sums up row by row, and only the width x rank block comes to the
driver.  The texts are read once for each round and twice more; nothing of a text leaves its task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.sources import storage

#: Vectors beside those that are asked for, and rounds; both sharpen the last vectors, whose values lie close together.
OVER, ROUNDS, SEED = 10, 4, 5


def columns(text: Column, width: int) -> Column:
    """The column of each token of a text."""
    return F.transform(X.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))


def weighted(cols: pd.Series, idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf rows; a text without a word is zero."""
    out = np.zeros((len(cols), len(idf)))
    for i, c in enumerate(cols):
        if c is not None and len(c):
            np.add.at(out[i], np.asarray(c), 1.0)
    out = np.log1p(out) * idf
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1.0)


@dataclass
class TextEmbedder:
    """idf of each column, singular vectors (width x rank) and values; called with a column of texts it gives their vectors."""

    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    @classmethod
    def learn(cls, texts: DataFrame, text_col: str = "text", rank: int = 64, width: int = 2048) -> "TextEmbedder":
        """From all texts; a null text counts as empty.  With fewer texts or columns than `rank` the last values are zero."""
        rank = min(rank, width)
        c = texts.select(columns(F.col(text_col), width).alias("c"))
        n = c.count()
        seen = c.select(F.explode(F.array_distinct("c")).alias("i")).groupBy("i").count().collect()  # a row for each column
        df = np.zeros(width)
        for r in seen:
            df[r["i"]] = r["count"]
        idf = np.log((1 + n) / (1 + df)) + 1
        size = min(width, rank + OVER)
        q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, size)))[0]
        for _ in range(ROUNDS):
            q = np.linalg.qr(_product(c, idf, q))[0]
        # within the subspace the matrix is small
        small = q.T @ _product(c, idf, q)
        values, inner = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:rank]
        v = q @ inner[:, order]
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(rank)] < 0, -1.0, 1.0)
        return cls(idf, v, np.sqrt(np.maximum(values[order], 0.0)))

    def __call__(self, text: Column) -> Column:
        sent = SparkSession.active().sparkContext.broadcast((self.idf, self.vectors))

        @F.pandas_udf("array<double>")
        def embed(cols: pd.Series) -> pd.Series:
            idf, v = sent.value
            return pd.Series(list(weighted(cols, idf) @ v))

        return embed(columns(text, len(self.idf)))

    def write(self, spark: SparkSession, path: str) -> None:
        """A small file; one that is there stays."""
        storage.put(spark, path, json.dumps({k: getattr(self, k).tolist() for k in ("idf", "vectors", "values")}))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "TextEmbedder":
        return cls(**{k: np.array(v) for k, v in json.loads(storage.get(spark, path)).items()})


def _product(c: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'A q for the rows A of c: a sum for each task, added up by Spark row by row."""
    sent = c.sparkSession.sparkContext.broadcast((idf, q))

    def run(batches):
        idf, q = sent.value
        total = None
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                x = weighted(pdf["c"].iloc[a : a + 1024], idf)
                total = x.T @ (x @ q) + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    parts = c.mapInPandas(run, "i int, row array<double>")
    sums = parts.groupBy("i").agg(*[F.sum(F.get("row", F.lit(k))).alias(f"s{k}") for k in range(q.shape[1])])
    out = np.zeros(q.shape)
    for r in sums.collect():  # width rows
        out[r["i"]] = r[1:]
    return out
