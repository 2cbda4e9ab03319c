"""Embedding whitening: RowMatrix Gramian of exactly centred rows, local eigenvectors, broadcast projection.

Plan.  An entry c becomes the integer x = floor(1024 c) + 100000.  One aggregation gives the number of rows n and the integer sums S of all
dimensions; a row is centred exactly, as the integers n*x - S, and divided by n only then.  MLlib's RowMatrix sums the products of the centred
rows (dimension squared numbers reach the driver, whatever the number of rows); divided by n they are the covariance V, whose eigenvectors are found
on the driver.  They are broadcast, and each Arrow batch of rows is projected as one matrix product.  The whitened table is written to the shared
folder, its own covariance is measured from what was written, and the result reads it again.

Odd cases.  Rows with a null or empty vector, or null or non-finite entries, are dropped; where lengths differ, so are those of other than the commonest
length.  A null or repeated id is a row like others.  An entry so large that 1024 c leaves +-2^40 counts as that bound.  With fewer than eight dimensions there are
as many components; a component without variance (e not above 1e-12 of the largest eigenvalue) has a null `whitened` and takes no part in
identity_error, which is 0 if no component has variance; `explained` is null if V is zero.  A deviation beyond a long is null.  An empty table gives no
rows.  Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .embeddings import usable

SCALE, SHIFT, COMPONENTS = 1024, 100000, 8
#: 1024 c is held within this bound.
MOST = 1 << 40
#: Eigenvalues not above this share of the largest one count as none.
NO_VARIANCE = 1e-12


@dataclass
class Whitener:
    """n rows, their integer sums, and eigenvectors (columns, by falling eigenvalue) of their covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def _fits(self, x: np.ndarray) -> bool:
        return self.n * float(np.abs(x).max(initial=0)) + float(np.abs(self.sums).max(initial=0)) < 2.0**62

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n if self._fits(x) else x - self.sums / self.n

    def deviations(self, x: np.ndarray) -> list:
        """Sum of (n*x - S)^2 of each row, exact; None beyond a long."""
        if self._fits(x):
            d = self.n * x - self.sums
            if float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2.0**63:
                return (d * d).sum(axis=1).tolist()
        exact = (sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums.tolist())) for row in x.tolist())
        return [d if d < 1 << 63 else None for d in exact]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the square root of their eigenvalue; NaN without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x) @ self.vectors / np.sqrt(np.where(self.has_variance, self.values, np.nan))

    @property
    def has_variance(self) -> np.ndarray:
        return self.values > NO_VARIANCE * self.values[0] if len(self.values) and self.values[0] > 0 else np.zeros(len(self.values), bool)


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(rows(id, x), length): x is the vector as integers."""
    rows, length = usable(embeddings, id_col, vector_col)
    bound = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))
    return rows.select("id", F.transform("vector", lambda c: (F.floor(bound(c)) + SHIFT).cast("long")).alias("x")), length


def fit(rows: DataFrame, length: int, components: int = COMPONENTS) -> tuple[Whitener, float]:
    """(whitener, trace of the covariance) of rows(id, x)."""
    got = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(length)]).first()
    n, sums = got["n"], np.array([got[f"s{i}"] or 0 for i in range(length)], np.int64)
    if not n:
        return Whitener(0, sums, np.empty(0), np.empty((length, 0))), 0.0
    # n*x - S in integers, then one division: the rows are centred before anything is multiplied
    s = F.array(*[F.lit(int(v)) for v in sums])
    wide = F.lit(n).cast("decimal(18,0)") if n * MOST >= 1 << 62 else F.lit(n)
    exact = F.zip_with("x", s, lambda a, b: (wide * a - b).cast("double") / F.lit(float(n)))
    features = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(exact).alias("features")), "features")
    v = RowMatrix(features, numCols=length).computeGramianMatrix().toArray() / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    # one sign for all: the largest entry of each is positive
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitener(n, sums, np.maximum(values[order], 0.0), vectors), float(np.trace(v))


def transform(rows: DataFrame, whitener: Whitener) -> DataFrame:
    """(id, deviation, whitened) of rows(id, x); whitened is an array with an entry for each component."""
    sent = rows.sparkSession.sparkContext.broadcast(whitener)

    def run(batches):
        w = sent.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
                yield pd.DataFrame({"id": pdf["id"], "deviation": pd.array(w.deviations(x), "Int64"), "whitened": list(w.whiten(x))})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, has_variance: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened components minus the identity."""
    k = np.flatnonzero(has_variance).tolist()
    pairs = [(i, j) for i in k for j in k if i <= j]
    if not pairs:
        return 0.0
    w = lambda i: F.get("whitened", F.lit(i))
    got = whitened.agg(*[F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    rows, length = integers(embeddings, id_col, vector_col)
    whitener, trace = fit(rows, length, components)
    table = materialise(transform(rows, whitener), "whitened")
    error = identity_error(table, whitener.has_variance)
    share = F.array(*[F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in whitener.values]) if len(whitener.values) else F.array().cast("array<double>")
    each = table.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "w"))
    return each.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(whitener.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"), F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
