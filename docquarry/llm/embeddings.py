"""Rows of an embedding table that operators on vectors can use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(rows(id, vector), their length): rows whose vector is null, empty or holds null or non-finite entries take no part.

    Where lengths differ, the commonest length counts (of equally common ones the longest); vectors of other lengths take no part.
    """
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter("size(vector) > 0")
    rows = rows.filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = sizes[0]["length"] if sizes else 0
    return rows.filter(F.size("vector") == length), length
