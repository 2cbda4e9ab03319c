"""Corpus rows as documents, and configuration."""

from __future__ import annotations

import configparser
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as X


def titled_text(title: Column, text: Column) -> Column:
    """'# title', a blank line and the text; the text alone if there is no title."""
    t, body = X.strip(F.coalesce(title, F.lit(""))), X.strip(F.coalesce(text, F.lit("")))
    return F.when(t != "", F.concat(F.lit("# "), t, F.lit("\n\n"), body)).otherwise(body)


def connector(rows: DataFrame, limit: int, id_col: str, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(name, body): the first `limit` rows of a corpus table in order of id; a file's name is its row's id."""
    return rows.orderBy(id_col).limit(limit).select(F.col(id_col).cast("string").alias("name"), titled_text(F.col(title_col), F.col(text_col)).alias("body"))


def export(rows: DataFrame, folder: str, name_col: str = "name", text_col: str = "body", suffix: str = ".txt") -> int:
    """One file a row, written by the executors; a row that is written again replaces its file.  Returns the number of files.

    The folder is a local or mounted path that all executors share; characters of a name that part paths become underscores.
    """
    import os

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for name, body in zip(pdf["name"], pdf["body"]):
                at = os.path.join(folder, "".join("_" if ch in "/\\:" else ch for ch in name) + suffix)
                with open(f"{at}.draft", "w", encoding="utf-8", newline="") as f:
                    f.write(body or "")
                os.replace(f"{at}.draft", at)
            yield pdf[["name"]]

    plain = rows.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("body"))
    return plain.mapInPandas(write, "name string").count()


def cached(spark: SparkSession, path: str, limit: int, make: Callable[[], DataFrame], order: str = "document_path") -> DataFrame:
    """The first `limit` rows, in order, of the table at path; it is made anew if it is missing or has fewer rows."""
    try:
        table = spark.read.parquet(path)
        enough = table.count() >= limit
    except AnalysisException:
        enough = False
    if not enough:
        make().limit(limit).write.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
    return table.orderBy(order).limit(limit)


@dataclass
class Config:
    """Settings with their defaults (fixed values)."""

    chunk_tokens: int = 500
    overlap_tokens: int = 100
    max_workers: int = 5
    batch_size: int = 100
    reindex_threshold: int = 10
    embedding_model: str = "hashed-64"
    rerank_model: str = "lexical"

    @classmethod
    def read(cls, path: str) -> "Config":
        ini = configparser.ConfigParser()
        ini.read(path)
        given = {k: v for s in ini.sections() for k, v in ini[s].items()}
        own = cls()
        return cls(**{f.name: type(getattr(own, f.name))(given[f.name]) for f in fields(cls) if f.name in given})
