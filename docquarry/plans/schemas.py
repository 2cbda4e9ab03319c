"""Declared schemas, and the check that a table has its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

METADATA = T.StructType([T.StructField("language", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("font_size", T.DoubleType())])
BLOCK = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("metadata", METADATA),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("breadcrumbs", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("embedding_input", T.StringType()),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("document_path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("is_indexed", T.BooleanType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("breadcrumbs", T.ArrayType(T.StringType())),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("raw_text", T.StringType()),
    ]
)
VECTORS = T.StructType(
    [T.StructField("chunk_id", T.LongType()), T.StructField("document_id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()))]
)
BLOCK_TYPES = ("heading", "paragraph", "table", "list", "code", "caption")


def verify_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df with exactly the expected columns; an error names what is missing or of another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')}, expected {f.dataType.simpleString()}" for f in expected if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError("schema differs: " + "; ".join(wrong))
    return df.select(*[f.name for f in expected])
