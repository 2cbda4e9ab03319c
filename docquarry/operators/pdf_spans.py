"""Blocks from a PDF's text spans.

The input is a table of spans (doc, page, block, line, seq, size, flags, text, x0, y0, x1, y1) and one of table boxes
(doc, page, tab, text, x0, y0, x1, y1), as any PDF library gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DEFAULT_SIZE = 12.0
BOLD = 16


def body_size(spans: DataFrame) -> DataFrame:
    """(doc, body): the most frequent size to one place; of equally frequent ones the first met.

    Sizes of a document are nearly as many as its spans, so that counting before the shuffle would sort for nothing.  Spans are dealt by document once, to all
    tasks of a shuffle whatever their bytes, and what follows stays there.
    """
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_size = spans.select("doc", "page", "block", "line", "seq", "size").repartition(parts, "doc").groupBy("doc", F.bround("size", 1).alias("s")).agg(F.count("*").alias("n"), F.min(F.struct("page", "block", "line", "seq")).alias("first"))
    order = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("n"), "first", "s"))
    return by_size.withColumn("r", order).filter("r = 1").select("doc", F.col("s").alias("body"))


def heading_level(size: Column, body: Column) -> Column:
    d = size - body
    return F.when(d >= 8, 1).when(d >= 5, 2).when(d >= 3, 3).when(d >= 1.5, 4).otherwise(5)


def blocks(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """(id, position, type, text, level, metadata) in reading order: by page, then by top edge, tables first on ties."""
    lines = spans.groupBy("doc", "page", "block", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("t"),
        F.max_by(F.struct("size", "flags"), F.struct("size", -F.col("seq"))).alias("top"),
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    body = lines.groupBy("doc", "page", "block").agg(
        F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n"), r"^\s+|\s+$", "").alias("text"),
        F.max_by("top", F.struct(F.col("top.size"), -F.col("line"))).alias("top"),
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    b, t = body.alias("b"), tables.alias("t")
    overlap = (F.col("b.doc") == F.col("t.doc")) & (F.col("b.page") == F.col("t.page"))
    overlap &= (F.col("b.x0") < F.col("t.x1")) & (F.col("t.x0") < F.col("b.x1")) & (F.col("b.y0") < F.col("t.y1")) & (F.col("t.y0") < F.col("b.y1"))
    free = b.hint("merge").join(t, overlap, "left_anti").filter("text <> ''").join(body_size(spans).hint("merge"), "doc", "left")
    base = F.coalesce("body", F.lit(DEFAULT_SIZE))
    large = (F.col("top.size") > base + 1.0) | (F.col("top.flags").bitwiseAND(BOLD) == BOLD)
    is_heading = large & (F.length("text") < 200)
    text_rows = free.select(
        "doc", "page", "y0", F.lit(1).alias("k"), F.col("block").alias("seq"), F.when(is_heading, "heading").otherwise("paragraph").alias("type"), "text",
        F.when(is_heading, heading_level(F.col("top.size"), base)).alias("level"), F.bround("top.size", 2).alias("font_size"),
    )
    table_rows = tables.filter("text <> ''").select(
        "doc", "page", "y0", F.lit(0).alias("k"), F.col("tab").alias("seq"), F.lit("table").alias("type"), "text", F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("double").alias("font_size"),
    )
    place = F.row_number().over(W.partitionBy("doc").orderBy("page", "y0", "k", "seq")) - 1
    meta = F.struct(F.lit(None).cast("string").alias("language"), F.col("page").cast("int").alias("page"), "font_size")
    return text_rows.unionByName(table_rows).select(F.col("doc").alias("id"), place.alias("position"), "type", "text", "level", meta.alias("metadata"))
