"""Heading paths, sections and whole-text views, by windows over a document's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LEVELS = 9


def breadcrumbs(blocks: DataFrame, id_col: str = "id") -> DataFrame:
    """blocks with `breadcrumbs`: the headings above a block, outermost first; a heading is not above itself.

    A heading of level L ends all deeper ones, so the last heading of a level counts if it stands after the last of every
    lower level.
    """
    w = W.partitionBy(id_col).orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_ = lambda k: (F.col("type") == "heading") & (F.col("level") == k)
    last = {f"__h{k}": F.last(F.when(is_(k), F.struct("position", "text")), ignorenulls=True).over(w) for k in range(1, LEVELS + 1)}
    out = blocks.withColumns(last)
    crumbs, before = [], F.lit(-1)
    for k in range(1, LEVELS + 1):
        h = F.col(f"__h{k}")
        crumbs.append(F.when((h["position"] > before) & ~((F.col("type") == "heading") & (h["position"] == F.col("position"))), h["text"]))
        before = F.greatest(before, F.coalesce(h["position"], F.lit(-1)))
    path = F.array_compact(F.array(*crumbs))
    # what a heading replaces is not above it
    own = F.when(F.col("type") == "heading", F.array_compact(F.array(*[F.when(F.lit(k + 1) < F.col("level"), c) for k, c in enumerate(crumbs)]))).otherwise(path)
    return out.withColumn("breadcrumbs", own).drop(*last)


def sections(blocks: DataFrame, id_col: str = "id") -> DataFrame:
    """blocks with `section`: 0 before the first heading, then one for each heading."""
    w = W.partitionBy(id_col).orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    return blocks.withColumn("section", F.sum(F.when(F.col("type") == "heading", 1).otherwise(0)).over(w).cast("long"))


def full_text(blocks: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, text): the non-blank blocks in order, a blank line between them."""
    rows = blocks.filter(F.col("text").rlike(r"\S"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"])
    return rows.groupBy(id_col).agg(F.array_join(parts, "\n\n").alias("text"))


def embedding_input(crumbs: Column, text: Column) -> Column:
    """The last three crumbs line by line, a blank line, the text."""
    return F.concat(F.array_join(F.slice(crumbs, F.greatest(F.size(crumbs) - 2, F.lit(1)), 3), "\n"), F.lit("\n\n"), text)
