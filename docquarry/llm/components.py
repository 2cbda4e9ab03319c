"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A node with more than this share of all links is a hot one; there are at most 2 / HOT of them.
HOT = 1 / 512
#: A node of no more links than this is never a hot one.
LEAST_HOT = 256


def _state(e: DataFrame, most: int) -> tuple[int, list]:
    """(nodes that keep e from being stars around smallest nodes, the hot nodes with smallest neighbour and smaller neighbours).

    In such stars a node with a smaller neighbour has no other.
    """
    ends = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    node = ends.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"), F.count_if(F.col("b") < F.col("a")).alias("k"))
    hot = F.collect_list(F.when(F.col("n") > most, F.struct("a", F.least("a", "m").alias("m"), "k")))
    return tuple(node.agg(F.count_if(F.expr("k > 0 AND n > 1")), hot).first())


def _table(e: DataFrame, **columns: list) -> DataFrame:
    return F.broadcast(e.sparkSession.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})))


def _large(e: DataFrame, hot: list) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself).

    The smallest neighbours of hot nodes are known, so their rows stay where they are; a window holds at most `most` others.
    """
    ends = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = F.least("a", F.min("b").over(Window.partitionBy("a")))
    if not hot:
        return ends.withColumn("m", least).filter("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    known = _table(e, a=[x["a"] for x in hot], m=[x["m"] for x in hot])
    cold = ends.join(known, "a", "left_anti").withColumn("m", least).filter("b > a")
    # a hot node's larger neighbours are the larger ends of its links
    own = e.select(F.col("b").alias("a"), F.col("a").alias("b")).join(known, "a").select("a", "b", "m")
    return cold.select("a", "b", "m").unionByName(own).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame, hot: list, most: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them.

    Nodes with very many smaller neighbours do so in parts; a later round joins the parts' smallest ones.
    """
    salted = [x for x in hot if x["k"] > most]
    part = F.lit(0)
    if salted:
        e = e.join(_table(e, a=[x["a"] for x in salted], parts=[-(-x["k"] // most) for x in salted]), "a", "left")
        part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
    rows = e.select("a", "b", part.alias("part"))
    rows = rows.withColumn("m", F.min("b").over(Window.partitionBy("a", "part")))
    # the row of the smallest neighbour stands for the node itself
    end = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
    return rows.select(end.alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b); component is the smallest node.  No node is collected but the hot ones.

    Rounds go on until all are stars; their number grows as the square of the logarithm of the number of nodes at most.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    e = materialise(e, "links")
    while True:
        most = max(LEAST_HOT, int(e.count() * HOT))
        open_, hot = _state(e, most)
        if not open_:
            centres = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
        e = materialise(_small(_large(e, hot), hot, most), "links")
