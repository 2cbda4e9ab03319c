"""Full-text search: a positional index and BM25.

The index is two tables: postings (id, token, positions, dl) and lengths (id, dl), dl being the document's number of tokens.  Written to
storage, postings are parted by buckets of tokens, and the number of documents and their mean length stand beside them: a query reads the
buckets of its own tokens and one row, and no text.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import slices
from docquarry.functions import text as X

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
POSTINGS = "id long, token string, positions array<int>, dl long, bucket int"
log = logging.getLogger(__name__)


@dataclass
class Index:
    postings: DataFrame  # id, token, positions array<int>, dl; bucket where it is stored
    lengths: DataFrame  # id, dl
    stats: DataFrame | None = None  # docs, avgdl
    buckets: int = 0

    def write(self, path: str, buckets: int | None = None, per_bucket: int = 500_000, per_part: int = 1_000_000) -> "Index":
        """Store below path and read back.  There is a bucket for each `per_bucket` tokens, 4 to 1024 in all, unless `buckets` says how many.

        A bucket is written by one task for each `per_part` documents, so that a token of every text is not one task's work.
        """
        spark = self.postings.sparkSession
        self.lengths.write.parquet(f"{path}/lengths")
        lengths = spark.read.parquet(f"{path}/lengths")
        docs, tokens = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        buckets = buckets or min(1024, max(4, -(-tokens // per_bucket)))
        posts = self.postings.withColumn("bucket", bucket_of(F.col("token"), buckets))
        salt = F.pmod(F.xxhash64("id"), F.lit(1 + docs // per_part))
        posts.repartition("bucket", salt).sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
        totals(lengths).withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/stats")
        return Index.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Index":
        stats = spark.read.parquet(f"{path}/stats")
        buckets = stats.first()["buckets"]
        return cls(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), stats.drop("buckets"), buckets)

    def of(self, words: list[str]) -> DataFrame:
        """Postings of some tokens; stored ones come from their buckets alone."""
        p = self.postings
        if self.buckets:
            p = p.filter(reduce(lambda a, b: a | b, [F.col("bucket") == bucket_of(F.lit(w), self.buckets) for w in words]))
        return p.filter(F.col("token").isin(words))


def bucket_of(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").cast("double").alias("docs"), F.avg("dl").alias("avgdl"))


def build_index(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> Index:
    """Postings are made row by row, as a document is one row: no token is shuffled before it is stored."""
    t = docs.select(F.col(id_col).cast("long").alias("id"), X.tokens(F.col(text_col)).alias("t"))
    return Index(t.mapInArrow(_postings, "id long, token string, positions array<int>, dl long"), t.select("id", F.size("t").cast("long").alias("dl")))


def _postings(batches):
    """Slices of the batches, so that the numbers of one slice's tokens are held at a time."""
    for batch in batches:
        for a, b in slices.slices(batch.column("t")):
            yield from _posted(batch.slice(a, b - a))


def _posted(batch):
    """A slice's tokens are numbered, ordered by row and token, and cut where these change; positions stay in order."""
    tokens, ids = batch.column("t"), batch.column("id")
    values = tokens.flatten()
    if not len(values):
        return
    starts = tokens.offsets.to_numpy()
    lengths = np.diff(starts)
    coded = values.dictionary_encode()
    code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(tokens)), lengths)
    place = np.arange(len(code)) - np.repeat(starts[:-1] - starts[0], lengths)
    key = row * len(coded.dictionary) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
    row, code = row[order][first], code[order][first]
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), coded.dictionary.take(pa.array(code)), positions, pa.array(lengths[row], pa.int64())], ["id", "token", "positions", "dl"])


def refresh_index(index: Index, changed: DataFrame, removed: DataFrame) -> Index:
    """Index after `changed` (id, text) were written and `removed` (id) deleted: only their rows are made anew."""
    gone = removed.select("id").unionByName(changed.select("id")).distinct()
    new = build_index(changed)
    columns = ["id", "token", "positions", "dl"]
    keep = lambda old, more: old.join(gone, "id", "left_anti").select(*more.columns).unionByName(more)
    return Index(keep(index.postings, new.postings.select(*columns)), keep(index.lengths, new.lengths))


def document_frequency(index: Index) -> DataFrame:
    return index.postings.groupBy("token").agg(F.count("*").alias("df"))


def matches(index: Index, phrases: list[list[str]]) -> DataFrame:
    """(id, dl, tf0, tf1, ...) of the documents that hold a word of the phrases; a phrase's tokens must follow each other."""
    words = sorted({t for p in phrases for t in p})
    at = {t: F.coalesce(F.max(F.when(F.col("token") == t, F.col("positions"))), F.array().cast("array<int>")).alias(f"p{i}") for i, t in enumerate(words)}
    by_doc = index.of(words).groupBy("id").agg(F.max("dl").alias("dl"), *at.values())
    place = {t: F.col(f"p{i}") for i, t in enumerate(words)}
    shifted = lambda t, k: F.transform(place[t], lambda x: x - k)
    tf = [F.size(reduce(F.array_intersect, [shifted(t, k) for k, t in enumerate(p)])).cast("double").alias(f"tf{i}") for i, p in enumerate(phrases)]
    return by_doc.select("id", "dl", *tf)


def bm25(index: Index, query: str, k: int | None = 200) -> DataFrame:
    """(id, score): the k best documents that hold all words of the query; lower scores are better, ties go by id.

    A word given twice counts twice.  A query without a word gives no rows.  Without k all documents come, in no order.
    """
    phrases = X.query_phrases(query)
    if not phrases:
        return index.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    found = matches(index, phrases)
    n = len(phrases)
    held = found.agg(*[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("double")), F.lit(0.0)).alias(f"n{i}") for i in range(n)])
    scalars = F.broadcast((totals(index.lengths) if index.stats is None else index.stats).crossJoin(held))  # one row
    every = reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(n)])
    rows = found.filter(every).crossJoin(scalars)
    parts = []
    for i in range(n):
        idf = F.log((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        tf = F.col(f"tf{i}")
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    score = F.round(-reduce(lambda a, b: a + b, parts), 9)
    scored = rows.select("id", score.alias("score"))
    return scored if k is None else scored.orderBy("score", "id").limit(k)


def bm25_or_none(index: Index, query: str, k: int = 200) -> DataFrame:
    """bm25; if the index can not be read, a warning and no hits.  The hits, at most k, are taken now.

    No search here calls it, since its result does not tell a failure from a query without hits.
    """
    spark = index.lengths.sparkSession
    try:
        hits = bm25(index, query, k)
        return spark.createDataFrame(hits.collect(), hits.schema)
    except (PySparkException, Py4JError) as e:
        log.warning("full-text search failed: %s", str(e)[:200])
        return spark.createDataFrame([], "id long, score double")
