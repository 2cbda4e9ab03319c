"""Documents, chunks and vectors as tables: scans, numbering, batches, and changes as new tables (segments.py keeps them on disk)."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docquarry.functions import text as X
from docquarry.sources import storage


def by_id(documents: DataFrame, id_: int) -> DataFrame:
    return documents.filter(F.col("id") == id_)


def by_path(documents: DataFrame, path: str) -> DataFrame:
    return documents.filter(F.col("document_path") == path).orderBy("id").limit(1)


def page(documents: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page in order of id."""
    if skip < 0 or not 1 <= limit <= 1000:
        raise ValueError("needs skip >= 0 and 1 <= limit <= 1000")
    return documents.orderBy("id").offset(skip).limit(limit)


def pending(documents: DataFrame) -> DataFrame:
    """Documents that wait, in order of id."""
    return documents.filter(~F.col("is_indexed")).orderBy("id")


def pending_count(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count_if(~F.col("is_indexed")).alias("pending"))


def reindex_decision(documents: DataFrame, threshold: int = 10) -> DataFrame:
    """One row: whether the pending documents are indexed now, and how many are pending before and after."""
    n = F.count_if(~F.col("is_indexed"))
    now = n >= threshold
    return documents.agg(
        now.alias("indexed_now"), n.alias("pending_before"), F.when(now, 0).otherwise(n).cast("long").alias("pending_after"),
        F.lit(threshold).cast("long").alias("threshold"), F.when(now, n).otherwise(0).cast("long").alias("reindexed_count"),
    )


def repair_index_state(documents: DataFrame) -> DataFrame:
    return documents.withColumn("is_indexed", F.coalesce("is_indexed", F.lit(True)))


def rename(documents: DataFrame, id_: int, name: str) -> DataFrame:
    return documents.withColumn("name", F.when(F.col("id") == id_, F.lit(name)).otherwise(F.col("name")))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the one with the largest `order` (upsert: the last write stays), by one pre-aggregated pass."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, F.col(order)).alias("r")).select("r.*")


#: Chunks that a document may have, as bits of a chunk's id.
POSITION_BITS = 20


def chunk_id(document_id, position):
    """Reproducible id of a chunk: the document's id and the position beside each other; an error where they do not fit."""
    d, p = F.col(document_id), F.col(position)
    fits = (d >= 0) & (d < 1 << (63 - POSITION_BITS)) & (p < 1 << POSITION_BITS)
    return F.when(fits, F.shiftleft(d, POSITION_BITS) + p).otherwise(F.raise_error(F.lit("document id or chunk position out of range")).cast("long"))


def ranges(rows: DataFrame, order: str, per_range: int = 100_000, sample: int = 1 << 14) -> DataFrame:
    """rows with `__r`: ranges of the values of `order`, from left to right, with about `per_range` rows each.

    The borders are a fixed part of the plan, from a bounded sample by hash, so that the ranges are the same whenever they are computed again.
    """
    n = max(1, -(-rows.count() // per_range))
    seen = sorted(r[0] for r in rows.select(order).filter(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order), order).limit(sample).collect()) if n > 1 else []
    at = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []
    if not at:
        return rows.withColumn("__r", F.lit(0))
    borders = F.array(*[F.lit(x) for x in at])
    return rows.withColumn("__r", F.coalesce(F.size(F.filter(borders, lambda x: x <= F.col(order))), F.lit(0)))


def numbered(rows: DataFrame, order: str, name: str = "place", per_range: int = 100_000) -> DataFrame:
    """rows with their place, from 0, in order of a column without repeats: a window for each range, and sums of the ranges' counts."""
    r = ranges(rows, order, per_range)
    counts = r.groupBy("__r").agg(F.count("*").alias("__c"))
    before = counts.select("__r", (F.sum("__c").over(W.orderBy("__r")) - F.col("__c")).alias("__b"))  # one row a range
    within = F.row_number().over(W.partitionBy("__r").orderBy(order)) - 1
    return r.withColumn("__w", within).join(F.broadcast(before), "__r").withColumn(name, (F.col("__b") + F.col("__w")).cast("long")).select(*rows.columns, name)


def batches_by_document(counts: DataFrame, size: int = 100, order: str = "doc_id", n: str = "chunks", per_range: int = 100_000) -> DataFrame:
    """(doc_id, chunks, batch): greedy batches of whole documents in order of id; one with more than `size` chunks is alone.

    A fold, cut into ranges of ids.  What a range does depends only on the fill of the batch that is open when it begins, one of size + 2
    states; a first pass follows all of them, the driver chains the ranges (size + 2 numbers each), a second pass numbers the rows.
    """
    rows = ranges(counts.select(order, F.col(n).cast("long").alias(n)), order, per_range)
    over = size + 1  # a batch with more than `size` chunks, however many

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        fill, made = np.arange(over + 1), np.zeros(over + 1, np.int64)
        for x in pdf.sort_values(order)[n].to_numpy().tolist():
            full = (fill > 0) & (fill + x > size)
            made += full
            fill = np.minimum(np.where(full, x, fill + x), over)
        return pd.DataFrame({"__r": [int(pdf["__r"].iloc[0])], "made": [made.tolist()], "fill": [fill.tolist()]})

    moves = {r["__r"]: r for r in rows.groupBy("__r").applyInPandas(follow, "__r int, made array<long>, fill array<long>").collect()}
    begin, batch, fill = {}, 0, 0
    for r in sorted(moves):
        begin[r] = (batch, fill)
        batch, fill = batch + moves[r]["made"][fill], moves[r]["fill"][fill]

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        batch, fill = begin[int(pdf["__r"].iloc[0])]
        out = []
        for x in pdf[n].to_numpy().tolist():
            full = fill > 0 and fill + x > size
            batch, fill = batch + full, x if full else fill + x
            out.append(batch)
        return pdf[[order, n]].assign(batch=out)

    kind = counts.schema[order].dataType.simpleString()
    return rows.groupBy("__r").applyInPandas(number, f"`{order}` {kind}, `{n}` long, batch long")


def chunks_per_batch(batches: DataFrame, n: str = "chunks") -> DataFrame:
    """(batch, documents, chunks): what each batch holds."""
    return batches.groupBy("batch").agg(F.count("*").alias("documents"), F.sum(n).alias("chunks"))


def flat_batches(rows: DataFrame, size: int, id_col: str) -> DataFrame:
    """(id, batch): slices of `size` rows in order of id."""
    return numbered(rows.select(id_col), id_col).select(id_col, F.floor(F.col("place") / size).cast("long").alias("batch"))


@dataclass
class Store:
    """documents(id, document_path, name, is_indexed), chunks(id, document_id, ...), vectors(chunk_id, document_id, vector)."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame

    def register(self, paths: DataFrame) -> "Store":
        """New documents (document_path, name), pending; an old document of the same path goes with all that hangs on it.

        Ids follow the largest that any table holds, in order of path: what is left of an older life can not attach to a new document.
        Of several names for one path the smallest stays.
        """
        gone = self.documents.join(paths.select("document_path"), "document_path", "left_semi").select("id")
        kept = self.delete(gone)
        used = self.documents.select("id").unionByName(self.chunks.select(F.col("document_id").alias("id"))).unionByName(self.vectors.select(F.col("document_id").alias("id")))
        last = used.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = numbered(paths.groupBy("document_path").agg(F.min("name").alias("name")), "document_path")
        new = new.select((F.lit(last) + 1 + F.col("place")).cast("long").alias("id"), "document_path", "name", F.lit(False).alias("is_indexed"))
        return replace(kept, documents=kept.documents.unionByName(new.select(*kept.documents.columns)))

    def delete(self, ids: DataFrame) -> "Store":
        """Without the documents ids(id), their chunks and their vectors."""
        key = ids.select(F.col("id").alias("document_id")).distinct()
        return Store(
            self.documents.join(ids.select("id").distinct(), "id", "left_anti").select(*self.documents.columns),
            self.chunks.join(key, "document_id", "left_anti").select(*self.chunks.columns),
            self.vectors.join(key, "document_id", "left_anti").select(*self.vectors.columns),
        )

    def put_chunks(self, new: DataFrame, vectors: DataFrame, refreshed: DataFrame | None = None) -> "Store":
        """Chunks and vectors of some documents replace all that these had; the documents count as indexed.

        refreshed(id): the documents that were parsed, those without any chunk as well; by default the ones that have new chunks.
        """
        key = (new.select("document_id") if refreshed is None else refreshed.select(F.col("id").alias("document_id"))).distinct()
        done = key.select(F.col("document_id").alias("id"), F.lit(True).alias("done"))
        docs = self.documents.join(done, "id", "left").withColumn("is_indexed", F.coalesce("done", "is_indexed")).select(*self.documents.columns)
        swap = lambda old, more: old.join(key, "document_id", "left_anti").select(*old.columns).unionByName(more.select(*old.columns))
        return Store(docs, swap(self.chunks, new), swap(self.vectors, vectors))


#: Upload rules (fixed values).
UPLOAD_SUFFIXES = (".txt", ".md", ".docx", ".pdf", ".html", ".htm")
UPLOAD_BYTES = 200 * 1024
UPLOAD_FILES = 10


def upload_errors(files: DataFrame, path_col: str = "path", size_col: str = "length") -> DataFrame:
    """files with `error`: null if the file may be stored; any error refuses the whole upload."""
    name, suffix = X.basename(F.col(path_col)), X.extension(F.col(path_col))
    error = (
        F.when(F.coalesce(name, F.lit("")) == "", "empty name")
        .when(~suffix.isin(*UPLOAD_SUFFIXES), "unsupported type")
        .when(F.coalesce(F.col(size_col), F.lit(0)) <= 0, "empty file")
        .when(F.col(size_col) > UPLOAD_BYTES, "too large")
    )
    return files.withColumn("error", error)


def upload(files: DataFrame, folder: str) -> list[str]:
    """Store files(path, content) under their base names; all are validated before any is written.

    An upload has at most UPLOAD_FILES files of at most UPLOAD_BYTES, so it passes through the driver.  Returns the written paths.
    """
    spark = files.sparkSession
    judged = upload_errors(files.select("path", F.octet_length("content").alias("length"))).limit(UPLOAD_FILES + 1).collect()
    if len(judged) > UPLOAD_FILES:
        raise ValueError(f"more than {UPLOAD_FILES} files")
    if wrong := [f"{r.path}: {r.error}" for r in judged if r.error]:
        raise ValueError("; ".join(wrong))
    out = []
    for r in files.select(X.basename(F.col("path")).alias("name"), "content").collect():
        fs, p = storage._at(spark, f"{folder}/{r.name}")
        stream = fs.create(p, True)
        stream.write(bytearray(r.content))
        stream.close()
        out.append(f"{folder}/{r.name}")
    return out
