"""From files to a searchable corpus in one call: blocks, breadcrumbs, chunks, ids, vectors, segments with their full-text index."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import breadcrumbs, chunking, fts, search, store, vectors
from docquarry.operators.segments import Segments
from docquarry.plans import schemas
from docquarry.sources import parsers
from docquarry.sources.corpora import Config

Embedder = Callable[[Column], Column]  # text -> array of numbers; may wrap a pandas UDF around a model


def chunk_blocks(blocks: DataFrame, config: Config, chunker: chunking.Chunker = chunking.DEFAULT) -> DataFrame:
    """Rows of the chunk table, and their embedding_input, of blocks(id, position, type, text, level): id is the document's."""
    c = chunking.chunks(breadcrumbs.breadcrumbs(blocks), "id", config.chunk_tokens, config.overlap_tokens, chunker)
    c = c.withColumnRenamed("id", "document_id").withColumn("id", store.chunk_id("document_id", "position"))
    return c.select("id", "document_id", "position", "breadcrumbs", "token_count", F.lit(config.embedding_model).alias("embedding_model"), F.col("text").alias("raw_text"), "embedding_input")


def embed_chunks(chunks: DataFrame, embed: Embedder, column: str = "embedding_input") -> DataFrame:
    """Rows of the vector table: unit vectors of the chunks' inputs."""
    # a step of its own, as a function of a model can stand in no lambda and must run once
    raw = chunks.select(F.col("id").alias("chunk_id"), "document_id", vectors.doubles(embed(F.col(column))).alias("v"))
    return raw.select("chunk_id", "document_id", vectors.normalise(F.col("v")).cast("array<float>").alias("vector"))


@dataclass
class Corpus:
    """One state of a stored corpus: documents, chunks, vectors and full-text index of the same manifest."""

    segments: Segments

    @classmethod
    def read(cls, spark: SparkSession, path: str, version: int | None = None) -> "Corpus":
        """The newest state, or an earlier one; FileNotFoundError where there is none."""
        s = Segments.open(spark, path, version)
        if not s.head.version:
            raise FileNotFoundError(path)
        return cls(s)

    @property
    def store(self) -> store.Store:
        return self.segments.store

    @property
    def index(self) -> fts.Index:
        return self.segments.index

    @property
    def path(self) -> str:
        return self.segments.path

    def index_vectors(self) -> "Corpus":
        """With a vector index of all chunks (none for few of them); chunks that come later are searched exactly beside it until it is made again."""
        return Corpus(self.segments.index_vectors())

    def search(self, query: str, top_k: int = 20, retrieval_k: int = 200, embed: Embedder = vectors.hashed_embedding, scorer=None) -> DataFrame:
        """Hits for a text alone: it is embedded as the chunks were."""
        s = self.store
        blank = not (query or "").strip()
        vector = [] if blank else self.segments.spark.range(1).select(vectors.doubles(embed(F.lit(query)))).first()[0]
        return search.search(query, vector, self.index, s.vectors, s.chunks, s.documents, top_k, retrieval_k, scorer, self.segments.near)


def index_pending(
    corpus: Corpus, parsed: DataFrame, config: Config | None = None, embed: Embedder = vectors.hashed_embedding, chunker: chunking.Chunker = chunking.DEFAULT
) -> tuple[Corpus, DataFrame]:
    """(corpus, errors): all pending documents are chunked, embedded and put into the corpus as one segment.

    parsed(document_path, blocks, error), as by parsers.parse_files.  Documents with an error, or without a parsed row, stay pending and are
    told in errors(document_path, error); a document without text counts as indexed and has no chunks.  What is written is what the new chunks
    need; neighbouring small segments are merged from time to time.
    """
    s, config = corpus.segments, config or Config()
    spark = s.spark
    due = store.pending(s.documents).select("id", "document_path").join(parsed.select("document_path", "blocks", "error"), "document_path", "left")
    made = f"{s.path}/parsed/{uuid.uuid4().hex}"
    due.write.parquet(f"{made}/blocks")
    due = spark.read.parquet(f"{made}/blocks")
    fine = due.filter("error IS NULL AND blocks IS NOT NULL")
    errors = due.filter("error IS NOT NULL OR blocks IS NULL").select("document_path", F.coalesce("error", F.lit("not found")).alias("error"))
    rows = fine.select("id", F.explode("blocks").alias("b")).select("id", "b.*")
    chunk_blocks(rows, config, chunker).write.parquet(f"{made}/chunks")
    new = spark.read.parquet(f"{made}/chunks")
    if not fine.isEmpty():
        s = s.put_chunks(new.select(*[f.name for f in schemas.CHUNKS]), embed_chunks(new, embed), fine.select("id")).merge()
    return Corpus(s), errors


def index_files(files: DataFrame, path: str, config: Config | None = None, embed: Embedder = vectors.hashed_embedding, chunker: chunking.Chunker = chunking.DEFAULT) -> tuple[Corpus, DataFrame]:
    """(corpus, errors): register files(path, kind, content, text), as by parsers.read_files, in the corpus below path and index what is pending."""
    s = Segments.open(files.sparkSession, path).register(_registered(files))
    return index_pending(Corpus(s), _parsed(files), config, embed, chunker)


def _registered(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("document_path"), F.substring_index("path", "/", -1).alias("name"))


def _parsed(files: DataFrame) -> DataFrame:
    return parsers.parse_files(files).withColumnRenamed("id", "document_path")


def index_folder(spark: SparkSession, folder: str, path: str, **more) -> tuple[Corpus, DataFrame]:
    return index_files(parsers.read_files(spark, folder), path, **more)


def upload(files: DataFrame, folder: str, path: str, config: Config | None = None, embed: Embedder = vectors.hashed_embedding, chunker: chunking.Chunker = chunking.DEFAULT) -> tuple[Corpus, dict, DataFrame]:
    """(corpus, outcome, errors) of an upload of files(path, content): stored in the folder, registered, and indexed if enough documents wait.

    Either all files are stored or, if one is refused, none.  Whether to index is decided once, after all files are registered: with the configured
    threshold of pending documents or more, all of them are indexed in one call, those of earlier uploads as well.  outcome has uploaded, indexed_now,
    pending_before, pending_after, threshold and reindexed_count, where documents that their parsers refuse still wait.
    """
    spark, config = files.sparkSession, config or Config()
    stored = store.upload(files, folder)
    s = Segments.open(spark, path).register(_registered(parsers.read_files(spark, stored)))
    before = s.documents.filter("NOT is_indexed").count()
    corpus, errors = Corpus(s), spark.createDataFrame([], "document_path string, error string")
    if now := before >= config.reindex_threshold:
        waiting = parsers.read_files(spark, folder).join(s.documents.filter("NOT is_indexed").select(F.col("document_path").alias("path")), "path", "left_semi")
        corpus, errors = index_pending(corpus, _parsed(waiting), config, embed, chunker)
    after = corpus.segments.documents.filter("NOT is_indexed").count() if now else before
    return corpus, {"uploaded": len(stored), "indexed_now": now, "pending_before": before, "pending_after": after, "threshold": config.reindex_threshold, "reindexed_count": before - after}, errors
