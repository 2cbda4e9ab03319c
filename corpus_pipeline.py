"""From raw documents to packed sequences: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of the
next.  All but the last return the columns of documents.  Rows with a null doc_id are judged as others by the stages that judge single
texts (language, decontamination) and are kept by those that compare texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import common, decontaminate, language, neardup, packing, recompression


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language (null, empty or without letters) go.  Where no row is labelled, no text can be named; those with letters stay."""
    samples = language.learn(docs)
    if not samples:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = language.identify(docs, samples, extra=docs.columns)
    return named.filter(F.col("bits").isNotNull()).select(F.col("extra.*"))


def _keep(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in verdict(doc_id)."""
    return docs.join(verdict.filter("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti").select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return _keep(docs, neardup.near_duplicates(docs).filter("NOT kept").select("doc_id"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out; texts of which nothing is left go."""
    cut = recompression.dedup(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")], with_text=True)
    kept = cut.filter((F.col("n_words") == 0) | (F.col("n_words") > F.col("n_removed"))).withColumnRenamed("kept_text", "text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # judged by text, so rows that share an id, or have none, stand or fall by their own
    key = _free(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    hit = decontaminate.contaminated(keyed, benchmark, id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(hit, key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", detect_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("decontamination", drop_benchmark_copies),
    ("packing", pack),
]

#: Stages 1 and 5 are not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
