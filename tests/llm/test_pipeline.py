"""The pipeline's stages against brute force."""

import zlib

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from docquarry.llm import subwords
from tests.llm import fixtures as X

DATA = [(d, t, lang) for d, t, lang in dict.fromkeys(X.rows(seed=11, n=40)) if d is not None]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    items = [(1, " ".join(DATA[6][1].split()[:30])), (2, "an item that no text holds at all in any way")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    X.frame(spark, DATA).write.parquet(f"{base}/documents.parquet")
    return base, {d: t for d, t, _ in DATA}


def test_stages(spark, world):
    base, texts = world
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    left = dict(texts)
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        path = f"{base}/stage-{k}"
        stage(spark, docs, base).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        if name == "language":
            left = {d: t for d, t in left.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_duplicates":
            root, _ = X.near_components([(d, t, None) for d, t in left.items()])
            left = {d: t for d, t in left.items() if root[d] == d}
        elif name == "substrings":
            units = {d: X.tokens(t) for d, t in left.items()}
            gone = X.removed(units, 50)
            left = {d: (" ".join(w for i, w in enumerate(units[d]) if i not in gone[d]) if gone[d] else t) for d, t in left.items() if len(gone[d]) < len(units[d])}
        else:
            hit = [d for d in left if d == 6]
            left = {d: t for d, t in left.items() if d not in hit}
        assert {r.doc_id: r.text for r in docs.collect()} == left
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    got = P.STAGES[-1][1](spark, docs, base).collect()
    assert {r.doc_id for r in got} == set(left)
    for r in got:
        raw = subwords.subwords().encode(left[r.doc_id]) + (1).to_bytes(4, "little")
        assert zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_no_labels(spark):
    """Without any label, and with the label und, texts with letters stay."""
    want = {d for d, t, _ in DATA if any(c.isalpha() for c in t or "")}
    for label in (None, "und"):
        docs = X.frame(spark, [(d, t, label) for d, t, _ in DATA])
        got = P.detect_language(spark, docs, "")
        assert got.columns == docs.columns and {r.doc_id for r in got.select("doc_id").collect()} == want


def test_benchmark_copies_with_one_id(spark, world):
    """Of two rows with one id only the one with a copy goes; a row without id that holds a copy goes too."""
    base, texts = world
    docs = X.frame(spark, [(1, texts[6], "en"), (1, "a clean text with an id that is not its own", "en"), (None, texts[6], "en"), (None, "another clean text", "en")])
    got = P.drop_benchmark_copies(spark, docs, base)
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == ["a clean text with an id that is not its own", "another clean text"]


def test_columns_with_clashing_names_are_kept(spark, world):
    base, texts = world
    docs = X.frame(spark, [(1, texts[6], "en"), (2, "a clean text of few words", "en")])
    docs = docs.withColumn("text_key", F.concat(F.lit("own "), "doc_id")).withColumn("TEXT_KEY_", F.lit("own"))
    got = P.drop_benchmark_copies(spark, docs, base)
    assert got.columns == docs.columns and [(r.doc_id, r.text_key, r.TEXT_KEY_) for r in got.collect()] == [(2, "own 2", "own")]


def test_run(spark, world):
    base, _ = world
    assert P.run(spark, base).count() > 0 and [n for n, _ in P.STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "packing"]
