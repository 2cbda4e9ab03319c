"""The learned embedder against numpy's singular vectors."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry.operators import indexing, learned
from docquarry.operators.learned import TextEmbedder
from docquarry.sources import parsers

TOPICS = ["river water pond lake rain cold flow", "bread oven flour bake salt crust warm", "sail mast rope wind harbour deck crew"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(TOPICS[i % 3].split() + ["the", "and"]) for _ in range(rng.randint(5, 30)))) for i in range(120)]
    return spark.createDataFrame(rows + [(900, None), (901, ""), (902, "!!")], "id long, text string").repartition(3)


def test_like_numpy(spark, texts):
    model = TextEmbedder.learn(texts, rank=6, width=64)
    rows = texts.select("id", learned.columns(F.col("text"), 64).alias("c")).toPandas()
    x = learned.weighted(rows.c, model.idf)
    counts = np.array([[list(c).count(k) for k in range(64)] for c in rows.c])
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.values, s[:6], rtol=1e-3) and np.allclose(model.values[:3], s[:3], rtol=1e-7)  # those apart from the rest are exact
    # singular vectors up to their sign; those of nearly equal values span the same space
    assert np.allclose(np.abs(np.sum(model.vectors[:, :3] * vt[:3].T, axis=0)), 1, atol=1e-4)
    got = texts.select("id", model(F.col("text")).alias("v")).toPandas().set_index("id").v
    assert np.allclose(np.stack(got.loc[rows.id]), x @ model.vectors) and not np.any(got.loc[900]) and not np.any(got.loc[902])


def test_topics_are_near(spark, texts):
    model = TextEmbedder.learn(texts, rank=3, width=256)
    asked = spark.createDataFrame(pd.DataFrame({"t": ["pond rain", "oven flour", "mast rope", "lake flow"]}))
    v = np.stack(asked.select(model(F.col("t")).alias("v")).toPandas().v)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T
    assert near[0, 3] > 0.9 and max(near[0, 1], near[0, 2], near[1, 2]) < 0.7  # "lake flow" has no word of "pond rain"


def test_stored_and_used_by_a_corpus(spark, texts, tmp_path):
    model = TextEmbedder.learn(texts, rank=3, width=256)
    model.write(spark, f"{tmp_path}/model.json")
    again = TextEmbedder.read(spark, f"{tmp_path}/model.json")
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.idf, model.idf)
    src = tmp_path / "in"
    src.mkdir()
    for i, t in enumerate(TOPICS):
        (src / f"{i}.txt").write_text(t)
    corpus, _ = indexing.index_files(parsers.read_files(spark, str(src)), str(tmp_path / "c"), embed=again)
    first = corpus.segments.near([float(x) for x in spark.range(1).select(again(F.lit("harbour crew")).alias("v")).first().v], 1).first()
    assert corpus.store.chunks.filter(F.col("id") == first.id).first().raw_text == TOPICS[2]
    assert corpus.search("oven flour", embed=again).first().document_name == "1.txt"


def test_few_texts(spark):
    model = TextEmbedder.learn(spark.createDataFrame([(None,), ("one word",)], "text string"), rank=4, width=16)
    assert model.values[0] > 0 and np.allclose(model.values[1:], 0, atol=1e-6)
    none = TextEmbedder.learn(spark.createDataFrame([], "text string"), rank=2, width=8)
    assert none.vectors.shape == (8, 2) and not none.values.any()
