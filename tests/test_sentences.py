"""Learned sentence boundaries and the proximity reranker."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import chunking, fusion
from docquarry.operators.sentences import SentenceModel

NAMES = "Weber Smith Jones Klein Adler Brown Stone Fischer".split()
VERBS = "met saw called helped found asked".split()
THINGS = "lamps ropes boats maps tools seeds".split()


def labelled(rng):
    """A sentence of a text with abbreviations, ordinals and initials in it."""
    n = lambda x: rng.choice(x)
    return rng.choice(
        [
            f"Yesterday Dr. {n(NAMES)} {n(VERBS)} Prof. {n(NAMES)} at the river.",
            f"They {n(VERBS)} many {n(THINGS)}, e.g. {n(THINGS)} and {n(THINGS)}.",
            f"The {n(THINGS)} cost approx. {rng.randint(2, 90)} coins in St. {n(NAMES)}.",
            f"We {n(VERBS)} {n(THINGS)} on the {rng.randint(2, 30)}. day!",
            f"Did J. {n(NAMES)} like the {n(THINGS)}?",
            f'He said "{n(THINGS)}." and left.',
            f"The {n(THINGS)} were old. ".strip(),
            f"They {n(VERBS)} him near the {n(THINGS)}.",
            "The old river left coins by day, they say.",
            f"At the river old coins left many {n(THINGS)}; I say so.",
            f"Such a day for {n(THINGS)}, so they left the river.",
        ]
    )


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    texts = [(" ".join(labelled(rng) for _ in range(30)),) for _ in range(60)] + [(None,), ("",)]
    return SentenceModel.learn(spark.createDataFrame(texts, "text string"))


def errors(split, rng, n=300):
    """Wrong and missed boundaries over texts of ten sentences."""
    wrong = 0
    for _ in range(n // 10):
        want = [labelled(rng) for _ in range(10)]
        cuts = lambda parts: set(__import__("itertools").accumulate(len("".join(p.split())) for p in parts))
        wrong += len(cuts(want) ^ cuts(split(" ".join(want))))
    return wrong


def test_learned_abbreviations(model):
    assert {"dr", "prof", "e.g", "approx", "st"} <= model.abbreviations and not {"river", "coins", "old", "lamps"} & model.abbreviations
    assert "they" in model.starters and "the" in model.starters


def test_fewer_errors_than_the_rule(model):
    learned, rule = errors(model.split, random.Random(7)), errors(chunking.default_sentences, random.Random(7))
    assert learned < 0.1 * rule and learned <= 3


def test_a_chunker_with_the_model(model):
    c = chunking.Chunker(sentences=model.split)
    assert c.split_sentences("Dr. Weber saw boats. They left. The end came.", 9) == ["Dr. Weber saw boats. They left.", "The end came."]
    assert model.split("") == [] and model.split("  no end ") == ["no end"] and "".join(model.split("a. b. C. d")) == "a. b. C. d"


def test_a_small_letter_with_a_stop(model):
    assert model.split("It is in part b. Weber said so.") == ["It is in part b. Weber said so."]
    assert model.split("It is equal to x. They left.") == ["It is equal to x.", "They left."]
    assert model.split("By J. They and A. Weber.") == ["By J. They and A. Weber."]


def test_no_texts(spark):
    empty = SentenceModel.learn(spark.createDataFrame([], "text string"))
    assert empty.abbreviations == empty.starters == frozenset() and empty.split("One. Two.") == ["One.", "Two."]


def test_smallest_window_like_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "c"]
    texts = [" ".join(rng.choice("abcxyz") for _ in range(rng.randint(0, 25))) for _ in range(200)] + [None]

    def by_hand(text):
        t = (text or "").split()
        return min((j - i + 1 for i in range(len(t)) for j in range(i, len(t)) if set(words) <= set(t[i : j + 1])), default=None)

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fusion.smallest_window(F.col("t"), words).alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: by_hand(t) for i, t in enumerate(texts)}


def test_near_words_come_first(spark):
    pool = spark.createDataFrame([(1, "still x x x x water", 1), (2, "still water x x x x", 2), (3, "still water x x x x", 3), (4, "still still", 4)], "id long, raw_text string, rrf_rank long")
    assert [r.id for r in fusion.rerank(pool, "still water", scorer=fusion.proximity_score).collect()] == [2, 3, 1, 4]
    assert fusion.rerank(pool, "!!!", scorer=fusion.proximity_score).first().id == 1
