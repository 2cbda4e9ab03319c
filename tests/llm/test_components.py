"""Connected components against a union-find, hot nodes included."""

import random

import pytest

from docquarry.llm import components as C


def plain(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def shapes():
    r = random.Random(5)
    yield "loops", [(4, 4)]
    yield "chain", [(i, i + 1) for i in range(40)]
    yield "mixed chain", [(x, y) for p in [r.sample(range(-100, 100), 60)] for x, y in zip(p, p[1:])]
    yield "small centre", [(0, i) for i in range(1, 900)] + [(5000, 5001)]
    yield "large centre", [(i, 9999) for i in range(900)] + [(i, 9998) for i in range(500, 1500)]
    yield "middle centre", [(700, i) for i in range(1400)] + [(3000 + i, 700) for i in range(600)]
    yield "random", [(r.randrange(800), r.randrange(800)) for _ in range(700)]
    yield "repeated", [(1, 2)] * 400 + [(2, 1)] * 400 + [(2, 3)]


@pytest.mark.parametrize("least", [256, 3])
def test_components(spark, monkeypatch, least):
    """All shapes side by side, each in ids of its own."""
    monkeypatch.setattr(C, "LEAST_HOT", least)
    links = [(100_000 * i + a, 100_000 * i + b) for i, (_, shape) in enumerate(shapes()) for a, b in shape]
    got = C.components(spark.createDataFrame(links, "a long, b long"))
    rows = [(r.node, r.component) for r in got.collect()]
    assert dict(rows) == plain(links) and len(rows) == len(dict(rows))


def test_no_links(spark):
    assert not C.components(spark.createDataFrame([], "a long, b long")).collect()
    assert not C.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect()
