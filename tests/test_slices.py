"""Work in slices: a worker makes objects and results of a slice at a time, not of a whole batch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions import slices
from docquarry.operators import chunking, fts
from docquarry.sources import parsers


def test_ranges():
    for column in (pa.array(["x" * 100] * 10), pa.array([b"x" * 100] * 10), pa.array([["x" * 100]] * 10), pa.array(["x" * 100] * 10, pa.large_string())):
        got = list(slices.slices(column, 260))
        assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == 10 and all(1 <= b - a <= 3 for a, b in got) and len(got) >= 4
    assert list(slices.slices(pa.array(["a", None, "x" * 999, "b"]), 100)) == [(0, 2), (2, 3), (3, 4)]
    assert list(slices.slices(pa.array(["y" * 999, "a", "x" * 999, "b"])[1:], 100)) == [(0, 1), (1, 2), (2, 3)]
    assert list(slices.slices(pa.array([], pa.string()))) == [] and list(slices.slices(pa.array([None, None]))) == [(0, 2)]


def test_one_result_a_row(spark):
    rows = [(i, None if i % 7 == 3 else "a b. c " * (i % 50)) for i in range(500)]
    d = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    tags = d.select("id", slices.each(lambda t: None if t is None else [t[:3], str(len(t))], T.ArrayType(T.StringType()), most=300)("text").alias("x"))
    assert {r.id: r.x for r in tags.collect()} == {i: None if t is None else [t[:3], str(len(t))] for i, t in rows}


@pytest.mark.parametrize("make", [lambda: chunking.split_udf("paragraph", 8), lambda: parsers._udf(parsers.parse_txt, False), lambda: parsers._udf(parsers.parse_html, False), lambda: chunking.count_udf()])
def test_results_are_handed_on_in_slices(make):
    column = pa.array(["<p>Some words. And more of them.</p>" * 100] * 2000)  # 7 MB
    out = list(make().func(iter([column])))
    assert sum(map(len, out)) == 2000 and max(map(len, out)) < 500


def test_postings_in_slices():
    texts = [["a", "b", "a"] * 2000 for _ in range(300)]  # 1.8 million tokens
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(texts, pa.list_(pa.string()))], ["id", "t"])
    out = list(fts._postings([batch]))
    assert max(b.num_rows for b in out) < 200
    got = {(r["id"], r["token"]): r for b in out for r in b.to_pylist()}
    assert len(got) == 600 and all(r["dl"] == 6000 and len(r["positions"]) == (4000 if r["token"] == "a" else 2000) for r in got.values())
    assert got[299, "b"]["positions"][:3] == [1, 4, 7]


def test_chunks_of_rows_with_all_columns(spark):
    b = spark.createDataFrame([Row(id=1, position=0, type="paragraph", text="One. Two.", breadcrumbs=["x"])])
    assert chunking.chunks(b).collect()[0].embedding_input == "x\n\nOne. Two."
    assert spark.range(1).select(chunking.overlap_udf(2)(F.array(F.lit("a b c"), F.lit("d"))).alias("x")).first().x == ["a b c", "b c\n\nd"]
