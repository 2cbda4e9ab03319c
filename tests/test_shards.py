"""The corpus data source: shards, streams that resume, writes that end whole or not at all."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from docquarry.sources import corpora, shards


@pytest.fixture(scope="module")
def ready(spark):
    shards.register(spark)
    return spark


def lines(*ids):
    return "".join(json.dumps({"_id": i, "title": None if i % 3 == 0 else f"T{i}", "text": f"text {i} ü\nmore"}) + "\n" for i in ids)


@pytest.mark.parametrize("split", [1, 37, 10**6])
def test_read(ready, tmp_path, split):
    (tmp_path / "a.jsonl").write_text(lines(*range(20)) + "\n" + lines(20).rstrip("\n"))  # a blank line, and no end of the last
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(lines(21, 22).encode()))
    (tmp_path / "c.txt").write_text("no shard")
    (tmp_path / "d.jsonl").write_text("")
    df = ready.read.format("corpus").option("path", str(tmp_path)).option("id", "_id").option("split", str(split)).load()
    rows = df.collect()
    assert sorted(int(r.id) for r in rows) == list(range(23)) and {r.text for r in rows} == {f"text {i} ü\nmore" for i in range(23)}
    assert {r.shard for r in rows if int(r.id) > 20} == {"b.jsonl.gz"} and sum(r.title is None for r in rows) == 8
    body = corpora.connector(df, 2, "id").collect()
    assert [(r["name"], r["body"]) for r in body] == [("0", "text 0 ü\nmore"), ("1", "# T1\n\ntext 1 ü\nmore")]


def test_stream_resumes(ready, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()

    def run():
        stream = ready.readStream.format("corpus").option("path", str(src)).option("id", "_id").load()
        stream.select("id").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r.id) for r in ready.read.parquet(out).collect())

    half = lines(5)
    (src / "a.jsonl").write_text(lines(0, 1, 2) + half[:10])  # a line that is still being written
    assert run() == [0, 1, 2]
    (src / "a.jsonl").write_text(lines(0, 1, 2) + half + lines(6))
    (src / "b.jsonl.gz").write_bytes(gzip.compress(lines(10, 11).encode()))
    assert run() == [0, 1, 2, 5, 6, 10, 11]
    assert run() == [0, 1, 2, 5, 6, 10, 11]


def test_write_and_abort(ready, tmp_path):
    out = tmp_path / "files"
    rows = ready.createDataFrame([("a/b", "one"), ("c", None), ("d", "ü")], "name string, body string").repartition(2)
    rows.write.format("corpus").mode("append").option("path", str(out)).save()
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a_b.txt": "one", "c.txt": "", "d.txt": "ü"}
    bad = rows.withColumn("body", F.when(F.col("name") == "d", F.raise_error(F.lit("stop"))).otherwise(F.lit("new")))
    with pytest.raises(Exception):
        bad.write.format("corpus").mode("append").option("path", str(out)).save()
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a_b.txt": "one", "c.txt": "", "d.txt": "ü"}


def test_missing_folder(ready, tmp_path):
    with pytest.raises(Exception):
        ready.read.format("corpus").option("path", str(tmp_path / "none")).load().count()
