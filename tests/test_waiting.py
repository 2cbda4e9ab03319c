"""Documents that wait for a count or a time, whichever comes first."""

import time

import pytest

from docquarry.streaming import waiting


def until(condition, seconds=120):
    end = time.time() + seconds
    while time.time() < end and not condition():
        time.sleep(0.2)
    assert condition()


def test_count_or_time(spark, tmp_path):
    src, state, calls = str(tmp_path / "in"), str(tmp_path / "state"), []
    put = lambda lo, hi: spark.range(lo, hi).coalesce(1).write.mode("append").parquet(src)

    def start(seconds):
        stream = spark.readStream.schema("id long").parquet(src)
        return waiting.run(stream, state, lambda df, _: calls.append(sorted((int(r.id), r.batch, r.reason) for r in df.collect())), 10, seconds, every="200 milliseconds")

    put(0, 4)
    query = start(3600)
    try:
        until(lambda: query.lastProgress is not None and any(p["numInputRows"] for p in query.recentProgress))
        assert calls == []
        put(4, 12)  # twelve wait: all go, by count
        until(lambda: len(calls) == 1)
        assert calls[0] == [(i, 1, "count") for i in range(12)]
        put(20, 25)
        until(lambda: sum(p["numInputRows"] for p in query.recentProgress) >= 17)
    finally:
        query.stop()
    put(25, 29)  # nine wait, five of them from before the restart
    query = start(4)
    try:
        put(40, 41)  # a tenth, if it comes in time, or the next batch's first
        until(lambda: sum(len(c) for c in calls) >= 22)
    finally:
        query.stop()
    assert sorted(i for c in calls[1:] for i, _, _ in c) == [*range(20, 29), 40]


def test_time_alone(spark, tmp_path):
    src, calls = str(tmp_path / "in"), []
    spark.range(9).coalesce(1).write.parquet(src)
    query = waiting.run(spark.readStream.schema("id long").parquet(src), str(tmp_path / "state"), lambda df, _: calls.append([(int(r.id), r.reason) for r in df.collect()]), 10, 2, every="200 milliseconds")
    try:
        until(lambda: calls)
    finally:
        query.stop()
    assert sorted(calls[0]) == [(i, "time") for i in range(9)]


def test_settings(spark):
    with pytest.raises(ValueError):
        waiting.handed_over(spark.readStream.format("rate").load(), 0)
