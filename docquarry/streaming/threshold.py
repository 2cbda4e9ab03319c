"""Threshold-driven indexing of a stream of documents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources import storage


def run(spark: SparkSession, source: str, schema, state: str, threshold: int = 10, trigger: dict | None = None, index: Callable[[DataFrame, int], None] | None = None):
    """Start a stream over Parquet files in `source`.

    A micro-batch writes its own rows, once, to `state`/arrived.  Then it counts the documents that wait, from the counts that the batch
    before it noted; with `threshold` or more, all of them go to index(documents, batch) in one call and count as indexed.  What is
    indexed is told by one number, the last batch that is, in a note that each batch leaves: no row is written again.  A batch that runs
    again replaces its rows and calls index() again with the same ones, which must bear it.
    trigger: availableNow=True by default, processingTime="..." for a clock.
    """

    def step(df: DataFrame, batch: int) -> None:
        last = _note(spark, state, batch - 1) or {"indexed": -1, "waiting": {}}
        df.write.mode("overwrite").parquet(f"{state}/arrived/batch={batch}")
        waiting = last["waiting"] | {str(batch): spark.read.schema(schema).parquet(f"{state}/arrived/batch={batch}").count()}
        before, done = sum(waiting.values()), last["indexed"]
        if before >= threshold:
            if index:
                index(spark.read.schema(schema).parquet(*[f"{state}/arrived/batch={b}" for b in waiting]), batch)
            waiting, done = {}, batch
        after = sum(waiting.values())
        note = {"indexed": done, "waiting": waiting, "indexed_now": not waiting, "pending_before": before, "pending_after": after, "reindexed_count": before - after}
        storage.put(spark, f"{state}/notes/{batch}.json", json.dumps(note))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def _note(spark: SparkSession, state: str, batch: int) -> dict | None:
    path = f"{state}/notes/{batch}.json"
    return json.loads(storage.get(spark, path)) if batch >= 0 and storage.found(spark, path) else None


def latest(spark: SparkSession, state: str) -> DataFrame:
    """All documents that have arrived, with their batch and is_indexed."""
    notes = [int(n.removesuffix(".json")) for n in storage.names(spark, f"{state}/notes") if n.endswith(".json")]
    if not notes:
        raise FileNotFoundError(state)
    done = _note(spark, state, max(notes))["indexed"]
    rows = spark.read.parquet(f"{state}/arrived").filter(F.col("batch") <= max(notes))
    return rows.withColumn("batch", F.col("batch").cast("long")).withColumn("is_indexed", F.col("batch") <= done)


def with_delta(main: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Main index with a delta on top: rows of the delta replace those of the same key."""
    return main.join(delta.select(key).distinct(), key, "left_anti").select(*main.columns).unionByName(delta.select(*main.columns))
