"""What work grows with."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd

from docquarry.operators import ann, vectors
from docquarry.plans import catalog
from docquarry.sources import pdf


def test_a_table_splits_its_text_once(spark, sf):
    plan = catalog.queries()["split_table"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "lambdafunction(split(" not in plan
    inside = [line for line in plan.splitlines() if "transform(" in line]
    assert inside and all("split(" not in line for line in inside)


def test_tables_of_pdf_files_are_found_once_and_without_a_call_a_page(spark, sf):
    plan = catalog.queries()["pdf_blocks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_runs_and_cells_of_pdf_files_stay_with_the_executors(spark, sf):
    frame = catalog.queries()["pdf_blocks"](spark, sf)
    planned = frame._jdf.queryExecution().executedPlan()
    assert "SortMergeJoin" in planned.toString() and "Broadcast" not in planned.toString()
    assert len(frame.collect()) == 6 * catalog.table(spark, sf, "documents").count()
    assert "Broadcast" not in planned.toString()  # nor as it was changed while it ran


def test_small_files_are_handed_on_together(spark):
    files = spark.range(0, 50, 1, 1).selectExpr("CAST(id AS string) AS path", "CAST('no file' AS binary) AS content")
    plan = pdf.read_items(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and pdf.read_items(files).filter("error IS NOT NULL").count() == 50


def test_sizes_are_counted_where_their_document_is(spark, sf):
    plan = catalog.queries()["font_mode"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    below = plan[plan.index("Exchange") :]
    assert "Aggregate" not in below and "Sort" not in below  # nothing is held before rows are dealt


def test_a_search_works_in_bounded_memory():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((512, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = ann._pack(64, "run")((0, 0), pd.DataFrame({"id": np.arange(512), "v": list(x), "order": np.arange(512)}))
    part["removed"] = [np.array([5, 7], np.int64)]
    q = rng.standard_normal((600, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    sent = SimpleNamespace(value=(np.arange(600), q, np.zeros((600, 1), np.int64)))
    tracemalloc.start()
    try:
        got = pd.concat(ann._found(sent, 3, 512)([part]))
        assert tracemalloc.get_traced_memory()[1] < 160 << 20
    finally:
        tracemalloc.stop()
    d = 1 - q @ x.T.astype(float)
    d[:, [5, 7]] = 9
    assert got["id"].to_numpy().reshape(600, 3).tolist() == np.argsort(d, axis=1)[:, :3].tolist()


def test_the_nearest_cell_is_the_first_of_all():
    rng = np.random.default_rng(4)
    q, centres = rng.standard_normal((50, 8)), rng.standard_normal((20, 8))
    assert vectors.nearest_cell(q, centres, 8 * 20 * 7).tolist() == vectors.nearest_cells(q, centres)[:, 0].tolist()
