"""Lines, blocks and ruled tables of PDF pages, from text runs and ruling lines.

Runs become lines, and lines blocks, by windows over a page in reading order; a window's group is one page.  Rules that touch are one table's: their ends and
crossings give a grid, a cell is what no rule parts, and every run goes to the cell that holds its centre.  Joins are sorted and merged: runs and cells take
a few bytes a row as Parquet, and by the size of their files Spark would send them whole through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from docquarry.functions import slices
from docquarry.operators import pdf_spans

#: Lines of one block are at most this many sizes apart, base line to base line, and differ in size by less than SAME points.
LEADING, SAME = 1.6, 0.5
#: Rules nearer than this meet.
TOUCH = 3.0
CELL = "doc string, page int, tab int, row int, col int, x0 double, y0 double, x1 double, y1 double"


def spans(items: DataFrame) -> DataFrame:
    """Rows for pdf_spans.blocks: runs with the line and block of their page that they belong to."""
    runs = items.filter("kind = 'run' AND text <> ''").withColumn("base", F.round("y1", 1))
    order = W.partitionBy("doc", "page").orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    # a run goes on with the line before if it stands on its base line and to the right of its start
    starts = before("base").isNull() | (F.abs(F.col("base") - before("base")) > 0.3 * F.col("size")) | (F.col("x0") < before("x0"))
    wide = F.col("x0") - before("x1") > 3 * F.col("size")
    runs = runs.withColumn("line", F.sum((starts | wide).cast("int")).over(order))
    # a line is as large, wide and bold as its runs are together; its first run stands after the last one of the line before
    line = W.partitionBy("doc", "page", "line").orderBy("seq")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    runs = runs.withColumns({"nth": F.row_number().over(line), **{f"line_{c}": f(c).over(whole) for f, c in ((F.max, "size"), (F.min, "x0"), (F.max, "x1"), (F.max, "y1"), (F.max, "flags"))}})
    down = W.partitionBy("doc", "page").orderBy("line", "seq")
    own = lambda c: F.col(f"line_{c}")
    last = lambda c: F.lag(f"line_{c}").over(down)
    step = own("y1") - last("y1")
    joined = (F.abs(own("size") - last("size")) < SAME) & (step > 0) & (step <= LEADING * own("size")) & (own("x0") < last("x1")) & (last("x0") < own("x1")) & (own("flags") == last("flags"))
    runs = runs.withColumn("opens", ((F.col("nth") == 1) & ~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("block", F.sum("opens").over(down))
    return runs.select("doc", "page", "block", "line", "seq", "size", "flags", "text", "x0", "y0", "x1", "y1")


def _levels(values: np.ndarray) -> np.ndarray:
    """Coordinates with those that meet as one."""
    out: list[float] = []
    for v in np.sort(values):
        if not out or v - out[-1] > TOUCH:
            out.append(float(v))
    return np.array(out)


def _at(levels: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.abs(values[:, None] - levels).argmin(axis=1)


def _joined(rules: np.ndarray) -> np.ndarray:
    """Rules (from, to, across) with those that go on in one line as one: a sweep along each line."""
    if not len(rules):
        return rules
    lines = _levels(rules[:, 2])
    at, out = _at(lines, rules[:, 2]), []
    for k in np.lexsort((rules[:, 0], at)):
        a, b, _ = rules[k]
        if out and out[-1][2] == lines[at[k]] and a <= out[-1][1] + TOUCH:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, lines[at[k]]])
    return np.array(out)


def _tables(level: np.ndarray, upright: np.ndarray) -> np.ndarray:
    """Which rules (from, to, across) belong together: those that touch, and what they touch.  A number for each rule, level ones first."""
    n, m = len(level), len(upright)
    meets = lambda a, b: (a[:, None, 0] - TOUCH <= b[:, 2]) & (b[:, 2] <= a[:, None, 1] + TOUCH)
    cross = meets(level, upright) & meets(upright, level).T
    up = np.arange(n + m)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(*np.nonzero(cross)):
        a, b = root(int(i)), root(n + int(j))
        up[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n + m)])


def grid_cells(rules: np.ndarray) -> list[tuple]:
    """(tab, row, col, x0, y0, x1, y1) of the cells of rules (x0, y0, x1, y1) of one page.

    A table needs two columns or rows and rules around them.  Squares of the grid that no rule parts are one cell; a cell of several rows or columns
    is named by its first.
    """
    flat = np.abs(rules[:, 3] - rules[:, 1]) < np.abs(rules[:, 2] - rules[:, 0])
    level = _joined(np.column_stack((rules[flat, 0], rules[flat, 2], (rules[flat, 1] + rules[flat, 3]) / 2)))
    upright = _joined(np.column_stack((rules[~flat, 1], rules[~flat, 3], (rules[~flat, 0] + rules[~flat, 2]) / 2)))
    if not len(level) or not len(upright):
        return []
    part, out, tab = _tables(level, upright), [], 0
    tops = {g: level[part[: len(level)] == g, 2].min() for g in set(part[: len(level)].tolist()) & set(part[len(level) :].tolist())}
    for g in sorted(tops, key=tops.get):
        own, side = level[part[: len(level)] == g], upright[part[len(level) :] == g]
        ys, xs = _levels(np.concatenate((own[:, 2], side[:, 0], side[:, 1]))), _levels(np.concatenate((side[:, 2], own[:, 0], own[:, 1])))
        rows, cols = len(ys) - 1, len(xs) - 1
        if rows < 1 or cols < 1 or rows * cols < 2:
            continue
        # whether a rule lies on the edge above (left of) each square
        above, left = np.zeros((rows + 1, cols), bool), np.zeros((rows, cols + 1), bool)
        for a, b, y in zip(_at(xs, own[:, 0]), _at(xs, own[:, 1]), _at(ys, own[:, 2])):
            above[y, a:b] = True
        for x, a, b in zip(_at(xs, side[:, 2]), _at(ys, side[:, 0]), _at(ys, side[:, 1])):
            left[a:b, x] = True
        seen, found = np.zeros((rows, cols), bool), []
        for r in range(rows):
            for c in range(cols):
                if seen[r, c]:
                    continue
                todo, cell, open_ = [(r, c)], [], False
                seen[r, c] = True
                while todo:
                    i, j = todo.pop()
                    cell.append((i, j))
                    for wall, i2, j2 in ((above[i, j], i - 1, j), (above[i + 1, j], i + 1, j), (left[i, j], i, j - 1), (left[i, j + 1], i, j + 1)):
                        if wall:
                            continue
                        if not (0 <= i2 < rows and 0 <= j2 < cols):
                            open_ = True  # no rule between this square and the outside: no cell
                        elif not seen[i2, j2]:
                            seen[i2, j2] = True
                            todo.append((i2, j2))
                if not open_:
                    i, j = np.array(cell).T
                    found.append((tab, r, int(j.min()), float(xs[j.min()]), float(ys[r]), float(xs[j.max() + 1]), float(ys[i.max() + 1])))
        if len(found) >= 2:
            out += found
            tab += 1
    return out


def cells(items: DataFrame) -> DataFrame:
    """CELL rows of the ruled tables: one group for each page, its rules gathered by Spark.

    The groups are small but cost time, so that they are dealt to all tasks of a shuffle, whatever their bytes.
    """
    found = slices.each(lambda rules: grid_cells(np.array(rules, float)), T.ArrayType(T.StructType(T.StructType.fromDDL(CELL).fields[2:])))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = items.filter("kind = 'rule'").repartition(parts, "doc", "page").groupBy("doc", "page").agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("rules"))
    return pages.select("doc", "page", F.explode(found("rules")).alias("c")).select("doc", "page", "c.*")


def tables(c: DataFrame, spans_: DataFrame) -> DataFrame:
    """(doc, page, tab, text, x0, y0, x1, y1) of cells c: cells joined by ' | ' and rows by line breaks; a run goes to the cell that holds its centre."""
    s = spans_.select("doc", "page", "line", "seq", "text", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    inside = (s["doc"] == c["doc"]) & (s["page"] == c["page"]) & (s["x"] >= c["x0"]) & (s["x"] < c["x1"]) & (s["y"] >= c["y0"]) & (s["y"] < c["y1"])
    told = c.hint("merge").join(s, inside, "left").select(*[c[n] for n in c.columns], "line", "seq", "text")
    line = told.groupBy(*c.columns, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("t"))
    cell = line.groupBy(*c.columns).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")).alias("t"))
    row = cell.groupBy("doc", "page", "tab", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "t"))), lambda x: x["t"]), " | ").alias("t"),
        *[f(n).alias(n) for f, n in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    whole = row.groupBy("doc", "page", "tab").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda x: x["t"]), "\n").alias("text"),
        *[f(n).alias(n) for f, n in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    # a grid that holds no text is a drawing
    return whole.filter(F.regexp_replace("text", r"[\s|]", "") != "")


def blocks(items: DataFrame, cells_: DataFrame | None = None) -> DataFrame:
    """(id, position, type, text, level, metadata) of the items of readable files; cells_: those of items, if they are at hand."""
    s = spans(items)
    return pdf_spans.blocks(s, tables(cells(items) if cells_ is None else cells_, s))
