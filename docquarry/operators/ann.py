"""A stored vector index: cells as partitions, a navigable small world in each part of a cell, int8 codes, exact rescoring.

A cell is the rows nearest to one centre; the centres are fitted once, on a bounded sample, and stay.  A cell's rows lie in parts of bounded size, one
row of the table each: ids, unit vectors, int8 codes and a graph of near neighbours, packed.  A search reads the partitions of its nearest cells and no
other, walks each part's graph over the codes, and scores what it finds on the stored vectors.  New rows become new parts of existing cells; removed rows
are named beside their part, stay as way points and are not found.  No part is ever written again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docquarry.operators import vectors
from docquarry.sources import storage

PART = "cell int, part string, n int, ids binary, vectors binary, codes binary, scales binary, links binary, entries binary"
#: An index is made of this many rows at least; below that, search is exact (fixed value).
LEAST_ROWS = 256
#: Rows that the centres are fitted on, at most; rows that the number of cells to read is measured with; cells at most.
FIT_ROWS, MEASURE_ROWS, MOST_CELLS = 65_536, 256, 4096
#: Rows of a part; links that a row makes when it is put in, and that it can hold; rows that a walk begins at.
PART_ROWS, LINKS, MOST_LINKS, ENTRIES = 2048, 16, 32, 32
#: Bytes that a search works on at a time, about: queries are taken as their number allows.
AT_ONCE = 32 << 20


def small_world(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, entries) of unit vectors: rows are put in one after the other and linked, both ways, to the nearest that are there.

    A row holds MOST_LINKS (-1 where it has fewer): those of the rows that came first, which lead across, and those of the nearest.  A walk begins at the first
    rows, and at others that can not be reached from them.
    """
    n = len(x)
    near = np.full((n, LINKS), -1, np.int32)
    for a in range(0, n, 256):
        s = x[a : a + 256] @ x[: min(a + 256, n)].T
        for i in range(a, min(a + 256, n)):
            own = s[i - a, :i]
            k = min(LINKS, i)
            near[i, :k] = np.argpartition(-own, k - 1)[:k] if k else []
    i, k = np.nonzero(near >= 0)
    start, end = np.concatenate((i, near[i, k])), np.concatenate((near[i, k], i))
    sim = np.einsum("ij,ij->i", x[start], x[end])
    first, close = _place(start, end), _place(start, -sim)
    # half for those that came first, however far, half for the nearest
    kept = (first < MOST_LINKS // 2) | (close < MOST_LINKS // 2)
    start, end = start[kept], end[kept]
    place = _place(start, end)
    links = np.full((n, MOST_LINKS), -1, np.int32)
    links[start, place] = end
    return links, _entries(links)


def _place(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place of each pair among those of its group, by order."""
    at = np.lexsort((order, group))
    out = np.empty(len(at), np.int64)
    out[at] = np.arange(len(at)) - np.searchsorted(group[at], group[at])
    return out


def _entries(links: np.ndarray) -> np.ndarray:
    """The first rows, and the first of those that no entry before leads to, again and again."""
    reached, out = np.zeros(len(links), bool), list(range(min(ENTRIES, len(links))))
    front = np.array(out)
    while not reached.all():
        if not len(front):
            front = np.array([int(np.argmin(reached))])
            out.append(int(front[0]))
        while len(front):
            reached[front] = True
            front = np.unique(links[front])
            front = front[(front >= 0) & ~reached[front]]
    return np.array(out, np.int32)


def walk(codes: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int, at_once: int = 4) -> np.ndarray:
    """Rows that a best-first walk finds near each query, `width` of them and -1 for none: it ends when no open row is as near as the width-th found."""
    n, width = len(codes), min(width, len(codes))
    sims = np.full((len(q), n), -np.inf, np.float32)
    sims[:, entries] = q @ codes[entries].T
    fresh = np.zeros((len(q), n), bool)
    fresh[:, entries] = True
    active = np.arange(len(q))
    while len(active):
        own = sims[active]
        last = np.partition(own, n - width, axis=1)[:, n - width]
        open_ = np.where(fresh[active], own, -np.inf)
        best = np.argpartition(-open_, min(at_once, n) - 1, axis=1)[:, :at_once]
        go = np.take_along_axis(open_, best, axis=1)
        go = np.isfinite(go) & (go >= last[:, None])
        row, column = np.nonzero(go)
        if not len(row):
            break
        at, node = active[row], best[row, column]
        fresh[at, node] = False
        there = links[node]
        at, there = np.repeat(at, there.shape[1])[there.ravel() >= 0], there[there >= 0]
        new = np.isinf(sims[at, there])
        pair = np.unique(at[new].astype(np.int64) * n + there[new])
        at, there = pair // n, pair % n
        sims[at, there] = np.einsum("ij,ij->i", q[at], codes[there])
        fresh[at, there] = True
        active = active[go.any(axis=1)]
    found = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    return np.where(np.isfinite(np.take_along_axis(sims, found, axis=1)), found, -1)


def _pack(dim: int, run: str):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
        scales = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
        codes = np.rint(x / scales[:, None]).astype(np.int8)
        links, entries = small_world(x)
        packed = [pdf["id"].to_numpy(np.int64), x, codes, scales.astype(np.float32), links, entries]
        return pd.DataFrame([[int(key[0]), f"{run}-{key[0]}-{key[1]}", len(x), *[a.tobytes() for a in packed]]], columns=[c.split()[0] for c in PART.split(", ")])

    return pack


def _unpack(row) -> tuple[np.ndarray, ...]:
    n = row.n
    of = lambda raw, kind: np.frombuffer(raw, kind)
    x = of(row.vectors, np.float32).reshape(n, -1)
    codes = of(row.codes, np.int8).reshape(n, -1).astype(np.float32) * of(row.scales, np.float32)[:, None]
    return of(row.ids, np.int64), x, codes, of(row.links, np.int32).reshape(n, -1), of(row.entries, np.int32)


@dataclass
class VectorIndex:
    """The index below `path`: model.json (centres, cells to read), parts by cell, removed ids by part."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: int

    @classmethod
    def build(cls, rows: DataFrame, path: str, k: int = 50, recall: float = 0.96, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> "VectorIndex | None":
        """The index of all rows but null and zero vectors; None if there are fewer than LEAST_ROWS.

        How many cells a search reads is measured: a bounded sample of rows is searched exactly at k, and the fewest cells that hold the asked share
        of their neighbours are taken.
        """
        rows = rows.filter(F.exists(vector_col, lambda x: x != 0))
        spark, n = rows.sparkSession, rows.count()
        if n < LEAST_ROWS:
            return None
        out = cls(spark, path, _fit(rows, n, id_col, vector_col, seed), 0)
        out.add(rows, id_col, vector_col)
        out.probes = _measured(rows, out.centres, n, k, recall, id_col, vector_col)
        storage.put(spark, f"{path}/model.json", json.dumps({"centres": out.centres.tolist(), "probes": out.probes}))
        return out

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "VectorIndex":
        model = json.loads(storage.get(spark, f"{path}/model.json"))
        return cls(spark, path, np.array(model["centres"]), model["probes"])

    def add(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        """New rows become new parts of the cells that there are; nothing else is read or written."""
        run = uuid.uuid4().hex[:12]
        placed = _placed(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), self.centres)
        counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))  # a row for each cell
        dealt = placed.join(F.broadcast(counts), "cell").withColumn("order", F.xxhash64("id"))
        dealt = dealt.withColumn("p", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")))
        packed = dealt.groupBy("cell", "p").applyInPandas(_pack(self.centres.shape[1], run), PART)
        packed.write.mode("append").partitionBy("cell").parquet(f"{self.path}/parts")

    def remove(self, ids: DataFrame) -> None:
        """Rows of ids(id) are not found any more; only the ids of the parts are read."""
        _named(self.parts(), ids).write.mode("append").parquet(f"{self.path}/removed")

    def parts(self, cells: list[int] | None = None) -> DataFrame:
        t = self.spark.read.schema(PART).parquet(f"{self.path}/parts")
        return t if cells is None else t.filter(F.col("cell").isin(cells))

    def with_removed(self, parts: DataFrame, dead: DataFrame | None = None) -> DataFrame:
        """Parts with the ids that are not to be found: those that were removed, and of a search's own dead(id)."""
        gone = [] if dead is None else [_named(parts, dead)]
        if storage.found(self.spark, f"{self.path}/removed"):
            gone.append(self.spark.read.schema("part string, removed array<long>").parquet(f"{self.path}/removed"))
        if not gone:
            return parts.withColumn("removed", F.array().cast("array<long>"))
        named = reduce(DataFrame.unionByName, gone).groupBy("part").agg(F.flatten(F.collect_list("removed")).alias("removed"))
        return parts.join(named, "part", "left")

    def search(self, query: list[float], k: int = 200, probes: int | None = None, width: int | None = None, dead: DataFrame | None = None) -> DataFrame:
        """(id, distance) of the k nearest rows that a walk finds, nearest first; equal distances go by id.  Rows of dead(id) are passed over."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "vec_id long, embedding array<double>")
        return self.search_batch(one, k, probes, width, dead=dead).select("id", "distance").orderBy("distance", "id")

    def search_batch(self, queries: DataFrame, k: int = 10, probes: int | None = None, width: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", most_bytes: int = 64 << 20, dead: DataFrame | None = None) -> DataFrame:
        """(query_id, id, distance, rank) of the k nearest rows that are found for each query; larger sets of queries are taken in blocks."""
        if k < 1:
            raise ValueError("k must be positive")
        probes, width = min(probes or self.probes, len(self.centres)), width or 2 * k
        q = queries.select(F.col(id_col).cast("long").alias("query_id"), vectors.doubles(F.col(vector_col)).alias("q"))
        n = q.count()
        blocks = max(1, -(-(n * (self.centres.shape[1] + probes) * 8) // most_bytes))
        out = self.spark.createDataFrame([], "query_id long, id long, distance double")
        for i in range(blocks):
            asked = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
            asked = [r for r in asked if r["q"] is not None and any(r["q"])]
            if not asked:
                continue
            m = np.array([r["q"] for r in asked])
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            cells = vectors.nearest_cells(m, self.centres)[:, :probes]
            sent = self.spark.sparkContext.broadcast((np.array([r["query_id"] for r in asked], np.int64), m, cells))
            parts = self.with_removed(self.parts(np.unique(cells).tolist()), dead)
            out = out.unionByName(parts.mapInPandas(_found(sent, k, width), "query_id long, id long, distance double"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
        return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def _named(parts: DataFrame, ids: DataFrame) -> DataFrame:
    """(part, removed): which of ids(id) each part holds; of the parts only ids are read."""
    each = parts.select("part", "ids").mapInPandas(ids_of_parts, "part string, id long")
    gone = each.join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    return gone.groupBy("part").agg(F.collect_list("id").alias("removed"))


def ids_of_parts(batches):
    """(part, id) of parts(part, ids)."""
    for pdf in batches:
        for part, raw in zip(pdf["part"], pdf["ids"]):
            yield pd.DataFrame({"part": part, "id": np.frombuffer(raw, np.int64)})


def _sample(rows: DataFrame, n: int, most: int, salt: int, id_col: str, vector_col: str) -> DataFrame:
    """At most `most` rows, chosen by a hash of their ids."""
    share = min(1.0, 0.9 * most / n)
    return rows.select(id_col, vector_col).filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most)


def _fit(rows: DataFrame, n: int, id_col: str, vector_col: str, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.normalise(vectors.doubles(F.col(vector_col)))
    chosen = _sample(rows, n, FIT_ROWS, seed, id_col, vector_col).select(array_to_vector(unit).alias("unit")).persist()
    cells = max(1, min(MOST_CELLS, int(n**0.5)))
    centres = np.array(KMeans(k=cells, seed=seed, featuresCol="unit", maxIter=10).fit(chosen).clusterCenters())
    chosen.unpersist()
    return centres


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v, cell) of rows(id, v), as unit vectors; zero vectors are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["v"].notna()]
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                length = np.linalg.norm(x, axis=1)
                ok = length > 0
                x = x[ok] / length[ok, None]
                if len(x):
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[ok], "v": list(x.astype(np.float32)), "cell": vectors.nearest_cell(x, sent.value)})

    return rows.mapInPandas(run, "id long, v array<float>, cell int")


def _measured(rows: DataFrame, centres: np.ndarray, n: int, k: int, recall: float, id_col: str, vector_col: str) -> int:
    """The fewest cells that hold this share of the k nearest rows, over a bounded sample of queries."""
    asked = _sample(rows, n, MEASURE_ROWS, 2, id_col, vector_col).persist()
    unit = {r[0]: np.array(r[1], float) for r in asked.collect() if r[0] is not None and r[1] is not None}
    place = {i: np.argsort(vectors.nearest_cells(x[None] / np.linalg.norm(x), centres)[0]) for i, x in unit.items() if x.any()}
    true = vectors.knn_batch(rows, asked, k, id_col, vector_col).select("query_id", "id")
    own = _placed(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), centres)
    found = true.join(own.select("id", "cell"), "id").collect()
    asked.unpersist()
    at = np.array([place[r["query_id"]][r["cell"]] for r in found if r["query_id"] in place], np.int64)
    return int(np.quantile(at, recall, method="higher")) + 1 if len(at) else len(centres)


def _found(sent, k: int, width: int):
    def run(batches):
        ids, q, cells = sent.value
        for pdf in batches:
            for row in pdf.itertuples():
                asks = np.flatnonzero((cells == row.cell).any(axis=1))
                if not len(asks):
                    continue
                own, x, codes, links, entries = _unpack(row)
                dead = np.isin(own, row.removed) if row.removed is not None and len(row.removed) else np.zeros(len(own), bool)
                unit, near = _unit(x), []
                for a in range(0, len(asks), at_a_time := max(1, AT_ONCE // (64 * len(own)))):
                    some = asks[a : a + at_a_time]
                    # removed rows are way points: the walk is wider by their number
                    found = walk(codes, links, entries, q[some].astype(np.float32), width + int(dead.sum()))
                    each = max(1, AT_ONCE // (16 * found.shape[1] * x.shape[1]))
                    near += [_nearest(own, unit, dead, some[i : i + each], q, found[i : i + each], k) for i in range(0, len(some), each)]
                asked, at, d = (np.concatenate(c) for c in zip(*near))
                yield pd.DataFrame({"query_id": ids[asked], "id": own[at], "distance": d})

    return run


def _nearest(own, unit, dead, asks, q, found, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, distance) of the k nearest live rows of those found for each of some queries."""
    i, c = np.nonzero(found >= 0)
    j = found[i, c]
    live = ~dead[j]
    i, j = i[live], j[live]
    d = np.round(1 - np.einsum("ij,ij->i", q[asks[i]], unit[j]), 9)
    order = np.lexsort((own[j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return asks[i[keep]], j[keep], d[keep]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
