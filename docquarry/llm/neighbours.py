"""Approximate nearest neighbours by inner product: probed lists, scanned by an adaptive number of dimensions.

Plan.  Equal vectors are one entry with its smallest ids (no more than a result can hold, and one for the query itself, can matter).  An entry gets one more
dimension, sqrt(M^2 - |x|^2) with M the largest length, so that the nearest by inner product are the nearest by distance.  List centres are fitted on a bounded sample;
every entry goes into the list of its nearest centre, rotated by a random orthogonal matrix and stored with its columns in blocks, and lists are cut into parts
of bounded size.  A query visits the lists of its nearest centres.  In a list the distances of all its entries grow block by block; after d of D columns
an entry is abandoned if its distance so far, times D/d, is beyond (1 + EPSILON / sqrt(d))^2 times the square of the k-th distance known: by the
hypothesis that its full distance is no more than that, so much so early is improbable.  The nearest list comes first and gives the threshold that the
others start with.  What survives is scored exactly on the original vectors.

How many lists to visit is measured: rows of a bounded sample are searched exactly against all entries (one pass), and the fewest lists that hold the
asked share of their neighbours are taken.

Both sides of a list are dealt in parts, every part of entries against every part of queries, so no group grows with the data.

Odd cases.  A vector that is null, empty or zero, or holds null or non-finite entries, takes no part, nor does one of other than the commonest length, nor a row
without an id.  An id of several rows counts once, with the smallest of its vectors.  Ties go to the smaller id; copies of a vector, the query's own too,
are candidates with ids of their own.  Fewer candidates than asked for: all.  No rows: no rows.  Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise
from .embeddings import usable

K, MODULUS = 20, 20
#: Rows at most that centres are fitted on, and that the number of lists to visit is measured with.
FIT_ROWS, MEASURE_ROWS = 32_768, 256
#: Lists at most; share of true neighbours that the visited lists are to hold.
MOST_LISTS, TARGET = 16_384, 0.97
#: Columns in a block; strictness of the hypothesis test.
BLOCK, EPSILON = 16, 2.1
#: Entries and queries of a part of a list.
ENTRIES, ASKS = 2048, 512
SEED = 7


@dataclass
class Lists:
    """Where vectors go: largest length, centres (with the added dimension), rotation."""

    longest: float
    centres: np.ndarray
    rotation: np.ndarray

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """With the added dimension, which is zero for a query; lengths are in units of the longest."""
        x = x / self.longest
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return np.column_stack((x, more))

    def order(self, lifted: np.ndarray, most: int) -> np.ndarray:
        """The `most` nearest lists of each vector, nearest first."""
        d = (self.centres**2).sum(axis=1) - 2 * lifted @ self.centres.T
        if most < d.shape[1]:
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
        return np.argsort(d, axis=1, kind="stable")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, vector): one entry for each vector of rows(id, vector), its k + 1 smallest ids in order; rep is the first of them."""
    one = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    one = one.filter(F.exists("vector", lambda x: x != 0)).withColumn("h", F.xxhash64("vector"))
    # Spark cuts each task's rows to the first k + 1 of a vector before they are shuffled
    first = one.withColumn("at", F.row_number().over(Window.partitionBy("h", "vector").orderBy("id"))).filter(F.col("at") <= k + 1)
    out = first.groupBy("h", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return out.select(F.get("ids", F.lit(0)).alias("rep"), "ids", "vector")


def _sampled(entries: DataFrame, n: int, most: int, salt: int) -> np.ndarray:
    """About `most` vectors at most, chosen by a hash of their ids."""
    share = min(1.0, 0.9 * most / max(n, 1))
    rows = entries.filter(F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30))).select("rep", "vector").limit(most).collect()
    rows.sort()
    return np.array([r["vector"] for r in rows], float)


def fit(entries: DataFrame, n: int, length: int) -> Lists:
    """Centres from a bounded sample of entries(rep, vector), as many as the square root of their number."""
    longest = float(entries.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0])
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((length + 1, length + 1)))[0]
    out = Lists(longest, np.empty((0, length + 1)), rotation)
    x = out.lifted(_sampled(entries, n, FIT_ROWS, 1))
    lists = max(1, min(int(n**0.5), MOST_LISTS, len(x)))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(10):
        at = np.concatenate([((centres**2).sum(axis=1) - 2 * part @ centres.T).argmin(axis=1) for part in np.array_split(x, -(-len(x) // 1024))])
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        held = np.bincount(at, minlength=lists)
        centres = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centres)
    out.centres = centres
    return out


def build(entries: DataFrame, lists: Lists) -> DataFrame:
    """The stored index: (list, part, rep, ids, vector, columns) with the rotated entry's columns in blocks."""
    spark = entries.sparkSession
    sent = spark.sparkContext.broadcast(lists)

    def run(batches):
        own = sent.value
        for pdf in batches:
            if len(pdf):
                x = own.lifted(matrix(pdf["vector"]))
                blocks = np.split((x @ own.rotation).astype(np.float32), range(BLOCK, x.shape[1], BLOCK), axis=1)
                yield pdf.assign(list=own.order(x, 1)[:, 0], columns=[list(row) for row in zip(*blocks)])

    kind = entries.schema["vector"].dataType.simpleString()
    placed = entries.select("rep", "ids", "vector").mapInPandas(run, f"rep long, ids array<long>, vector {kind}, list int, columns array<array<float>>")
    return materialise(placed, "lists")


def _sizes(rows: DataFrame, most: int, name: str) -> DataFrame:
    """(list, name): in how many parts of about `most` rows each list is dealt; a row for each list, of which there are MOST_LISTS at most."""
    return rows.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))


def _scan(sent, k: int):
    """For a part of a list and a part of its queries: the nearest k entries of each query, as (rep, found, score, distance)."""

    def run(key, entries: pd.DataFrame, asks: pd.DataFrame):
        names = ["rep", "found", "score", "distance"]
        if not len(entries) or not len(asks):
            return pd.DataFrame({c: [] for c in names})
        own = sent.value
        raw, q = matrix(entries["vector"]), matrix(asks["vector"])
        turned = own.lifted(q, query=True) @ own.rotation
        blocks = [np.stack([row[b] for row in entries["columns"]]).astype(float) for b in range(len(entries["columns"].iloc[0]))]
        i, j = scan(blocks, turned, asks["bound"].to_numpy(float), k)
        score = np.einsum("ij,ij->i", q[i], raw[j])
        found, rep = entries["rep"].to_numpy()[j], asks["rep"].to_numpy()[i]
        order = np.lexsort((found, -score, rep))
        i, j, score, found, rep = i[order], j[order], score[order], found[order], rep[order]
        place = np.arange(len(rep)) - np.searchsorted(rep, rep)
        keep = place < k
        squared = (((q[i[keep]] / own.longest) ** 2).sum(axis=1)) + 1 - 2 * score[keep] / own.longest**2
        return pd.DataFrame(dict(zip(names, (rep[keep], found[keep], score[keep], squared))))

    return run


def scan(blocks: list[np.ndarray], turned: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) of those that no test abandons, the nearest k of each query among them.

    blocks: the entries' rotated columns; turned: the rotated queries; bound: the square of a distance within which k entries are known (or infinity).
    """
    n, width = len(blocks[0]), turned.shape[1]
    # the first entries are measured in full, and tighten the bounds
    if n > k:
        first = np.hstack([b[: max(k, n // 8)] for b in blocks])
        d = (turned**2).sum(axis=1)[:, None] + (first**2).sum(axis=1) - 2 * turned @ first.T
        bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-6) + 1e-9)
    i = j = partial = None
    done = 0
    for b in blocks:
        part, done = turned[:, done : done + b.shape[1]], done + b.shape[1]
        # rounding of stored columns is far below this slack
        limit = bound * (done / width if done < width else 1.0) * ((1 + EPSILON / done**0.5) ** 2 if done < width else 1.0) + 1e-6
        if i is None:
            whole = (part**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * part @ b.T
            i, j = np.nonzero(whole <= limit[:, None])
            partial = whole[i, j]
        else:
            if len(i) * 4 > len(turned) * n:  # most are left: one matrix product is cheaper than pair by pair
                whole = (part**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * part @ b.T
                partial = partial + whole[i, j]
            else:
                partial = partial + ((part[i] - b[j]) ** 2).sum(axis=1)
            keep = partial <= limit[i]
            i, j, partial = i[keep], j[keep], partial[keep]
    return i, j


def visits(entries: DataFrame, lists: Lists, n: int, k: int, target: float = TARGET) -> int:
    """The fewest lists to visit for this share of the k nearest entries: of a bounded sample, searched exactly against all entries in one pass."""
    asked = _sampled(entries, n, MEASURE_ROWS, 2)
    if not len(asked) or len(lists.centres) == 1:
        return len(lists.centres)
    sent = entries.sparkSession.sparkContext.broadcast((lists, asked))

    def run(batches):
        own, q = sent.value
        rank = np.argsort(own.order(own.lifted(q, query=True), len(own.centres)), axis=1)
        best: list = [(np.empty(0), np.empty(0, int))] * len(q)
        for pdf in batches:
            if len(pdf):
                x, at = matrix(pdf["vector"]), pdf["list"].to_numpy()
                s = q @ x.T
                for i in range(len(q)):
                    score, where = np.concatenate((best[i][0], s[i])), np.concatenate((best[i][1], rank[i, at]))
                    top = np.argpartition(-score, min(k, len(score) - 1))[: k + 1]
                    best[i] = score[top], where[top]
        for i, (score, where) in enumerate(best):
            yield pd.DataFrame({"q": i, "score": score, "place": where})

    found = entries.select("vector", "list").mapInPandas(run, "q int, score double, place int")
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("at") <= k + 1)
    places = np.array([r[0] for r in best.select("place").collect()])
    return int(np.quantile(places, target, method="higher")) + 1 if len(places) else len(lists.centres)


def _asks(queries: DataFrame, lists: Lists, start: int, stop: int) -> DataFrame:
    """(rep, vector, list, bound) of queries(rep, vector, bound): a row for each list from the start-th nearest on."""
    sent = queries.sparkSession.sparkContext.broadcast(lists)

    def run(batches):
        own = sent.value
        for pdf in batches:
            if len(pdf):
                near = own.order(own.lifted(matrix(pdf["vector"]), query=True), stop)[:, start:]
                yield pdf.assign(list=list(near))

    kind = queries.schema["vector"].dataType.simpleString()
    rows = queries.select("rep", "vector", "bound").mapInPandas(run, f"rep long, vector {kind}, bound double, list array<int>")
    return rows.withColumn("list", F.explode("list"))


def _visit(index: DataFrame, asks: DataFrame, lists: Lists, k: int) -> DataFrame:
    """(rep, found, score, distance): both sides of each list in parts, every part against every part of the other."""
    sizes = F.broadcast(_sizes(index, ENTRIES, "entry_parts").join(_sizes(asks, ASKS, "ask_parts"), "list"))
    part = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    e = index.select("list", "rep", "vector", "columns").join(sizes, "list").withColumn("ep", part(11, "entry_parts")).withColumn("ap", each("ask_parts"))
    a = asks.join(sizes, "list").withColumn("ap", part(12, "ask_parts")).withColumn("ep", each("entry_parts"))
    key = ["list", "ep", "ap"]
    pairs = e.select(*key, "rep", "vector", "columns").groupBy(*key).cogroup(a.select(*key, "rep", "vector", "bound").groupBy(*key))
    sent = index.sparkSession.sparkContext.broadcast(lists)
    return pairs.applyInPandas(_scan(sent, k), "rep long, found long, score double, distance double")


def search(index: DataFrame, queries: DataFrame, lists: Lists, probes: int, k: int) -> DataFrame:
    """(rep, found, score): the k nearest entries of the index for queries(rep, vector), in the `probes` lists nearest to each."""
    near = materialise(_visit(index, _asks(queries.withColumn("bound", F.lit(float("inf"))), lists, 0, 1), lists, k), "nearest")
    if probes <= 1:
        far = near.limit(0)
    else:
        place = Window.partitionBy("rep").orderBy("distance", "found")
        bound = near.withColumn("at", F.row_number().over(place)).filter(F.col("at") == k).select("rep", F.col("distance").alias("bound"))
        known = queries.join(bound, "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        far = _visit(index, _asks(known, lists, 1, probes), lists, k)
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "found")
    return near.unionByName(far).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k).select("rep", "found", "score")


def neighbours(embeddings: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k rows of embeddings with the largest inner product for each row of queries(id), itself left out."""
    spark = embeddings.sparkSession
    rows, length = usable(embeddings, id_col, vector_col)
    empty = f"query_id long, rank int, {id_col} long, score double"
    if not length:
        return spark.createDataFrame([], empty)
    entries = materialise(distinct_vectors(rows.select(F.col("id").cast("long").alias("id"), "vector"), k), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], empty)
    lists = fit(entries, n, length)
    index = build(entries, lists)
    probes = visits(index, lists, n, k)
    # a query stands for all ids of its vector; of those that entries do not name, the table of ids knows
    ids = rows.filter("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("vector").alias("vector"))
    asked = ids.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi").withColumn("h", F.xxhash64("vector"))
    named = materialise(asked.join(entries.select(F.xxhash64("vector").alias("h"), "vector", "rep"), ["h", "vector"]).select("id", "rep", "vector"), "asked")
    distinct = named.groupBy("rep").agg(F.first("vector").alias("vector"))
    found = search(index, distinct, lists, probes, k + 1)
    each = found.join(entries.select(F.col("rep").alias("found"), "ids"), "found").select("rep", "score", F.explode("ids").alias("other"))
    place = Window.partitionBy("rep").orderBy(F.desc("score"), "other")
    best = each.withColumn("at", F.row_number().over(place)).filter(F.col("at") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("at", "other", "score"))).alias("best"))
    # the query's own id goes, and what is left is numbered
    own = named.select("id", "rep").join(best, "rep").select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.other").alias(id_col), F.col("b.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(e, e.filter(F.col("vec_id") % MODULUS == 0).select("vec_id"))
