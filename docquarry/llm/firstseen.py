"""Removal of fixed-length windows that an earlier document holds too: the frame of both substring operators.

A window is `length` consecutive symbols of one document.  Whatever the symbols are, an operator names for each window an
anchor that depends on the window's content alone, so equal windows have equal anchors at equal offsets.  Consecutive
windows with one anchor form a piece.

* Copies of a text are one string: pieces carry the text's 128-bit key (th, tl), and of the documents with one text all but
  the smallest id lose every window.
* Equal pieces (equal 128-bit names h, g) are one string that several documents hold.
* One shuffle deals pieces by anchor.  Anchors of one text are dropped.  Of the others each different piece sends its
  symbols once, to the operator's exact method, which reports for every window the smallest document that holds it.
* A document loses the windows so reported, and a further holder of an equal piece those of a piece that was reported: without
  the method's report nothing is removed.
* Every removal carries the document it is due to (`by`), and holds if that is smaller than the text's own smallest id.

Texts move through one shuffle, by doc_id, whose output both later passes read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, materialise, mix
from .neardup import runs

_COLUMNS = ["a", "h", "g", "th", "tl", "doc", "p", "n", "by"]
#: dup: a further holder of a piece that its Arrow batch holds already; more: the piece has such holders.
PIECES = ", ".join(f"{c} long" for c in _COLUMNS) + ", dup boolean, more boolean"
#: Rows of PIECES whose anchor several texts hold.  look: the piece's symbols are to be sent, and h and g are 0 if it has no
#: further holder; else a further holder, whose anchor and document are of no more use.
DECIDED = ", ".join(f"{c} long" for c in _COLUMNS) + ", look boolean"
#: Windows to remove, or (th null) a piece that the exact method has reported.
FOUND = "th long, tl long, p long, n long, by long, h long, g long"


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text, th, tl[, carried: a struct of other columns]); a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [F.struct(*carry).alias("carried")] if carry else []
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *more)
    return named.withColumns({"th": F.xxhash64("text"), "tl": F.xxhash64(F.md5("text"))})


class Copies:
    """Which rows of a task to look at: each text once, for its smallest document so far."""

    def __init__(self):
        self.seen: dict[tuple, int] = {}

    def fresh(self, docs: np.ndarray, ths: np.ndarray, tls: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), bool)
        for i, (d, *t) in enumerate(zip(docs.tolist(), ths.tolist(), tls.tolist())):
            if d < self.seen.get(tuple(t), 1 << 63):
                self.seen[tuple(t)] = d
                out[i] = True
        return out


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64, copy=False))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Mask of the rows that begin a group of equal keys, of rows in order of the keys."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = False
        for k in keys:
            first[1:] |= k[1:] != k[:-1]
    return first


def _leads(first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of x in the first row of each row's group."""
    return x[np.flatnonzero(first)][np.cumsum(first) - 1] if len(x) else x


def piece_batch(a, h, g, th, tl, doc, p, n) -> pa.RecordBatch:
    """Rows of PIECES; further holders of a piece are spread, so that a passage in very many texts loads no single task."""
    order = np.lexsort((p, doc, g, h, a))
    a, h, g, th, tl, doc, p, n = (x[order] for x in (a, h, g, th, tl, doc, p, n))
    first = _heads(a, h, g)
    lead = _leads(first, doc)
    dup = doc > lead
    more = np.add.reduceat(dup, np.flatnonzero(first))[np.cumsum(first) - 1] > 0 if len(a) else dup
    with np.errstate(over="ignore"):
        a = np.where(dup, mix(th.astype(np.int64).view(U64) + p.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15)), a)
    cols = [*map(_i64, (a, h, g, th, tl, doc, p, n, lead)), pa.array(dup), pa.array(more)]
    return pa.RecordBatch.from_arrays(cols, names=[*_COLUMNS, "dup", "more"])


def decide(a, h, g, th, tl, doc, p, n, by, dup, more) -> pa.RecordBatch | None:
    """Whole anchors: rows of DECIDED."""
    order = np.lexsort((p, doc, g, h, a))
    a, h, g, th, tl, doc, p, n, by, dup, more = (x[order] for x in (a, h, g, th, tl, doc, p, n, by, dup, more))
    anchor = _heads(a)
    at = np.flatnonzero(anchor)
    held = np.cumsum(anchor) - 1
    if not len(at):
        return None
    live = (np.minimum.reduceat(th, at) != np.maximum.reduceat(th, at)) | (np.add.reduceat(more & ~dup, at) > 0)
    lead = _leads(_heads(a, h, g), doc)
    look = ~dup & live[held] & (doc == lead)  # a document may hold its piece at several places
    piece = _heads(a, h, g)
    further = np.add.reduceat((doc > lead) | more, np.flatnonzero(piece))[np.cumsum(piece) - 1] > 0
    h, g = np.where(look & ~further, h.dtype.type(0), h), np.where(look & ~further, g.dtype.type(0), g)
    by = np.where(look, 0, np.where(dup, by, lead))
    a, doc = np.where(look, a, a.dtype.type(0)), np.where(look, doc, 0)
    i = np.flatnonzero(look | dup | live[held])
    if not len(i):
        return None
    cols = [_i64(x[i]) for x in (a, h, g, th, tl, doc, p, n, by)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(look[i])], names=[*_COLUMNS, "look"])


def by_anchor(batches):
    """decide() over PIECES that are sorted by anchor."""
    for t, _ in runs(batches, 1):
        got = decide(*(t.column(c).to_numpy(zero_copy_only=False) for c in (*_COLUMNS, "dup", "more")))
        if got is not None:
            yield got


def window_runs(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs of equal values."""
    if not len(name):
        e = np.empty(0, np.int64)
        return e, e
    start = np.concatenate(([0], np.flatnonzero(name[1:] != name[:-1]) + 1))
    return start, np.diff(np.append(start, len(name)))


def deal_pieces(pieces: DataFrame) -> DataFrame:
    """PIECES to DECIDED, through one shuffle by anchor."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(by_anchor, DECIDED)


#: What a piece that is to be looked at asks of its text.
WANT = ["a", "h", "g", "p", "n"]


def settle(texts: DataFrame, dealt: DataFrame, cut, report, finish, schema: str) -> DataFrame:
    """The operator's rows.

    texts: keyed(); dealt: DECIDED.  cut(Arrow batches of doc_id, th, tl, text, want array<struct<WANT>>) gives rows of
    WANTED: a piece with its symbols.  report(Arrow batches of WANTED in order of a) gives FOUND.  finish(Arrow batches of
    doc_id, text, twin, runs[, carried]) makes the final rows.
    """
    dealt = materialise(dealt, "dealt")
    want = dealt.filter("look").groupBy(F.col("doc").alias("doc_id"), "th", "tl").agg(F.collect_list(F.struct(*WANT)).alias("want"))
    known = texts.filter(F.col("doc_id").isNotNull())
    # dealt out by hand, so that both joins read one shuffle of the texts
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["doc_id", "th", "tl"]
    moved = known.repartition(parts, *key)
    pieces = moved.join(want, key).select(*key, "text", "want").mapInArrow(cut, WANTED)
    found = materialise(pieces.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(report, FOUND), "found")
    reported = found.filter("th IS NULL").select("h", "g")
    cols = ["th", "tl", "p", "n", "by"]
    # reported pieces may be listed twice: a semi-join does not mind, and without an aggregate its hot pieces can be split
    further = dealt.filter("NOT look").join(reported, ["h", "g"], "left_semi").select(*cols)
    removals = found.filter("th IS NOT NULL").select(*cols).unionByName(further)
    # each document's smallest twin, without its text
    narrow = known.select(*key).distinct()
    first = narrow.groupBy("th", "tl").agg(F.min("doc_id").alias("lead"))
    lists = removals.join(first, ["th", "tl"]).filter("by < lead").groupBy("th", "tl").agg(F.collect_list(F.struct("p", "n")).alias("runs"))
    info = narrow.join(first, ["th", "tl"]).join(lists, ["th", "tl"], "left").select(*key, (F.col("doc_id") > F.col("lead")).alias("twin"), "runs")
    # a twin needs no runs: all its windows go
    info = info.withColumn("runs", F.when(~F.col("twin"), F.col("runs")))
    more = ["carried"] if "carried" in texts.columns else []
    out = moved.join(info, key).select("doc_id", "text", "twin", "runs", *more).mapInArrow(finish, schema)
    alone = texts.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(False).alias("twin"), F.lit(None).cast("array<struct<p:bigint,n:bigint>>").alias("runs"), *more)
    return out.unionByName(alone.mapInArrow(finish, schema))


#: A piece with its symbols.
WANTED = "a long, h long, g long, th long, tl long, doc long, p long, s binary"
_WANTED = ["a", "h", "g", "th", "tl", "doc", "p", "s"]


def wanted(batch: pa.RecordBatch):
    """(row, start, windows, columns of WANTED but s) of all pieces that the rows of a batch ask for."""
    column = batch.column(4)
    sizes = np.array(pa.compute.list_value_length(column).to_pylist(), np.int64)
    flat = column.flatten()
    a, h, g, p, n = (flat.field(k).to_numpy() for k in range(5))
    row = np.repeat(np.arange(len(sizes)), sizes)
    doc, th, tl = (batch.column(k).to_numpy()[row] for k in range(3))
    return row, p, n, [a, h, g, th, tl, doc, p]


def wanted_batch(columns: list[np.ndarray], strings: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(_i64, columns), strings], names=_WANTED)


def reports(pieces: pa.Table, owner: np.ndarray, at: np.ndarray, least: np.ndarray, windows: np.ndarray):
    """FOUND from what an exact method says: window `at` of row `owner` is held first by document `least`.

    windows: how many windows each row has; a piece with further holders is reported if all of its windows are.
    """
    h, g, th, tl, doc, p = (pieces.column(c).to_numpy() for c in ("h", "g", "th", "tl", "doc", "p"))
    hit = np.flatnonzero(doc[owner] > least)
    own, at_, by = owner[hit], at[hit], least[hit]
    order = np.lexsort((at_, own))
    own, at_, by = own[order], at_[order], by[order]
    border = (own[1:] != own[:-1]) | (at_[1:] != at_[:-1] + 1) | (by[1:] != by[:-1])
    start, n = window_runs(np.cumsum(np.concatenate(([0], border))) if len(own) else own)
    o = own[start]
    whole = np.flatnonzero((np.bincount(owner, minlength=len(doc)) == windows) & ((h != 0) | (g != 0)))
    none = pa.nulls(len(whole), pa.int64())
    pad = pa.nulls(len(o), pa.int64())
    names = ["th", "tl", "p", "n", "by", "h", "g"]
    if len(o):
        yield pa.RecordBatch.from_arrays([*map(_i64, (th[o], tl[o], p[o] + at_[start], n, by[start])), pad, pad], names=names)
    if len(whole):
        yield pa.RecordBatch.from_arrays([none] * 5 + [_i64(h[whole]), _i64(g[whole])], names=names)


def covered(count: int, length: int, twin: bool, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mask of the symbols that removed windows cover; (starts, sizes) are runs of window starts."""
    edge = np.zeros(count + 1, np.int64)
    if twin:
        if count >= length:
            return np.ones(count, bool)
    elif len(starts):
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """The runs column of settle() as arrays, row by row."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    p, k = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    return [(p[e - s : e], k[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())] if n else []
