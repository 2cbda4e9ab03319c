"""Substring dedup (operator 6): recompression over words.

Every word starts as a symbol.  A round first names runs (a maximal run of k equal symbols becomes one), then pairs (a hash
of the round splits the symbols in two classes; a left-class symbol followed by a right-class one becomes one).  A name is a
64-bit hash of what it stands for, so all tasks give equal strings equal names without exchanging a table of names: equal
substrings get the same interior symbols, whatever stands around them.

Each symbol's dependence, the stretch of words that decided that it is a symbol, is carried through the rounds.  A window of
`length` words is anchored by the symbol with the smallest hash among the widest kind whose dependence lies inside it.  So equal
windows share their anchor, and a symbol found in two documents reveals where a long repeat may be.  A window in which no round
made a symbol (such as one of few long runs) is its own anchor, by its 128-bit name.

Spark deals the symbols by name (see `firstseen`).  Each different piece around a shared symbol then sends its words, and the
same naming is done once more without hashes: words are numbered by their bytes, pairs of numbers by a table of pairs, up
to whole windows.  Equal numbers there are equal words; that alone decides what is removed.

Defined cases: a null or empty text has no words, and the hash of the empty string; rows with one id and different texts do
not remove from each other; repeated rows are each returned; a row with a null doc_id keeps everything and removes nothing;
an empty table gives no rows; other columns are ignored.  A text of any length is one row of symbols: it needs about 60 times its
size in memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Spans, exact_ids, exact_spans, mix, read_documents, slices, text_buffer, word_hashes, words_of
from .firstseen import PIECES, Copies, covered, deal_pieces, keyed, piece_batch, reports, runs_of, settle, wanted, wanted_batch, window_runs
from .neardup import runs

GAP = 1 << 8


class Level:
    """Symbols of all rows: name, first and last word, dependence [dl, dr), row."""

    def __init__(self, name, s, e, dl, dr, row):
        self.name, self.s, self.e, self.dl, self.dr, self.row = name, s, e, dl, dr, row

    def take(self, i):
        return Level(*(x[i] for x in (self.name, self.s, self.e, self.dl, self.dr, self.row)))


def _neighbours(x: Level, low: np.ndarray, high: np.ndarray):
    """(dependence start of the symbol before, dependence end of the one after); beyond the text's ends nothing is known."""
    before, after = low[x.row], high[x.row]
    same = x.row[1:] == x.row[:-1]
    before[1:] = np.where(same, x.dl[:-1], before[1:])
    after[:-1] = np.where(same, x.dr[1:], after[:-1])
    return before, after


def name_runs(x: Level, low, high) -> Level:
    n = len(x.name)
    if not n:
        return x
    before, after = _neighbours(x, low, high)
    head = np.ones(n, bool)
    head[1:] = (x.name[1:] != x.name[:-1]) | (x.row[1:] != x.row[:-1])
    at = np.flatnonzero(head)
    tail = np.append(at[1:], n) - 1
    k = tail - at + 1
    y = x.take(at)
    with np.errstate(over="ignore"):
        y.name = np.where(k > 1, mix(y.name * U64(0xFF51AFD7ED558CCD) + k.astype(U64)), y.name)
    y.e = x.e[tail]
    y.dl, y.dr = before[at], after[tail]
    return y


def name_pairs(x: Level, low, high, number: int) -> Level:
    n = len(x.name)
    if not n:
        return x
    before, after = _neighbours(x, low, high)
    with np.errstate(over="ignore"):
        left = (mix(x.name ^ U64(0x9E3779B97F4A7C15 * (number + 1) & (1 << 64) - 1)) >> U64(63)).astype(bool)
        join = np.zeros(n, bool)
        join[:-1] = left[:-1] & ~left[1:] & (x.row[1:] == x.row[:-1])
        second = np.zeros(n, bool)
        second[1:] = join[:-1]
        # a symbol that stays single depends on the neighbour that could have joined it
        dl = np.where(~left & ~second, before, x.dl)
        dr = np.where(left & ~join, after, x.dr)
        i = np.flatnonzero(join)
        name, e = x.name.copy(), x.e.copy()
        name[i] = mix(x.name[i] * U64(0xC4CEB9FE1A85EC53) + mix(x.name[i + 1] + U64(number)))
        e[i] = x.e[i + 1]
        dr[i] = x.dr[i + 1]
    return Level(name, x.s, e, dl, dr, x.row).take(~second)


def _range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of v over [lo, hi] for each of the (non-empty) ranges."""
    size = hi - lo + 1
    k = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), v.dtype)
    table = v
    for level in range(int(k.max(initial=0)) + 1):
        if level:
            half = 1 << (level - 1)
            table = np.minimum(table[:-half], table[half:])
        i = np.flatnonzero(k == level)
        if len(i):
            out[i] = np.minimum(table[lo[i]], table[hi[i] - (1 << level) + 1])
    return out


def _least(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where in [lo, hi] rank is smallest, for each of the (non-empty) ranges; rank holds different numbers."""
    where = np.empty(len(rank), np.int64)
    where[rank] = np.arange(len(rank))
    return where[_range_min(rank, lo, hi)]


def anchors(h: np.ndarray, row: np.ndarray, count: np.ndarray, length: int, rounds: int, spans: Spans):
    """(anchor, first window, number of windows, whether a symbol is the anchor) of the pieces of all rows.

    Windows are numbered by their first word's index in h.
    """
    n = len(count)
    first = np.cumsum(count) - count
    base = first + GAP * np.arange(1, n + 1)  # words' places, with room between the rows
    place = np.arange(len(h)) + GAP * (row + 1)
    low, high = base - 1, base + count + GAP // 2
    x = Level(h, place, place + 1, place, place + 1, row)
    for r in range(rounds):
        x = name_pairs(name_runs(x, low, high), low, high, r)
    windows = np.maximum(count - length + 1, 0)
    if not windows.sum():
        e = np.empty(0, np.int64)
        return h[:0], e, e, e.astype(bool)
    w = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    owner = np.repeat(np.arange(n), windows)
    at = base[owner] + w
    word = first[owner] + w
    x = x.take(np.flatnonzero(x.e - x.s > 1))  # what the rounds made
    span = x.e - x.s
    order = np.argsort(mix(x.name) >> U64(1) | (span < 3).astype(U64) << U64(63), kind="stable")  # of equal names the first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    total = int(high[-1]) + length + 2
    # symbols are in order of their dependence's start, and of its end
    below = np.cumsum(np.bincount(x.dl, minlength=total))  # symbols with dl <= place
    upto = np.cumsum(np.bincount(np.minimum(x.dr, total - 1), minlength=total))
    lo, hi = below[at - 1], upto[at + length] - 1
    some = lo <= hi
    best = np.full(len(at), -1, np.int64)
    i = np.flatnonzero(some)
    if len(i):
        best[i] = _least(rank, lo[i], hi[i])
    same = np.zeros(len(at), bool)
    same[1:] = (best[1:] == best[:-1]) & (best[1:] >= 0) & (owner[1:] == owner[:-1])
    start = np.flatnonzero(~same)
    name = np.empty(len(start), U64)
    made = some[start]
    name[made] = mix(x.name[best[start[made]]])
    alone = word[start[~made]]
    name[~made] = spans.name(alone, np.full(len(alone), length))[0]
    return name, word[start], np.diff(np.append(start, len(at))), made


def pieces_of(docs: np.ndarray, ths: np.ndarray, tls: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, rounds: int):
    """Columns of piece_batch() for some rows."""
    start, end, row = words_of(data, offsets)
    lanes = [word_hashes(data, start, end, k) for k in (0, 1)]
    spans = Spans(lanes, length)
    count = np.bincount(row, minlength=len(docs))
    a, p, n, _ = anchors(lanes[0], row, count, length, rounds, spans)
    h, g = spans.name(p, n + length - 1)
    owner = row[p] if len(p) else p
    first = np.cumsum(count) - count
    return a, h, g, ths[owner], tls[owner], docs[owner], p - first[owner], n


def first_holders(words: list[bytes], doc: np.ndarray, length: int):
    """(piece, window, smallest document that holds the window, windows of each piece) of pieces given as words with spaces between.

    Exact: words are numbered by their bytes, and stretches of words by pairs of numbers.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(words), np.uint8)
    start, end, row = words_of(data, offsets)
    count = np.bincount(row, minlength=len(words))
    windows = np.maximum(count - length + 1, 0)
    owner = np.repeat(np.arange(len(words)), windows)
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(at):
        return owner, at, at, windows
    name = exact_spans(exact_ids(data, start, end), length)[(np.cumsum(count) - count)[owner] + at]
    order = np.lexsort((doc[owner], name))
    begin, size = window_runs(name[order])
    least = np.empty(len(name), np.int64)
    least[order] = np.repeat(doc[owner[order[begin]]], size)
    return owner, at, least, windows


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, rounds: int = 3, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text][, carried columns]) of every row."""
    if not 2 <= length < GAP // 2:
        raise ValueError(f"length must lie between 2 and {GAP // 2 - 1}")
    texts = keyed(docs, id_col, text_col, carry)

    def scan(batches):
        copies = Copies()
        for b in batches:
            b = b.filter(pa.array(copies.fresh(*(b.column(k).to_numpy() for k in range(3)))))
            doc, th, tl = (b.column(k).to_numpy() for k in range(3))
            data, offsets = text_buffer(b.column(3))
            parts = []
            for i, j in slices(offsets, 1 << 20):
                parts.append(pieces_of(doc[i:j], th[i:j], tl[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, rounds))
            if parts:
                yield piece_batch(*(np.concatenate(c) for c in zip(*parts)))

    def cut(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(3))
            row, p, n, columns = wanted(b)
            edges = np.searchsorted(row, np.arange(b.num_rows + 1))
            for i, j in slices(offsets, 1 << 20):
                own = slice(edges[i], edges[j])
                part = data[offsets[i] : offsets[j]]
                start, end, of = words_of(part, offsets[i : j + 1] - offsets[i])
                # the words with one space after each
                long = end - start + 1
                after = np.cumsum(long)
                plain = np.append(part, np.uint8(0))[np.repeat(start - (after - long), long) + np.arange(int(long.sum()))]
                plain[after - 1] = 0x20
                first = np.searchsorted(of, row[own] - i) + p[own]
                lo, hi = (after - long)[first], after[first + n[own] + length - 2]
                size = hi - lo
                at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
                strings = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(plain[at].tobytes())])
                yield wanted_batch([c[own] for c in columns], strings.cast(pa.binary()))

    def report(batches):
        for t, borders in runs(batches, 1):
            raw = t.column("s").to_pylist()
            weight = np.concatenate(([0], np.cumsum([len(s) for s in raw])))[borders]
            for i, j in slices(weight, 1 << 22):  # whole anchors
                i, j = int(borders[i]), int(borders[j])
                part = t.slice(i, j - i)
                yield from reports(part, *first_holders(raw[i:j], part.column("doc").to_numpy(), length))

    def finish(batches):
        for b in batches:
            twins = b.column(2).to_pylist()
            out = []
            for text, twin, (p, n) in zip(b.column(1).to_pylist(), twins, runs_of(b.column(3))):
                words = text.encode().split()
                gone = covered(len(words), length, twin, p, n)
                if gone.any():
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                else:
                    kept = b" ".join(words)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), (kept.decode() if gone.any() else text) if with_text else None))
            cols = list(zip(*out)) or [(), (), (), ()]
            arrays = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(cols[3], pa.string())], [*names, "kept_text"]
            if carry:
                arrays, names = [*arrays, b.column(4)], [*names, "carried"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    made = texts.filter(F.col("doc_id").isNotNull()).select("doc_id", "th", "tl", "text").mapInArrow(scan, PIECES)
    if carry:
        schema += f", carried {texts.schema['carried'].dataType.simpleString()}"
    out = settle(texts, deal_pieces(made), cut, report, finish, schema)
    return out.select(*[c for c in out.columns if c != "carried"], "carried.*") if carry else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest([md5(array_to_string(w[i:i + 49], ' ')) for i in range(1, len(w) - 48)]) AS g FROM w WHERE len(w) >= 50),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, list(p) AS ps FROM s JOIN f USING (g) WHERE doc_id > first GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten([range(p, p + 50) for p in ps])) AS gone FROM r),
k AS (SELECT w.doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
