"""Suffix-array dedup (operator 2): column-wise construction of a collection's Burrows-Wheeler transform, over bytes.

The exact step is `bwt_columns`.  Over a collection of strings each round inserts one symbol of every string, right to left:
a stable sort of the current transform by symbol is the order of the longer suffixes, so one sequential pass over the
transform, the suffix positions and the common prefixes writes their successors.  A prefix shared with the predecessor is one
more than the smallest on the way between two neighbouring occurrences of a symbol; only pairs that touch a suffix of the
last round are looked at.  Neighbours in the final order that share `length` bytes are equal windows.  What it reports is what
is removed (see `firstseen`).

The transform of a whole corpus would be read once for each byte of its longest text.  So strings that can matter are cut
out first, and dealt to tasks by content: every window of `length` bytes has an anchor, the `gram` bytes inside it with the
smallest hash; consecutive windows of one anchor form a piece of under 2 * length bytes.  Equal windows have equal anchors,
so anchors seen in one text alone are dropped, and so are pieces that share no side of their anchor.  Equal texts are one
string of the collection, and so are equal pieces.  Each task builds the transforms of whole anchors' different pieces, about
`group` strings at a time.  The sequential files are arrays of one such group.

Defined cases: a null or empty text has no bytes, and the hash of the empty string; rows with one id and different texts do
not remove from each other; repeated rows are each returned; a row with a null doc_id keeps everything and removes nothing;
an empty table gives no rows; other columns are ignored.  A text beyond 4 MB is cut into overlapping segments while anchors are
sought.  Bytes are removed one by one, so a kept text may not be UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LANES, U64, Spans, mix, read_documents, slices, text_buffer
from .firstseen import DECIDED, Copies, covered, decide, keyed, reports, runs_of, settle, wanted, wanted_batch
from .neardup import runs

SEGMENT = 1 << 21


def bwt_columns(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, bytes each shares with the one before) of the strings that data holds one after another.

    A suffix is its place in data, counting one end mark after each string; end marks are smaller than bytes, and their
    order is that of the strings.
    """
    m = len(sizes)
    ends = np.cumsum(sizes + 1)  # places of the end marks, after one more mark in front
    kinds = np.zeros(256, bool)
    kinds[data] = True
    rank = np.cumsum(kinds)  # order-preserving; a radix sort of one byte takes one pass
    text = np.zeros(len(data) + m + 1, np.uint8 if rank[-1] < 256 else np.uint16)
    inner = np.ones(len(text), bool)
    inner[0] = False
    inner[ends] = False
    text[inner] = rank[data]
    # the transform and the common prefixes of the suffixes so far; the m end marks stay in front
    symbol, common = text[ends - 1], np.zeros(m, np.uint16)
    place = ends  # in text, of the last round's suffixes, in order
    fresh, come = np.ones(m, bool), np.arange(m)
    while len(place):
        to = np.argsort(symbol, kind="stable")
        to = to[len(symbol) - np.count_nonzero(symbol) :]
        new = np.flatnonzero(fresh[to])  # a suffix of the last round, with the symbol before it, is one of this round
        if not len(new):
            break
        # in order of their places in the transform, so that `place` is read in order
        place = place[np.searchsorted(come, to[new])] - 1
        # pairs of neighbouring occurrences of a symbol of which one is such a suffix
        near = np.zeros(len(to) + 1, bool)
        near[new] = True
        near[new + 1] = True
        q = np.flatnonzero(near[:-1])
        before = np.maximum(q - 1, 0)
        alike = (symbol[to[q]] == symbol[to[before]]) & (q > 0)
        values = np.zeros(len(q), np.uint16)
        if alike.any():
            low, high = to[before[alike]] + 1, to[q[alike]] + 1
            back = np.argsort(-low, kind="stable")
            span = np.empty(2 * len(back), np.int64)
            span[0::2], span[1::2] = low[back], high[back]
            some = np.empty(len(back), np.uint16)
            some[back] = np.minimum.reduceat(np.append(common, np.uint16(0)), span)[0::2] + np.uint16(1)
            values[alike] = some
        fresh, come = np.zeros(m + len(to), bool), m + new
        fresh[come] = True
        old = ~fresh
        grown = np.empty(m + len(to), symbol.dtype)
        grown[old] = symbol
        grown[come] = text[place - 1]
        longer = np.empty(m + len(to), np.uint16)
        longer[old] = common
        longer[m + q] = values
        symbol, common = grown, longer
    # walk every string through the transform for the suffixes' places
    to = np.argsort(symbol, kind="stable")
    to = to[len(symbol) - np.count_nonzero(symbol) :]
    step = np.full(len(symbol), -1, np.int64)
    step[to] = np.arange(m, m + len(to))
    order = np.empty(len(symbol), np.int64)
    at, place = np.arange(m), ends - 1
    while len(at):
        order[at] = place
        at = step[at]
        on = at >= 0
        at, place = at[on], place[on] - 1
    return order, common


def first_holders(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, length: int):
    """(string, window, smallest document that holds the window) of each window of `length` bytes, as the transform tells."""
    order, shared = bwt_columns(data, sizes)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[order]
    at = order - begin[owner]
    whole = sizes[owner] - at >= length
    border = np.flatnonzero(shared < length)
    least = np.minimum.reduceat(doc[owner], border)
    least = np.repeat(least, np.diff(np.append(border, len(order))))
    return owner[whole], at[whole], least[whole]


class Grams:
    """64-bit hashes of the `gram` bytes from each place on, for one lane; made where they are asked for."""

    def __init__(self, data: np.ndarray, gram: int, lane: int):
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[: len(data)]
        self.mask = U64((1 << 8 * min(gram, 8)) - 1)
        self.more = [*range(8, gram - 7, 8), *([gram - 8] if gram > 8 and gram % 8 else [])]
        self.odd, self.plus = LANES[lane], LANES[1 - lane]

    def _first(self, v):
        return mix((v & self.mask) * self.odd + self.plus)

    def all(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            v = self._first(self.eight)
            h = v[:n]
            for done in self.more:
                h = mix(h * self.plus + v[done : done + n])
        return h

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = self._first(self.eight[at])
            for done in self.more:
                h = mix(h * self.plus + self._first(self.eight[at + done]))
        return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(anchor, row, first window, windows, piece's names, sides) of the pieces of all rows.

    A window holds at least half of its bytes beside the anchor on one side, so two equal windows share the anchor with
    `side` bytes to its left or to its right.  sides: 16 bits of the hash of each; 0 where the row ends before.
    """
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty.view(U64), empty, empty, empty, empty.view(U64), empty.view(U64), empty.view(U64)
    h = Grams(data, gram, 0).all(n - gram + 1)
    # the smallest hash over `width` places, ties to the first; 32 bits of hash and as many of place
    best = h >> U64(32) << U64(32) | np.arange(len(h), dtype=U64)
    width, have = length - gram + 1, 1
    while have < width:  # smallest over `have` places, doubled
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
    w = np.flatnonzero(np.arange(len(best)) + length <= offsets[1:][row])
    best, row = best[w], row[w]
    same = np.zeros(len(w), bool)
    same[1:] = (best[1:] == best[:-1]) & (row[1:] == row[:-1])
    start = np.flatnonzero(~same)
    at = (best[start] & U64((1 << 32) - 1)).astype(np.int64)
    row, p, count = row[start], w[start], np.diff(np.append(start, len(w)))
    side = (length - gram + 1) // 2
    if gram >= 8:  # blocks of `gram` bytes tile a piece
        piece = Spans.tiled([h, Grams(data, gram, 1)], gram)
    else:
        piece = Spans([Grams(data, 1, lane).all(n) for lane in (0, 1)], min(length, max(1, side)))
    name, check = piece.name(p, count + length - 1)
    lo, hi = np.maximum(at - side, 0), np.minimum(at + gram + side, n)
    left, right = np.ones(len(at), U64), np.ones(len(at), U64)
    if side >= piece.block:
        i = np.flatnonzero(at - lo == side)
        left[i] = piece.name(lo[i], np.full(len(i), side))[0] >> U64(48) | U64(1)
        i = np.flatnonzero(hi - at == gram + side)
        right[i] = piece.name(at[i] + gram, np.full(len(i), side))[0] >> U64(48) | U64(1)
    left[at - side < offsets[row]] = 0
    right[at + gram + side > offsets[1:][row]] = 0
    return h[at], row, p - offsets[row], count, name, check, left << U64(16) | right


BLOBS = ["docs", "keys", "a", "h", "g", "sides", "t", "p", "n"]
#: Buckets for each shuffle partition: a task holds one at a time.
FINE = 4
DEALT = "bucket long, " + ", ".join(f"{x} binary" for x in BLOBS)


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high bytes of small numbers cost nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def deal(doc, th, tl, a, row, p, n, h, g, sides, buckets):
    """Pieces of an Arrow batch as one compressed row for each bucket: sorted by anchor, so differences are small."""
    bucket = (a & U64(0xFFFFFF)).astype(np.int64) % buckets
    a = a >> U64(24)  # 40 bits: a chance meeting of two anchors costs a comparison, no result
    order = np.lexsort((a, bucket))
    a, row, p, n, h, g, sides, bucket = (x[order] for x in (a, row, p, n, h, g, sides, bucket))
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    out = []
    for i, j in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist()):
        own = slice(i, j)
        texts, t = np.unique(row[own], return_inverse=True)
        low = int(doc[texts].min())
        keys = np.stack((th[texts], tl[texts])).astype("<i8").tobytes()
        blobs = [low.to_bytes(8, "little", signed=True) + _packed(doc[texts] - low), keys, _packed(np.diff(a[own], prepend=U64(0)))]
        blobs += [h[own].tobytes(), g[own].tobytes(), *(_packed(x) for x in (sides[own], t, p[own], n[own]))]
        out.append((int(bucket[i]), *blobs))
    if out:
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["bucket", *BLOBS])


def _twice(key: np.ndarray, text: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Mask of the rows whose key (and more) another text has too."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.lexsort((text, *more, key))
    same = np.ones(len(key) - 1, bool)
    for x in (key, *more):
        same &= x[order][1:] == x[order][:-1]
    start = np.concatenate(([0], np.flatnonzero(~same) + 1))
    end = np.append(start[1:], len(key)) - 1
    d = text[order]
    out = np.empty(len(key), bool)
    out[order] = np.repeat(d[start] != d[end], end - start + 1)
    return out


def shared_anchors(batches):
    """DEALT in order of bucket to rows of DECIDED: pieces that share their anchor and one of its sides with another text."""
    held, last = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != last:
                yield from _shared(held)
                held, last = [], row[0]
            held.append(row[1:])
    yield from _shared(held)


def _shared(held: list[tuple]):
    """DECIDED of one bucket."""
    if not held:
        return
    parts = []
    for docs, keys, a, h, g, *rest in held:
        sides, t, p, n = map(_unpacked, rest)
        t = t.view(np.int64)
        ids = (_unpacked(docs[8:]).view(np.int64) + int.from_bytes(docs[:8], "little", signed=True))[t]
        th, tl = np.frombuffer(keys, "<i8").reshape(2, -1)[:, t]
        parts.append([np.cumsum(_unpacked(a)), np.frombuffer(h, U64), np.frombuffer(g, U64), sides.astype(np.uint32), ids, th, tl, p.astype(np.int32), n.astype(np.int32)])
    cols = [np.concatenate(c) for c in zip(*parts)]
    keep = np.flatnonzero(_twice(cols[0], cols[5]))
    cols = [c[keep] for c in cols]
    left, right = cols[3] >> 16, cols[3] & 0xFFFF
    keep = np.flatnonzero((_twice(cols[0], cols[5], left) & (left > 0)) | (_twice(cols[0], cols[5], right) & (right > 0)))
    a, h, g, _, doc, th, tl, p, n = (c[keep] for c in cols)
    never = np.zeros(len(a), bool)
    got = decide(a, h, g, th, tl, doc, p, n, doc, never, never)
    if got is not None:
        for i in range(0, got.num_rows, 50_000):
            yield got.slice(i, 50_000)


def _segments(offsets: np.ndarray, length: int):
    """Row ranges with their part of a long row: (first row, end row, from byte, to byte)."""
    for i, j in slices(offsets, SEGMENT):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= 2 * SEGMENT:
            yield i, j, a, b
        else:  # windows depend on their own bytes, and sides on less than `length` more, so segments overlap by that
            for c in range(a, b, SEGMENT):
                yield i, j, max(a, c - length), min(b, c + SEGMENT + 2 * length)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 16, group: int = 1000, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes]) of every row."""
    if not 1 <= gram <= length or length > 20_000:
        raise ValueError("needs 1 <= gram <= length <= 20000")
    texts = keyed(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(FINE * parts, 1 << 20)

    def scan(batches):
        copies = Copies()
        for b in batches:
            b = b.filter(pa.array(copies.fresh(*(b.column(k).to_numpy() for k in range(3)))))
            doc, th, tl = (b.column(k).to_numpy() for k in range(3))
            data, offsets = text_buffer(b.column(3))
            found = []
            for i, j, lo, hi in _segments(offsets, length):
                a, row, p, n, h, g, sides = anchors(data[lo:hi], np.clip(offsets[i : j + 1], lo, hi) - lo, length, gram)
                skip = np.maximum(lo - offsets[i : j + 1], 0)[row] if len(row) else p
                found.append((a, row + i, p + skip, n, h, g, sides))
            if found:
                yield from deal(doc, th, tl, *(np.concatenate(c) for c in zip(*found)), buckets)

    def cut(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(3))
            row, p, n, columns = wanted(b)
            for i, j in slices(np.concatenate(([0], np.cumsum(n + length))), 1 << 24):
                size = n[i:j] + length - 1
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
                at = np.repeat(offsets[row[i:j]] + p[i:j] - ends[:-1], size) + np.arange(ends[-1])
                strings = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[at].tobytes())])
                yield wanted_batch([c[i:j] for c in columns], strings.cast(pa.binary()))

    def report(batches):
        for t, borders in runs(batches, 1):
            raw = t.column("s").to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            # whole anchors, about `group` strings at a time
            for i, j in slices(borders, group):
                i, j = int(borders[i]), int(borders[j])
                part = t.slice(i, j - i)
                held = first_holders(np.frombuffer(b"".join(raw[i:j]), np.uint8), sizes[i:j], part.column("doc").to_numpy(), length)
                yield from reports(part, *held, sizes[i:j] - length + 1)

    def finish(batches):
        for b in batches:
            out = []
            for text, twin, (p, n) in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), runs_of(b.column(3))):
                data = text.encode()
                gone = covered(len(data), length, twin, p, n)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = list(zip(*out)) or [()] * 5
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "kept_bytes"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    known = texts.filter(F.col("doc_id").isNotNull())
    made = known.select("doc_id", "th", "tl", "text").mapInArrow(scan, DEALT)
    dealt = made.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(shared_anchors, DECIDED)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_bytes else "")
    return settle(texts, dealt, cut, report, finish, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 49)) AS p, unnest([md5(substr(x, 2 * i + 1, 100)) for i in range(0, len(x) // 2 - 49)]) AS g FROM b WHERE len(x) >= 100),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, p FROM s JOIN f USING (g) WHERE doc_id > first),
o AS (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 < p, true) AS head FROM r),
n AS (SELECT doc_id, p, sum(head::int) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM o),
u AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS z FROM n GROUP BY doc_id, span),
l AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
k AS (SELECT l.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS tail, sum(z - a)::bigint AS n_removed, count(*) AS n_spans
      FROM l JOIN b USING (doc_id) GROUP BY l.doc_id)
SELECT b.doc_id, (len(x) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN x ELSE kept || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)"""
